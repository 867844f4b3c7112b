"""Queries over the whole tables, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.llm import centroid_clusters, decontaminate, licenses, neighbour_graph, quality_rules, rollups, secrets, sentencepiece_bpe, simhash, token_index, toxicity, url_filter, whitening
from recollex.session import small_batches, table
from recollex.storage import new_path

END_ID = 2
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def vocabulary(name: str, path: str | None = None) -> bytes:
    """Contents of a vocabulary file; executors get the bytes, not the path."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write and read back every document through the key index."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "token-index")
    token_index.write_dataset(docs, path, vocabulary("byte_bpe_50k.json"), end_id=END_ID)
    return token_index.lookup(spark, path, docs).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    small_batches(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM dw),
its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM iw),
sizes AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM shared JOIN sizes USING (item_id) WHERE n_shared >= ceil(n_item * 0.8)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier fitted on the labels that aren't held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, by graph search."""
    index = neighbour_graph.Index(table(spark, sf_dir, "embeddings"))
    return index.neighbours(F.col("id") % 100 == 0, 10)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    small_batches(spark)
    return sentencepiece_bpe.digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents: place, kind, share of votes and hash."""
    trees = secrets.fit(secrets.findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), trees)
    return found.select("doc_id", F.inline("findings"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in documents."""
    return licenses.detect(table(spark, sf_dir, "documents"), licenses.templates_frame(spark))


def _templates_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)
    return f"(VALUES {rows}) AS v(license, text)"


OP8_SQL = f"""
WITH units AS (
  SELECT DISTINCT doc_id AS k, unit FROM (SELECT doc_id, unnest(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), string_split(text, chr(10)))) AS unit FROM documents)
), uw AS (
  SELECT k, unit, list_filter(regexp_split_to_array(lower(unit), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM units
), ub AS (
  SELECT k, unit, len(w) - 1 AS a, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM uw WHERE len(w) BETWEEN 2 AND 1000
), ut AS (SELECT k, unit, a, b, count(*) AS n FROM ub GROUP BY ALL),
tw AS (SELECT DISTINCT license, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {_templates_sql()}),
tb AS (SELECT license, w, len(w) - 1 AS c, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw),
tt AS (SELECT license, w, c, b, count(*) AS n FROM tb GROUP BY ALL),
dice AS (SELECT k, license, 2 * sum(least(ut.n, tt.n)) / (a + c) AS d FROM ut JOIN tt USING (b) GROUP BY k, unit, license, w, a, c)
SELECT k AS doc_id, license, max(d) AS dice FROM dice WHERE d >= 0.8 GROUP BY k, license
"""


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.match(pages, url_filter.rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH rules(verdict, host, path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(split_part(coalesce(rest, ''), '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(split_part(coalesce(rest, ''), '/', 1)) + 1) AS path FROM cut
), found AS (
  SELECT p.*, (SELECT r.verdict || ' ' || r.host || r.path FROM rules r
               WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
               ORDER BY length(r.host || r.path) DESC LIMIT 1) AS hit FROM parts p
)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule, coalesce(split_part(hit, ' ', 1), 'allow') AS verdict FROM found
"""

def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer after three batches, one of them sent twice.

    All documents are loaded with counts of one vocabulary; those in other
    languages than English are then counted again with a multilingual one, and
    those labelled as of low quality are deleted.
    """
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    blank = F.lit(None).cast("string")
    load = rollups.count_tokens(docs.select("doc_id", "source", "lang", "text"), vocabulary("byte_bpe_50k.json"))
    load = load.select(F.lit("insert").alias("op"), "doc_id", "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), "n_tokens", F.lit(1).alias("seq"))
    foreign = docs.filter("lang <> 'en'").select("doc_id", "source", "lang", "text")
    revise = rollups.count_tokens(foreign, vocabulary("byte_bpe_multi_50k.tiktoken"))
    revise = revise.select(F.lit("revise").alias("op"), "doc_id", "source", "lang", F.lit("byte_bpe_multi_50k").alias("tokenizer"), "n_tokens", F.lit(2).alias("seq"))
    low = table(spark, sf_dir, "labels").filter("quality = 0")
    delete = low.select(F.lit("delete").alias("op"), "doc_id", blank.alias("source"), blank.alias("lang"), blank.alias("tokenizer"), F.lit(0).alias("n_tokens"), F.lit(3).alias("seq"))
    store = rollups.RollupStore(spark, new_path(spark, "token-rollup"))
    for batch, changes in (("load", load), ("multilingual", revise), ("low-quality", delete), ("multilingual", revise)):
        store.apply(batch, changes)
    store.compact()
    return store.totals()


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened values, a row for each component."""
    small_batches(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    values = whitening.whiten(rows, model, out="w").select("vec_id", "w", F.posexplode("w.whitened").alias("at", "whitened"))
    return values.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.col("w.n").alias("n"), F.expr("try_cast(w.deviation as bigint)").alias("deviation"),
        "whitened", F.element_at("w.explained", F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds from sixteen hashed starts."""
    small_batches(spark)
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    apart = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = []
    for i in range(4):
        steps.append(f"a{i} AS (SELECT vec_id, rid, x, min_by(k, d * 16 + k) AS k, min(d) AS d FROM (SELECT v.vec_id, v.rid, v.x, c.k, CAST({apart} AS BIGINT) AS d FROM v CROSS JOIN c{i} c) GROUP BY vec_id, rid, x)")
        steps.append(
            f"s{i} AS (SELECT k, i, sum(x[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) GROUP BY k, i), "
            f"c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY k) m ON c.k = m.k)"
        )
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT 16)),
{", ".join(steps[:-1])},
t AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY k)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, t.cluster_inertia, CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 a JOIN t ON a.k = t.k JOIN c3 ON a.k = c3.k
"""


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    small_batches(spark)
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) AS s FROM w WHERE len(words) > 5),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM r, range(0, 5) t(o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(p.n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p ON w.rid = p.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
a AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 10 * n_words OR word_chars < 2 * n_words OR word_chars > 16 * n_words AS failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS bad FROM a WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT sum(bad) / sum(n) AS m, count(*) AS hosts, sum(n) AS docs, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS between FROM h),
v AS (SELECT m, (between - hosts * m * (1 - m)) / docs AS spread FROM s),
k AS (SELECT m, spread, CASE WHEN spread > 0 THEN greatest(m * (1 - m) / spread - 1, 0) END AS weight FROM v),
j AS (SELECT source, CASE WHEN spread > 0 THEN (bad + m * weight) / (n + weight) ELSE m END > 0.5 AS rejected FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM a LEFT JOIN j ON a.source = j.source
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_index": op1_token_index,
    "op2_simhash": op2_simhash,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_neighbours": op5_neighbours,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_secrets": op7_secrets,
    "op8_licenses": op8_licenses,
    "op9_url_filter": op9_url_filter,
    "op10_token_rollup": op10_token_rollup,
    "op11_whitening": op11_whitening,
    "op12_centroids": op12_centroids,
    "op13_quality": op13_quality,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": OP3_SQL,
    "op8_licenses": OP8_SQL,
    "op9_url_filter": OP9_SQL,
    "op12_centroids": _op12_sql(),
    "op13_quality": OP13_SQL,
}
