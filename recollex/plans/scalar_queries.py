"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.functions import scores, text as tx, time as tm
from recollex.plans.models import BASE, DOCS, EVENTS, NOW, VECTORS, docs, events, vectors
from recollex.session import table


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _conv(s, d):
    return table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")


def _pairs(s, d):
    """Each vector with the one after it."""
    v = vectors(s, d)
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("next")), "id")


def _sign_words(s, d):
    w = scores.sign_words(F.col("embedding"), 64)
    return vectors(s, d).select("id", w[0].alias("w0"), w[1].alias("w1"))


def _types(s, d):
    kind, weight = tx.memory_type(F.col("text"))
    return _conv(s, d).select("id", kind.alias("kind"), weight.alias("weight"))


def _periods(s, d):
    rows = events(s, d)
    cols = []
    for p in ("day", "week", "month", "year"):
        a, b = tm.period_bounds(F.col("ts"), p)
        cols += [a.alias(f"{p}_start"), b.alias(f"{p}_end")]
    return rows.select("event_id", *cols)


def _packages(s, d):
    p = table(s, d, "part")
    eco = F.element_at(F.array(F.lit("cargo"), F.lit("npm"), F.lit("pypi")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select("p_partkey", tx.docs_url(eco, F.concat(F.lit("pkg-"), F.col("p_partkey").cast("string")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0")))).alias("url"))


def _decay(s, d):
    e = events(s, d)
    return e.select("event_id", F.round(scores.decay(F.lit(0.5), F.col("ts"), F.col("event_id") % 20, NOW, 7 * 86400), 6).alias("score"))


QUERIES = {
    "sf4_query_terms": lambda s, d: _conv(s, d).select("id", F.array_join(tx.query_terms(F.col("text")), " ").alias("terms")),
    "sf6_compact": lambda s, d: docs(s, d).select("id", tx.compact(F.col("text"), 120).alias("short")),
    "sf7_xml_escape": lambda s, d: table(s, d, "pages").select("page_id", tx.xml_escape(F.col("html")).alias("xml")),
    "sf8_estimate_tokens": lambda s, d: docs(s, d).select("id", tx.estimate_tokens(F.col("text")).alias("tokens")),
    "sf10_compress_facts": lambda s, d: docs(s, d).select("id", F.length(tx.compress(F.col("text"), "facts")).alias("n"), F.length(tx.compress(F.col("text"), "one_line")).alias("m")),
    "sf11_kind_of_meta": lambda s, d: docs(s, d).select("id", tx.kind_of_meta(F.col("meta")).alias("kind")),
    "sf12_memory_type": _types,
    "sf13_decompose": lambda s, d: _conv(s, d).select("id", F.array_join(tx.decompose(F.concat_ws(" vs ", "role", "text")), "|").alias("parts")),
    "sf14_grade": lambda s, d: docs(s, d).select("id", F.round(tx.grade(F.lit("eringble and thined nichtch"), F.col("text")), 6).alias("grade")),
    "sf15_hyde": lambda s, d: _conv(s, d).select("id", tx.expand_query(F.col("text")).alias("q")),
    "sf16_summarize": lambda s, d: docs(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(tx.summarize(F.split("text", "\n")))).alias("chars")),
    "sf16_summarize_text": lambda s, d: docs(s, d).select("id", tx.summarize(F.split("text", "\n")).alias("summary")),
    "sf19_auto_title": lambda s, d: docs(s, d).select("id", tx.one_line(F.col("text")).alias("title")),
    "sf20_gold_query": lambda s, d: docs(s, d).select("id", tx.gold_query(F.col("title"), F.col("text"), F.col("id")).alias("q")),
    "sf21_docs_url": _packages,
    "sf22_freshness_needed": lambda s, d: _conv(s, d).select("id", tx.freshness_needed(F.concat("text", F.when(F.col("id") % 5 == 0, F.lit(" latest")).otherwise(F.lit("")))).alias("fresh")),
    "sf23_shape_hash": lambda s, d: _conv(s, d).select("id", tx.shape_hash(F.col("text")).cast("int").alias("shape")),
    "sf24_short_id": lambda s, d: docs(s, d).select("id", tx.short_id(F.col("uri"), F.col("title")).alias("h")),
    "sf25_skill_hints": lambda s, d: _conv(s, d).select("id", F.array_join(tx.skill_hints(F.concat("text", F.lit(" cost of the test"))), ",").alias("hints")),
    "sf27_scope_path": lambda s, d: docs(s, d).select("id", tx.scope_path(F.col("source"), F.col("uri"), F.lit("100%")).alias("path")),
    "xt26_scope_tag": lambda s, d: docs(s, d).select("id", tx.scope_tag(F.when(F.col("id") % 3 == 0, "user").when(F.col("id") % 3 == 1, "project").otherwise("x"), F.col("source"), F.lit("s"), F.col("lang")).alias("tag")),
    "sf28_mime": lambda s, d: docs(s, d).select("id", tx.mime(F.concat(F.lit("a."), F.element_at(F.array(*[F.lit(x) for x in ("PNG", "mp4", "wav", "txt", "bin")]), (F.col("id") % 5 + 1).cast("int")))).alias("mime")),
    "so9_aj7_jaccard": lambda s, d: _r(docs(s, d).join(docs(s, d).select((F.col("id") - 1).alias("id"), F.col("text").alias("next")), "id").select("id", tx.jaccard(tx.long_tokens(F.col("text")), tx.long_tokens(F.col("next"))).alias("j")), "j"),
    "sc21_web_html": lambda s, d: _web(s, d),
    "dt1_timestamps": lambda s, d: table(s, d, "events").select("event_id", tm.parse_timestamp(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("t")),
    "dt2_civil": lambda s, d: table(s, d, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("days"), F.dayofmonth(F.last_day("o_orderdate")).alias("in_month")),
    "dt3_period_bounds": _periods,
    "dt7_freshness": lambda s, d: events(s, d).select("event_id", tm.freshness(F.when(F.col("event_id") % 3 == 0, F.col("ts")), F.when(F.col("event_id") % 3 == 1, F.col("uri")), BASE + 15 * 86400).alias("label")),
    "ma1_cosine": lambda s, d: _r(_pairs(s, d).select("id", scores.cosine(F.col("embedding"), F.col("next")).alias("cos"), scores.dot(F.col("embedding"), F.col("next")).alias("dot")), "cos", "dot"),
    "ma3_l2": lambda s, d: _r(_pairs(s, d).select("id", scores.l2_squared(F.col("embedding"), F.col("next")).alias("d")), "d"),
    "ma4_hamming": lambda s, d: _pairs(s, d).select("id", scores.hamming(scores.sign_words(F.col("embedding"), 64), scores.sign_words(F.col("next"), 64)).cast("int").alias("d")),
    "ma5_int8": lambda s, d: vectors(s, d).select("id", F.round(scores.int8_scale(F.col("embedding")), 9).alias("scale"), F.array_join(F.transform(scores.int8(F.col("embedding")), lambda x: x.cast("string")), ",").alias("codes")),
    "ma7_signs": _sign_words,
    "ma12_reciprocal": lambda s, d: docs(s, d).select("id", F.round(scores.reciprocal_rank(F.col("id") + 1), 9).alias("r"), F.round(scores.distance_score(F.col("id") / 10), 9).alias("s")),
    "ma15_ma24_recall_heat": lambda s, d: _r(events(s, d).select("event_id", scores.recall_heat(F.lit(1.0), F.col("ts"), NOW).alias("h")), "h"),
    "ma16_usage_heat": lambda s, d: _r(events(s, d).select("event_id", scores.usage_heat(F.lit(1.0), F.col("event_id") % 9, F.col("ts"), NOW).alias("h")), "h"),
    "ma17_decay": _decay,
    "sl11_decay_order": lambda s, d: _decay(s, d).orderBy(F.desc("score"), "event_id").limit(50),
    "ma18_ma19_blends": lambda s, d: _r(docs(s, d).select("id", scores.rerank_blend(F.col("id") / 7.0, F.col("id") / 3.0).alias("a"), scores.grade_blend(F.col("id") / 7.0, F.col("id") / 3.0).alias("b")), "a", "b"),
    "ma21_calibration": lambda s, d: docs(s, d).select("id", scores.bucket(F.col("id") % 113 / 100.0).alias("bucket"), F.round(scores.calibrated(F.col("id") % 113 / 100.0, F.when(F.col("id") % 2 == 0, 0.9)), 6).alias("c")),
    "ma23_kind_bonus": lambda s, d: _r(events(s, d).groupBy("kind").agg(scores.kind_bonus(F.sum((F.col("event_id") % 3 == 0).cast("long")), F.sum((F.col("event_id") % 3 != 0).cast("long"))).alias("bonus")), "bonus"),
    "mm1_type_weights": lambda s, d: events(s, d).select("event_id", scores.type_weight(F.element_at(F.array(*[F.lit(k) for k in ("fact", "decision", "lesson", "preference", "episodic", "raw")]), (F.col("event_id") % 6 + 1).cast("int"))).alias("w")),
    "aj1_json_extract": lambda s, d: events(s, d).select("event_id", F.get_json_object("content", "$.k").cast("long").alias("k"), F.get_json_object("content", "$.absent").alias("none")),
    "aj2_json_set": lambda s, d: _json_set(s, d),
    "aj3_json_each": lambda s, d: docs(s, d).select("id", F.explode(F.from_json(F.concat(F.lit("["), F.col("id").cast("string"), F.lit(","), (F.col("id") + 1).cast("string"), F.lit("]")), "array<bigint>")).alias("e")),
    "aj4_json_valid": lambda s, d: docs(s, d).select("id", F.try_parse_json(F.when(F.col("id") % 3 == 0, F.lit("{bad")).otherwise(F.col("meta"))).isNotNull().alias("ok")),
    "aj5_json_probe": lambda s, d: docs(s, d).filter(F.get_json_object("meta", "$.source") == "src7").select("id"),
    "aj8_windows": lambda s, d: docs(s, d).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(350)), lambda i: F.substring("text", i + 1, F.lit(400)))).alias("n", "w")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("w")).alias("chars")),
}


def _web(s, d):
    from recollex.operators.corpus import web_documents

    return web_documents(table(s, d, "pages"))


def _json_set(s, d):
    from recollex.operators.sync import set_meta

    new = set_meta(F.col("meta"), "merged_into", F.lit("7"))
    return docs(s, d).select("id", F.get_json_object(new, "$.merged_into").alias("m"), F.get_json_object(new, "$.lang").alias("lang"))


_CONV = "conv AS (SELECT conv_id * 1000 + turn AS id, text, role FROM conversations)"
_PAIRS = f"{VECTORS}, p AS (SELECT a.id, list_transform(a.embedding, lambda x: x::DOUBLE) AS e, list_transform(b.embedding, lambda x: x::DOUBLE) AS f FROM vectors a JOIN vectors b ON b.id = a.id + 1)"
_LONG = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 2))"
_STOPS = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_ELAPSED = f"greatest({NOW} - ts, 0)"
_DECAY = f"0.5 * pow(0.5, {_ELAPSED} / 604800.0) * CASE WHEN {_ELAPSED} < 3600 THEN 1.2 ELSE 1.0 END * (1 + least(0.05 * (event_id % 20), 0.5))"


def _strip(column: str) -> str:
    out = f"regexp_replace(regexp_replace({column}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{raw}')"
    return f"trim(regexp_replace({out}, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'))"


_WEEK = "date_trunc('{p}', make_timestamp(ts * 1000000))"
ORACLE_SQL = {
    "sf4_query_terms": f"WITH {_CONV}, t AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS w FROM conv) SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:16], ' ') AS terms FROM t",
    "sf6_compact": f"WITH {DOCS}, t AS (SELECT id, regexp_replace(trim(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS f FROM docs) SELECT id, CASE WHEN length(f) > 120 THEN left(f, 120) || '...' ELSE f END AS short FROM t",
    "sf7_xml_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml FROM pages",
    "sf8_estimate_tokens": f"WITH {DOCS}, t AS (SELECT id, text, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}_\\s\\x0b]+')) AS m FROM docs) SELECT id, CASE WHEN text = '' THEN 0 ELSE greatest(ceil(w * 13 / 10)::BIGINT + m, ceil(length(text) / 3)::BIGINT, 1) END AS tokens FROM t",
    "sf11_kind_of_meta": "SELECT doc_id AS id, 'other' AS kind FROM documents",
    "sf12_memory_type": f"WITH {_CONV}, t AS (SELECT id, CASE WHEN regexp_matches(lower(text), 'decided|chose|we will') THEN 'decision' WHEN regexp_matches(lower(text), 'learned|turns out|lesson') THEN 'lesson' WHEN regexp_matches(lower(text), 'prefer|likes|hates') THEN 'preference' ELSE 'fact' END AS kind FROM conv) SELECT id, kind, CASE kind WHEN 'decision' THEN 0.6 WHEN 'lesson' THEN 0.6 WHEN 'preference' THEN 0.55 ELSE 0.5 END::DOUBLE AS weight FROM t",
    "sf14_grade": "SELECT doc_id AS id, round((contains(lower(text), 'eringble')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'thined')::INT + contains(lower(text), 'nichtch')::INT) / 4, 6) AS grade FROM documents",
    "sf15_hyde": f"WITH {_CONV} SELECT id, 'A document that answers the question about ' || text || ' would explain: ' || text AS q FROM conv",
    "sf16_summarize": f"WITH {DOCS} SELECT source, count(*) AS n, sum(length(array_to_string(list_transform(string_split(text, chr(10)), lambda x: left(x, 200)), ' / ')))::BIGINT AS chars FROM docs GROUP BY source",
    "sf16_summarize_text": "SELECT doc_id AS id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: left(x, 200)), ' / ') AS summary FROM documents",
    "sf19_auto_title": "SELECT doc_id AS id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS title FROM documents",
    "sf20_gold_query": f"WITH {DOCS}, t AS (SELECT id, title, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOPS}))[1:8], ' ') AS q FROM docs) SELECT id, CASE WHEN q <> '' THEN q WHEN trim(title) <> '' THEN trim(title) ELSE 'corpus chunk ' || id END AS q FROM t",
    "sf21_docs_url": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'https://docs.rs/pkg-' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/' || p_size || '.0' ELSE '' END WHEN 1 THEN 'https://www.npmjs.com/package/pkg-' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/v/' || p_size || '.0' ELSE '' END ELSE 'https://pypi.org/project/pkg-' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/' || p_size || '.0/' ELSE '/' END END AS url FROM part",
    "sf22_freshness_needed": f"WITH {_CONV} SELECT id, regexp_matches(lower(text || CASE WHEN id % 5 = 0 THEN ' latest' ELSE '' END), 'latest|newest|current version|upgrade|update|deprecated|release|outdated') AS fresh FROM conv",
    "sf23_shape_hash": f"WITH {_CONV} SELECT id, ((strlen(split_part(trim(text), ' ', 1)) & 63) + regexp_matches(text, '[0-9]')::INT * 64 + contains(text, '\"')::INT * 128)::INT % 256 AS shape FROM conv",
    "sf24_short_id": f"WITH {DOCS} SELECT id, left(sha256(concat_ws(chr(31), uri, title)), 16) AS h FROM docs",
    "sf25_skill_hints": f"WITH {_CONV}, t AS (SELECT id, lower(text || ' cost of the test') AS t FROM conv) SELECT id, array_to_string(list_filter(['billing', CASE WHEN contains(t, 'deploy') THEN 'deployment' END, CASE WHEN contains(t, 'error') THEN 'debugging' END, CASE WHEN contains(t, 'graph') THEN 'knowledge-graph' END, CASE WHEN contains(t, 'sql') THEN 'database' END, 'testing'], lambda x: x IS NOT NULL), ',') AS hints FROM t",
    "sf27_scope_path": f"WITH {DOCS} SELECT id, source || '/' || replace(uri, '/', '%2F') || '/100%25' AS path FROM docs",
    "xt26_scope_tag": f"WITH {DOCS} SELECT id, CASE id % 3 WHEN 0 THEN 'user:' || source WHEN 1 THEN 'project:' || lang ELSE 'global' END AS tag FROM docs",
    "sf28_mime": "SELECT doc_id AS id, (['image', 'video', 'audio', 'text', 'other'])[doc_id % 5 + 1] AS mime FROM documents",
    "so9_aj7_jaccard": f"WITH t AS (SELECT doc_id AS id, {_LONG} AS w FROM documents) SELECT a.id, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS j FROM t a JOIN t b ON b.id = a.id + 1",
    "sc21_web_html": f"SELECT page_id AS id, url AS uri, CASE WHEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) <> '' THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) ELSE url END AS title, {_strip('html')} AS text FROM pages",
    "dt1_timestamps": "SELECT event_id, floor(epoch(ts))::BIGINT AS t FROM events",
    "dt2_civil": "SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::INT AS days, day(last_day(o_orderdate))::INT AS in_month FROM orders",
    "dt3_period_bounds": f"WITH {EVENTS} SELECT event_id, " + ", ".join(f"epoch({_WEEK.format(p=p)})::BIGINT AS {p}_start, epoch({_WEEK.format(p=p)} + INTERVAL {i})::BIGINT - 1 AS {p}_end" for p, i in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("year", "1 YEAR"))) + " FROM ev",
    "dt7_freshness": f"WITH {EVENTS} SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN ts < {BASE + 15 * 86400} THEN 'stale' ELSE 'current' END WHEN 1 THEN 'current' ELSE 'unknown' END AS label FROM ev",
    "ma1_cosine": f"WITH {_PAIRS} SELECT id, round(list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f))), 6) AS cos, round(list_dot_product(e, f), 6) AS dot FROM p",
    "ma3_l2": f"WITH {_PAIRS} SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: (e[i] - f[i]) * (e[i] - f[i]))), 6) AS d FROM p",
    "ma4_hamming": f"WITH {_PAIRS} SELECT id, list_sum(list_transform(range(1, 65), lambda i: ((e[i] > 0) <> (f[i] > 0))::INT))::INT AS d FROM p",
    "ma5_int8": f"WITH {VECTORS}, v AS (SELECT id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127 AS s FROM vectors) SELECT id, round(s, 9) AS scale, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE / s)::INT), ',') AS codes FROM v",
    "ma7_signs": f"WITH {VECTORS} SELECT id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS w0, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN embedding[i + 32] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS w1 FROM vectors",
    "ma12_reciprocal": "SELECT doc_id AS id, round(1.0 / (60.0 + doc_id + 1), 9) AS r, round(1.0 / (1.0 + doc_id / 10), 9) AS s FROM documents",
    "ma15_ma24_recall_heat": f"WITH {EVENTS} SELECT event_id, round(greatest(pow(0.97, greatest(({NOW} - ts) / 86400.0, 0)), 0.3), 6) AS h FROM ev",
    "ma16_usage_heat": f"WITH {EVENTS} SELECT event_id, round((1 + ln(1.0 + event_id % 9)) * exp(-0.05 * greatest(({NOW} - ts) / 86400.0, 0)), 6) AS h FROM ev",
    "ma17_decay": f"WITH {EVENTS} SELECT event_id, round({_DECAY}, 6) AS score FROM ev",
    "sl11_decay_order": f"WITH {EVENTS} SELECT event_id, round({_DECAY}, 6) AS score FROM ev ORDER BY score DESC, event_id LIMIT 50",
    "ma18_ma19_blends": "SELECT doc_id AS id, round(0.7 * (doc_id / 7.0) + 0.3 * (doc_id / 3.0), 6) AS a, round(0.6 * (doc_id / 7.0) + 0.4 * (doc_id / 3.0), 6) AS b FROM documents",
    "ma21_calibration": "SELECT doc_id AS id, least(greatest(floor((doc_id % 113 / 100.0::DOUBLE) * 10), 0), 9)::BIGINT AS bucket, round(least(greatest((doc_id % 113 / 100.0::DOUBLE) * CASE WHEN doc_id % 2 = 0 THEN 0.9::DOUBLE ELSE 1.0 END, 0), 1), 6) AS c FROM documents",
    "ma23_kind_bonus": f"WITH {EVENTS} SELECT kind, round(avg((event_id % 3 = 0)::INT) * 0.03, 6) AS bonus FROM ev GROUP BY kind",
    "mm1_type_weights": "SELECT event_id, ([1.2, 1.1, 1.05, 1.15, 0.95, 1.0])[event_id % 6 + 1]::DOUBLE AS w FROM events",
    "aj1_json_extract": f"WITH {EVENTS} SELECT event_id, json_extract_string(content, '$.k')::BIGINT AS k, json_extract_string(content, '$.absent') AS \"none\" FROM ev",
    "aj2_json_set": f"WITH {DOCS} SELECT id, '7' AS m, lang FROM docs",
    "aj3_json_each": "SELECT doc_id AS id, unnest([doc_id, doc_id + 1]) AS e FROM documents",
    "aj4_json_valid": "SELECT doc_id AS id, doc_id % 3 <> 0 AS ok FROM documents",
    "aj5_json_probe": "SELECT doc_id AS id FROM documents WHERE source = 'src7'",
    "aj8_windows": "SELECT doc_id AS id, count(*) AS n, sum(length(substr(text, s + 1, 400)))::BIGINT AS chars FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 350)) AS s FROM documents) GROUP BY doc_id",
}
