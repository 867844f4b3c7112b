"""The driver tables in the roles of the store's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators.textindex import TextIndex
from recollex.session import table
from recollex.storage import new_path, stamp

NOW = 1_706_745_600  # 2024-02-01
BASE = 1_704_067_200  # 2024-01-01


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, uri, title, text, meta (JSON), ts (milliseconds)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("uri"), F.substring_index("text", ".", 1).alias("title"), "text",
        F.concat(F.lit('{"lang":"'), "lang", F.lit('","source":"'), "source", F.lit('","n":'), F.col("n_chars").cast("string"), F.lit("}")).alias("meta"),
        (F.lit(BASE * 1000) + F.col("doc_id") * 60000).cast("long").alias("ts"), "lang", "source", "n_chars",
    )


DOCS = f"""docs AS (SELECT doc_id AS id, source || '/' || doc_id AS uri, split_part(text, '.', 1) AS title, text,
  '{{"lang":"' || lang || '","source":"' || source || '","n":' || n_chars || '}}' AS meta, {BASE}::BIGINT * 1000 + doc_id * 60000 AS ts, lang, source, n_chars FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("session_id"),
        F.concat(F.lit("agent"), (F.col("user_id") % 7).cast("string")).alias("agent"), F.col("event_type").alias("kind"),
        F.concat(F.lit("mem://"), F.get_json_object("props", "$.k")).alias("uri"), F.col("props").alias("content"), F.col("value"),
    )


EVENTS = """ev AS (SELECT event_id, floor(epoch(ts))::BIGINT AS ts, 's' || (user_id % 40) AS session_id, 'agent' || (user_id % 7) AS agent, event_type AS kind,
  'mem://' || json_extract_string(props, '$.k') AS uri, props AS content, value FROM events)"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs: the events that are purchases or views."""
    e = events(spark, sf_dir).filter("kind in ('purchase', 'view')")
    return e.select("event_id", "ts", "session_id", "agent", F.concat(F.lit("model-"), "kind").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 300).alias("output_tokens"), F.round("value", 2).alias("cost_usd"))


COSTS = """costs AS (SELECT event_id, ts, session_id, agent, 'model-' || kind AS model, event_id % 1000 AS input_tokens, event_id % 300 AS output_tokens, round(value, 2) AS cost_usd
  FROM ev WHERE kind IN ('purchase', 'view'))"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions: the signups."""
    e = events(spark, sf_dir).filter("kind = 'signup'")
    return e.select(
        F.col("event_id").alias("decision_id"), "ts", "session_id", "agent", F.concat(F.lit("dec://"), (F.col("event_id") % 500).cast("string")).alias("uri"), F.concat(F.lit("because "), "content").alias("rationale"),
        F.when(F.col("event_id") % 5 != 0, F.col("uri")).alias("source_uri"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("goal://"), (F.col("event_id") % 20).cast("string"))).alias("target_uri"),
    )


DECISIONS = """decisions AS (SELECT event_id AS decision_id, ts, session_id, agent, 'dec://' || (event_id % 500) AS uri, 'because ' || content AS rationale,
  CASE WHEN event_id % 5 <> 0 THEN uri END AS source_uri, CASE WHEN event_id % 5 <> 0 THEN 'goal://' || (event_id % 20) END AS target_uri FROM ev WHERE kind = 'signup')"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


VECTORS = "vectors AS (SELECT vec_id AS id, embedding, label FROM embeddings)"
KINDS = ["fact", "decision", "lesson", "preference", "episodic", "raw"]


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed memories of documents: every document has one, every third a later one that replaces it."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 6 + 1).cast("int"))
    first = d.select((F.col("doc_id") * 2).alias("id"), "doc_id", kind.alias("memory_type"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") * 2 + 1).alias("superseded_by"), (F.lit(BASE) + F.col("doc_id") * 60).cast("long").alias("updated_ts"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    later = d.filter("doc_id % 3 = 0").select((F.col("doc_id") * 2 + 1).alias("id"), "doc_id", F.lit("fact").alias("memory_type"), F.lit(None).cast("long").alias("superseded_by"), (F.lit(BASE) + F.col("doc_id") * 60 + 30).cast("long").alias("updated_ts"), F.lit(0.9).alias("confidence"))
    return first.unionByName(later)


MEMORIES = f"""memories AS (SELECT doc_id * 2 AS id, doc_id, (['fact','decision','lesson','preference','episodic','raw'])[doc_id % 6 + 1] AS memory_type,
    CASE WHEN doc_id % 3 = 0 THEN doc_id * 2 + 1 END AS superseded_by, {BASE} + doc_id * 60 AS updated_ts, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM documents
  UNION ALL SELECT doc_id * 2 + 1, doc_id, 'fact', NULL, {BASE} + doc_id * 60 + 30, 0.9 FROM documents WHERE doc_id % 3 = 0)"""


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph over the customers: from_id, to_id, rel, weight. Forward edges alone, so it has no cycle."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    a = c.select(F.col("k").alias("from_id"), (F.col("k") * 2 + 1).alias("to_id"), F.lit("CAUSED").alias("rel"), ((F.col("k") % 7 + 1) / 10.0).alias("weight"))
    b = c.select(F.col("k").alias("from_id"), (F.col("k") * 3 + 2).alias("to_id"), F.when(F.col("k") % 2 == 0, "DEPENDS_ON").otherwise("MENTIONS").alias("rel"), ((F.col("k") % 5 + 1) / 10.0).alias("weight"))
    return a.unionByName(b)


GRAPH = """c AS (SELECT c_custkey AS k FROM customer), edges AS (
  SELECT * FROM (SELECT k AS from_id, k * 2 + 1 AS to_id, 'CAUSED' AS rel, (k % 7 + 1) / 10.0::DOUBLE AS weight FROM c
  UNION ALL SELECT k, k * 3 + 2, CASE WHEN k % 2 = 0 THEN 'DEPENDS_ON' ELSE 'MENTIONS' END, (k % 5 + 1) / 10.0::DOUBLE FROM c))"""


def tag_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tags (a row each) and the documents' tags: language and every other source; one tag has no document."""
    d = docs(spark, sf_dir)
    pairs = d.select(F.col("id").alias("doc_id"), F.concat(F.lit("lang:"), "lang").alias("tag")).unionByName(d.filter("id % 2 = 0").select(F.col("id").alias("doc_id"), F.concat(F.lit("src:"), "source").alias("tag")))
    tags = pairs.select("tag").distinct().unionByName(spark.range(1).select(F.lit("unused").alias("tag")))
    return tags, pairs


TAGS = """doc_tags AS (SELECT id AS doc_id, 'lang:' || lang AS tag FROM docs UNION ALL SELECT id, 'src:' || source FROM docs WHERE id % 2 = 0),
tags AS (SELECT DISTINCT tag FROM doc_tags UNION ALL SELECT 'unused')"""


_KEPT: dict[tuple, TextIndex] = {}


def kept_text(spark: SparkSession, sf_dir: str, name: str = "documents") -> TextIndex:
    """The standing text index of the documents (or of the events' kinds and agents), built once for a session and the files' state."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, stamp(spark, path))
    if key not in _KEPT:
        if name == "documents":
            rows, fields = docs(spark, sf_dir).select("id", "title", "text"), ("title", "text")
        else:
            rows, fields = events(spark, sf_dir).select(F.col("event_id").alias("id"), F.concat("kind", F.lit(" "), "agent").alias("text")), ("text",)
        _KEPT[key] = TextIndex(spark, new_path(spark, f"kept-{name}"), fields=fields).build(rows)
    return _KEPT[key]
