"""Joins that hydrate hits, logs, and the remaining listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollex.operators import corpus as cp, events as ev, fulltext as ft, fusion, learning as ln, packing as pk, vectors as vs
from recollex.functions import text as tx, time as tm
from recollex.plans.models import BASE, DECISIONS, DOCS, EVENTS, MEMORIES, NOW, VECTORS, costs, decisions, docs, events, kept_text, memories, vectors
from recollex.plans.search_queries import _ANY_TERMS, _COS, _Q, ANY, _bm25, query_vector
from recollex.session import table
from recollex.sources.media import frames_of


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _edges(s, d):
    return ev.decisions_graph(decisions(s, d))


def _step(s, d):
    """One step of a walk: the frontier's edges and what their ends are."""
    nodes, edges = _edges(s, d)
    front = nodes.filter("kind = 'source'").select(F.col("uri").alias("from_uri"))
    return edges.join(front, "from_uri").join(nodes.select(F.col("uri").alias("to_uri"), "kind", "first_seen"), "to_uri").select("from_uri", "to_uri", "kind", "first_seen")


def _chunk_hits(s, d):
    """Chunks found by words, with the documents that they are from."""
    parts = cp.chunks(docs(s, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))).select((F.col("id") * 10000 + F.col("chunk")).alias("id"), F.col("id").alias("doc"), "text")
    hits = ft.search(parts, ft.compile_loose("eringble thined"), 20, fields=("text",))
    return _r(hits.join(parts.select("id", "doc"), "id").join(docs(s, d).select(F.col("id").alias("doc"), "uri"), "doc").select("id", "uri", "score"), "score")


def _space(s, d):
    """Fusion of a wing's documents with pools of their own sizes."""
    inside = docs(s, d).filter("source = 'src3'")
    lex = fusion.ranked(ft.search(inside, ANY, 10), "fts")
    vec = fusion.ranked(vs.knn(vectors(s, d).join(inside.select("id"), "id", "left_semi"), query_vector(s, d), 30), "vec", by="distance", descending=False)
    return _r(fusion.rrf([lex, vec], 10), "score")


def _log(s, d):
    e = events(s, d)
    return e.select(F.col("event_id").alias("query_id"), F.col("uri").alias("doc"), F.col("ts"), (F.col("event_id") % 4 == 0).alias("clicked"), F.col("value").alias("latency"))


def _max_pool(s, d):
    """Each word gives its first letters too; a term weighs what its heaviest source gives it."""
    words = docs(s, d).select("id", F.explode(tx.tokens(F.col("text"))).alias("w"))
    grown = words.select("id", F.explode(F.array(F.struct(F.col("w").alias("term"), F.lit(1.0).alias("x")), F.struct(F.substring("w", 1, 3).alias("term"), (F.length("w") / 10).alias("x")))).alias("t"))
    return _r(grown.groupBy("id", "t.term").agg(F.max("t.x").alias("weight")).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("weight")), "weight")


def _frames(s, d):
    rows = events(s, d).select(F.col("event_id").alias("id"), (F.col("event_id") % 50).alias("parent_id"), "ts")
    return frames_of(rows, 7)


def _periods(s, d):
    """Phrases read as periods on the driver, as a query text is; then a range filter."""
    first, last = tm.parse_period("last week", NOW - 14 * 86400)
    return events(s, d).filter(F.col("ts").between(first, last)).select("event_id")


QUERIES = {
    "pf8_meta_of_hits": lambda s, d: kept_text(s, d).search(ANY, 20).select("id").join(docs(s, d).select("id", "meta"), "id"),
    "jn1_hits_with_docs": lambda s, d: _r(kept_text(s, d).search(ANY, 20).join(docs(s, d).select("id", "uri", "title"), "id"), "score"),
    "jn2_vectors_with_docs": lambda s, d: _r(vs.knn(vectors(s, d), query_vector(s, d), 20).join(docs(s, d).select("id", "uri"), "id"), "distance"),
    "jn6_memories_with_text": lambda s, d: memories(s, d).join(docs(s, d).select(F.col("id").alias("doc_id"), F.length("text").alias("chars")), "doc_id").groupBy("memory_type").agg(F.sum("chars").alias("chars")),
    "jn7_bfs_step": _step,
    "jn8_ft5_chunk_hits": _chunk_hits,
    "wn1_rank_positions": lambda s, d: fusion.ranked(events(s, d).select(F.col("event_id").alias("id"), "agent", F.col("value").alias("score")), "leg", group=["agent"]).select("id", "agent", "rank"),
    "wn7_space_rrf": _space,
    "sl7_recent_memories": lambda s, d: memories(s, d).orderBy(F.desc("updated_ts"), F.desc("id")).limit(25).select("id", "memory_type"),
    "ag23_max_pool": _max_pool,
    "mm15_click_log": lambda s, d: _log(s, d).groupBy("doc").agg(F.count(F.lit(1)).alias("shown"), F.sum(F.col("clicked").cast("long")).alias("clicked")),
    "xt25_feedback_rows": lambda s, d: _log(s, d).filter("clicked").withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("ts"), F.desc("query_id")))).filter("r = 1").select("doc", "query_id"),
    "ud4_query_log": lambda s, d: _r(_log(s, d).groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("latency").alias("slowest")), "slowest"),
    "xt9_frames": _frames,
    "dt4_period_filter": _periods,
    "cx11_daily_costs": lambda s, d: ev.cost_by_day(costs(s, d), BASE).groupBy("day").agg(F.round(F.sum("cost_usd"), 2).alias("cost_usd")),
    "ud1_ud2_bandits": lambda s, d: s.createDataFrame([(ln.pick({"a": (90, 10), "b": (10, 90)}, ["a", "b"], 1), ln.pick_alpha({}, 3, 1)[0])], "arm string, alpha long"),
    "so5_near_copies_collapse": lambda s, d: pk.pack(docs(s, d).select((F.col("id") % 20).alias("qid"), "id", F.lit("fact").alias("kind"), (F.col("id") % 97 / 97.0).alias("score"), "text"), pk.PackOptions(budget=4000)).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")),
}

_CH = """ch AS (SELECT doc_id * 10000 + chunk AS id, doc_id AS doc, raw AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS chunk FROM documents) WHERE trim(raw) <> ''),
cw AS (SELECT id, doc, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS w FROM ch), cs AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM cw),
cp AS (SELECT id, doc, term, dl, count(*) AS tf FROM (SELECT id, doc, len(w) AS dl, unnest(w) AS term FROM cw) WHERE term IN ('eringble', 'thined') GROUP BY ALL), cl AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM cp)"""
ORACLE_SQL = {
    "pf8_meta_of_hits": f"WITH {DOCS}, {_bm25(_ANY_TERMS, 1, 20)} SELECT id, meta FROM hits JOIN docs USING (id)",
    "jn1_hits_with_docs": f"WITH {DOCS}, {_bm25(_ANY_TERMS, 1, 20)} SELECT id, round(score, 6) AS score, uri, title FROM hits JOIN docs USING (id)",
    "jn2_vectors_with_docs": f"WITH {DOCS}, {VECTORS}, {_Q}, n AS (SELECT id, {_COS} AS d FROM vectors, q ORDER BY round(d, 9), id LIMIT 20) SELECT id, round(d, 6) AS distance, uri FROM n JOIN docs USING (id)",
    "jn6_memories_with_text": f"WITH {MEMORIES} SELECT memory_type, sum(length(text))::BIGINT AS chars FROM memories JOIN documents USING (doc_id) GROUP BY 1",
    "jn7_bfs_step": f"""WITH {EVENTS}, {DECISIONS}, n AS (SELECT uri, 'decision' AS kind, ts FROM decisions UNION ALL SELECT source_uri, 'source', ts FROM decisions WHERE source_uri IS NOT NULL UNION ALL SELECT target_uri, 'target', ts FROM decisions WHERE source_uri IS NOT NULL),
nodes AS (SELECT uri, arg_min(kind, (ts, kind)) AS kind, min(ts) AS first_seen FROM n GROUP BY uri), e AS (SELECT source_uri AS a, uri AS b FROM decisions WHERE source_uri IS NOT NULL UNION SELECT uri, target_uri FROM decisions WHERE source_uri IS NOT NULL)
SELECT a AS from_uri, b AS to_uri, t.kind, t.first_seen FROM e JOIN nodes f ON f.uri = a AND f.kind = 'source' JOIN nodes t ON t.uri = b""",
    "jn8_ft5_chunk_hits": f"WITH {DOCS}, {_CH}, h AS (SELECT id, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s FROM cl, cs GROUP BY id, doc ORDER BY round(s, 9) DESC, id LIMIT 20) SELECT h.id, uri, round(s, 6) AS score FROM h JOIN docs ON docs.id = doc",
    "wn1_rank_positions": f"WITH {EVENTS} SELECT event_id AS id, agent, row_number() OVER (PARTITION BY agent ORDER BY value DESC, event_id)::INT AS rank FROM ev",
    "sl7_recent_memories": f"WITH {MEMORIES} SELECT id, memory_type FROM memories ORDER BY updated_ts DESC, id DESC LIMIT 25",
    "ag23_max_pool": "WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS w FROM documents), t AS (SELECT id, w AS term, 1.0::DOUBLE AS x FROM w UNION ALL SELECT id, left(w, 3), length(w) / 10 FROM w), m AS (SELECT id, term, max(x) AS x FROM t GROUP BY 1, 2) SELECT id, count(*) AS terms, round(sum(x), 6) AS weight FROM m GROUP BY id",
    "mm15_click_log": f"WITH {EVENTS} SELECT uri AS doc, count(*) AS shown, sum((event_id % 4 = 0)::INT)::BIGINT AS clicked FROM ev GROUP BY uri",
    "xt25_feedback_rows": f"WITH {EVENTS} SELECT uri AS doc, event_id AS query_id FROM ev WHERE event_id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY uri ORDER BY ts DESC, event_id DESC) = 1",
    "ud4_query_log": f"WITH {EVENTS} SELECT ts // 86400 AS day, count(*) AS n, round(max(value), 6) AS slowest FROM ev GROUP BY 1",
    "xt9_frames": f"WITH {EVENTS} SELECT event_id AS id, event_id % 50 AS parent_id, ts FROM ev WHERE event_id % 50 = 7",
    "dt4_period_filter": f"WITH {EVENTS} SELECT event_id FROM ev WHERE ts BETWEEN epoch(TIMESTAMP '2024-01-08')::BIGINT AND epoch(TIMESTAMP '2024-01-15')::BIGINT - 1",
    "cx11_daily_costs": f"WITH {EVENTS}, c AS (SELECT ts, agent, kind, round(value, 2) AS v FROM ev WHERE kind IN ('purchase', 'view')), g AS (SELECT ts // 86400 AS k, agent, kind, round(sum(v), 4) AS v FROM c GROUP BY 1, 2, 3) SELECT strftime(to_timestamp(k * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, round(sum(v), 2) AS cost_usd FROM g GROUP BY 1",
}
