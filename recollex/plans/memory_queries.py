"""Memories, corpus, tags, merging, packing, learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollex.operators import corpus as cp, events as ev, fulltext as ft, fusion, graph as g, learning as ln, memory as mm, packing as pk, sync, tags as tg
from recollex.plans.models import BASE, DOCS, EVENTS, MEMORIES, NOW, TAGS, VECTORS, docs, events, graph, memories, tag_rows, vectors
from recollex.plans.search_queries import ANY, query_vector
from recollex.session import table


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _rules(s):
    rows = [F.struct(F.lit(k).alias("keyword"), F.lit(t).alias("tag"), F.lit(e).alias("enabled")) for k, t, e in (("Eringble", "a", True), ("nichtch", "b", True), ("the", "c", False))]
    return s.range(1).select(F.inline(F.array(*rows)))


def _ops(s, d, side: int):
    """Two replicas' operations on documents."""
    e = events(s, d).filter(F.col("event_id") % 2 == side)
    return e.select(F.lpad(F.col("event_id").cast("string"), 10, "0").alias("op_id"), "kind", (F.col("event_id") % 700).alias("doc_id"), (F.col("ts") % 1000).alias("ts"), F.col("content").alias("payload"))


def _writers(s, d):
    base = docs(s, d)
    return [base.filter(F.col("id") % 3 != i).select("uri", F.lit(f"actor{i}").alias("actor"), (F.col("id") * (i + 1) % 17).alias("ts"), F.create_map(F.lit(f"k{i}"), F.col("lang"), F.lit("shared"), F.concat(F.lit(f"v{i}-"), "source")).alias("meta")) for i in range(3)]


def _snapshots(s, d):
    x = docs(s, d).select("uri", "title", "text", "meta", F.sha2("text", 256).alias("hash"), "id")
    a = x.filter("id % 3 <> 0").withColumn("meta", F.when(F.col("id") % 2 == 0, F.col("meta"))).drop("id")
    b = x.filter("id % 4 <> 0").withColumn("title", F.lit("other")).drop("id")
    return sync.merge_snapshots(a, b)


def _click_log(s, d):
    e = events(s, d)
    return e.select(F.col("kind").alias("query_text"), (F.col("event_id") % 10 / 10.0).alias("bm25"), (F.col("event_id") % 7 / 7.0).alias("vec"), (F.col("event_id") % 5).alias("rank"), (F.col("event_id") % 3 / 3.0).alias("score"), (F.col("event_id") % 4 == 0).alias("clicked"))


def _gold(s, d):
    """Questions: each document should be found by a search that returns its neighbours by id."""
    gold = docs(s, d).select(F.col("id").alias("qid"), "id")
    ranks = gold.select("qid", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).select("qid", (F.col("i") + 1).alias("rank"), (F.col("qid") + (F.col("qid") % 9) - F.col("i")).alias("id"))
    return gold, ranks


def _candidates(s, d):
    """All documents in pools of fifty neighbours by id, one pool a query."""
    e = docs(s, d)
    return e.select(F.floor(F.col("id") / 50).alias("qid"), "id", F.element_at(F.array(F.lit("fact"), F.lit("decision"), F.lit("code")), (F.col("id") % 3 + 1).cast("int")).alias("kind"), (F.col("id") % 37 / 37.0).alias("score"), "text")


def _fresh(s, d):
    """Declared packages against a table of their newest versions."""
    p = table(s, d, "part")
    deps = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("have"))
    registry = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") + F.col("p_partkey") % 2).alias("latest"))
    status = F.when(F.col("latest").isNull(), "unknown").when(F.col("latest") > F.col("have"), "outdated").otherwise("current")
    return deps.join(registry, "id", "left").select("id", "have", "latest", status.alias("status"))


def _web_sources(s, d):
    pages = table(s, d, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "text/html").when(F.col("page_id") % 3 == 1, None).otherwise("application/pdf")
    return pages.select("page_id", cp.fetched_kind(kind, F.col("html")).alias("kind"))


def _due(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50 * 10).alias("interval"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 3).alias("last_sync"))
    return cp.due_sources(rows, 1000, 100)


def _recall(s, d, **kw):
    edges = graph(s, d)
    return _r(mm.recall(docs(s, d), memories(s, d), vectors(s, d), edges, mm.RecallParams(ANY, 15, now=NOW, **kw), query_vector(s, d)).select("id", "score", "memory_type", "uri"), "score")


QUERIES = {
    "sc13_put": lambda s, d: cp.put(docs(s, d)).select("id", "hash"),
    "sc14_put_batch_ids": lambda s, d: cp.put_batch_ids(docs(s, d), cp.put(docs(s, d))),
    "so4_content_dedup": lambda s, d: docs(s, d).select(F.sha2("text", 256).alias("hash")).distinct(),
    "ag10_duplicates": lambda s, d: docs(s, d).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    "sc17_delete": lambda s, d: cp.delete(docs(s, d), docs(s, d).filter("lang = 'de'")).select("id"),
    "sc19_chunks": lambda s, d: cp.chunks(docs(s, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))).select("id", "chunk", "start", "end", F.sha2("text", 256).alias("h")),
    "sc23_transcript": lambda s, d: _transcript(s, d),
    "sc24_fetched_kind": _web_sources,
    "sc25_import_docs": lambda s, d: cp.import_docs(docs(s, d), 100),
    "sc26_due_sources": _due,
    "sc27_session_sweep": lambda s, d: cp.sweep(table(s, d, "conversations").withColumn("text", F.repeat("text", 3))),
    "sc27_pack_paragraphs": lambda s, d: cp.pack_paragraphs(docs(s, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest")),
    "sc35_jn20_snapshot_merge": _snapshots,
    "jn21_lww": lambda s, d: sync.merge_lww(_ops(s, d, 0), _ops(s, d, 1)),
    "so11_map_merge": lambda s, d: sync.merge_maps(*_writers(s, d)).select("uri", F.explode("meta").alias("key", "value")),
    "jn4_active_memories": lambda s, d: docs(s, d).join(mm.active(memories(s, d)).select(F.col("doc_id").alias("id"), "memory_type"), "id").groupBy("memory_type").agg(F.count(F.lit(1)).alias("n")),
    "mm4_wn9_memory_state": lambda s, d: mm.state(memories(s, d)).select("doc_id", "id", "memory_type"),
    "mm2_promote": lambda s, d: mm.promote(memories(s, d), docs(s, d).filter("id % 7 = 0").select(F.col("id").alias("doc_id"), F.lit("lesson").alias("memory_type"), (F.col("id") % 12 / 10.0).alias("confidence"))).groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("c")),
    "mm3_supersede": lambda s, d: mm.supersede(memories(s, d), memories(s, d).filter("doc_id % 5 = 0").select(F.col("id").alias("old_id"), (F.col("doc_id") * 2).alias("new_id"))).select("id", "superseded_by"),
    "jn12_without_raw": lambda s, d: mm.without_raw(docs(s, d), memories(s, d)).select("id"),
    "jn11_without_vector": lambda s, d: docs(s, d).join(vectors(s, d), "id", "left_anti").select("id"),
    "jn14_semi_scope": lambda s, d: events(s, d).join(docs(s, d).filter("lang = 'fr'").select(F.concat(F.lit("mem://"), F.col("id").cast("string")).alias("uri")), "uri", "left_semi").select("event_id"),
    "jn16_similar_pairs": lambda s, d: mm.similar_pairs(docs(s, d), 0.8),
    "jn16_text_groups": lambda s, d: mm.text_groups(docs(s, d)),
    "mm8_compact": lambda s, d: mm.compact(docs(s, d), 0.8),
    "mm7_evolve": lambda s, d: mm.evolve(docs(s, d), docs(s, d), 0.5, 1.1),
    "mm5_recall": lambda s, d: _recall(s, d),
    "mm5_recall_hops": lambda s, d: _recall(s, d, hops=2),
    "mm5_recall_ppr": lambda s, d: _recall(s, d, ppr=True),
    "mm6_pipeline_recall": lambda s, d: _r(mm.pipeline_recall(docs(s, d), memories(s, d), "eringble and then thined", 10, floor=0.1), "score", "grade"),
    "mm11_corpus_search": lambda s, d: mm.corpus_search(docs(s, d), "eringble nichtch", 10),
    "ma20_mmr": lambda s, d: mm.mmr(_candidates(s, d), 5),
    "ag15_evaluate": lambda s, d: _r(mm.evaluate(*_gold(s, d)), "recall", "mrr", "false_recall"),
    "ag16_gate": lambda s, d: mm.gate(_gold(s, d)[0], _gold(s, d)[1], _gold(s, d)[1].withColumn("id", F.col("id") + 1), 10),
    "ag17_latency": lambda s, d: _r(mm.latency_report(events(s, d).select(F.col("kind").alias("category"), F.col("value").alias("ms"))), "p50", "p95"),
    "ag26_wn14_libsvm": lambda s, d: ln.libsvm(_click_log(s, d)),
    "ud3_rewards": lambda s, d: ln.rewards(events(s, d).select("kind", (F.col("event_id") % 3 == 0).cast("int").alias("hit")), arm="kind"),
    "st9_sweep": lambda s, d: ln.sweep_unaccepted(events(s, d).select("ts", F.when(F.col("event_id") % 2 == 0, F.lit(1)).alias("accepted")), NOW, 86400),
    "ma21_corrections": lambda s, d: _r(ln.corrections(events(s, d).select((F.col("event_id") % 101 / 100.0).alias("score"), (F.col("event_id") % 3 == 0).alias("good"))), "correction"),
    "ag19_drift": lambda s, d: _r(ln.drift(vectors(s, d), vectors(s, d).withColumn("embedding", F.transform("embedding", lambda x: x * 2)), 100), "mean_cosine"),
    "xt21_to_embed": lambda s, d: ln.to_embed(docs(s, d), docs(s, d).filter("id % 2 = 0").select(F.sha2("text", 256).alias("hash"))).select("hash"),
    "vs28_xt13_hash_embedding": lambda s, d: ln.hash_embedding(docs(s, d).select("id", "text")).select("id", F.size("embedding").alias("dim")),
    "so5_sf9_simhash": lambda s, d: pk.with_simhash(docs(s, d)).select("id", "simhash"),
    "cx1_pack": lambda s, d: pk.pack(_candidates(s, d)).select("qid", "position", "id", "tier", "tokens"),
    "cx2_pack_delta": lambda s, d: pk.pack_delta(_candidates(s, d), docs(s, d).filter("id % 5 = 0")).select("qid", "position", "id", "tier", "tokens"),
    "cx3_render": lambda s, d: pk.render(pk.pack(_candidates(s, d)), 2000),
    "ag20_savings": lambda s, d: pk.savings(_candidates(s, d), pk.pack(_candidates(s, d))),
    "cx5_state": lambda s, d: pk.state_of(memories(s, d), 40).select("id", "doc_id", "memory_type"),
    "so8_delta_ids": lambda s, d: docs(s, d).join(docs(s, d).filter("id % 5 = 0").select("id"), "id", "left_anti").select("id"),
    "jn22_cx9_freshness": _fresh,
    "jn9_tags_for_doc": lambda s, d: tg.tags_of(tag_rows(s, d)[1], 4),
    "jn9_docs_for_tag": lambda s, d: tg.docs_of(tag_rows(s, d)[1], "lang:de"),
    "jn10_tag_usage": lambda s, d: tg.usage(*tag_rows(s, d)),
    "ag9_tag_stats": lambda s, d: tg.stats(*tag_rows(s, d)),
    "jn13_orphan_tags": lambda s, d: tg.orphans(*tag_rows(s, d)),
    "cx10_merge_tags": lambda s, d: tg.merge(tag_rows(s, d)[1], "src:src2", "lang:en"),
    "sf26_tag_rules": lambda s, d: tg.apply_rules(docs(s, d), _rules(s)),
    "ag5_store_stats": lambda s, d: ev.stats(docs=docs(s, d), vecs=vectors(s, d)),
    "ag11_health": lambda s, d: ev.health(docs(s, d), vectors(s, d), memories(s, d)),
    "jn24_shard_fanout": lambda s, d: _r(_shards(s, d), "score"),
    "xt8_set_embedding": lambda s, d: _set_embedding(s, d),
    "sl5_topk_per_group": lambda s, d: events(s, d).withColumn("r", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("value"), "event_id"))).filter("r <= 3").select("agent", "r", "event_id"),
    "mm16_hierarchy": lambda s, d: docs(s, d).select("id", F.split("uri", "/")[0].alias("wing"), F.split("uri", "/")[1].alias("drawer")).groupBy("wing").agg(F.count(F.lit(1)).alias("drawers")),
    "xt17_ingest_extract": lambda s, d: _extract(s, d),
}


def _transcript(s, d):
    from recollex.functions import text as tx

    vtt = F.concat(F.lit("WEBVTT\n\n1\n00:00.000 --> 00:02.000\n"), F.col("text"), F.lit("\n\n2\n00:02.000 --> 00:04.000\nend "), "role")
    c = table(s, d, "conversations").withColumn("text", F.regexp_replace("text", r"[^A-Za-z ]", ""))
    return c.select("conv_id", "turn", tx.transcript_text(vtt).alias("said"), tx.video_id(F.lit("https://youtu.be/abcdefghijk")).alias("video"))


def _shards(s, d):
    parts = [ft.search(docs(s, d).filter(F.col("id") % 2 == i), ANY, 20).join(docs(s, d).select("id", "uri"), "id") for i in range(2)]
    return sync.merge_shards(parts, 20)


def _set_embedding(s, d):
    v = vectors(s, d)
    new = v.filter("id % 10 = 0").select("id", F.transform("embedding", lambda x: (x * 0).cast("float")).alias("new"))
    return v.join(new, "id", "left").select("id", F.round(F.aggregate(F.coalesce("new", "embedding"), F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("s"))


def _extract(s, d):
    from recollex.functions import text as tx

    kept = cp.put(table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))
    return kept.select("id", tx.memory_type(F.col("text"))[0].alias("memory_type"))


_CAND = "cand AS (SELECT doc_id // 50 AS qid, doc_id AS id, text FROM documents)"
_LONG = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 2))"
_JAC = "CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END"
_PAIR = f"t AS (SELECT doc_id AS id, {_LONG} AS w FROM documents), pairs AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) WHERE len(a.w) > 0 AND {_JAC} >= 0.8)"
_FIRST = "first AS (SELECT sha256(text) AS hash, min(doc_id) AS id FROM documents GROUP BY text)"
_GOLD = "gold AS (SELECT doc_id AS qid FROM documents), m AS (SELECT qid, i + 1 AS rank, (qid % 9 = i)::INT AS hit FROM gold, (SELECT unnest(range(0, 7)) AS i))"
ORACLE_SQL = {
    "sc13_put": f"WITH {_FIRST} SELECT id, hash FROM first",
    "sc14_put_batch_ids": f"WITH {_FIRST} SELECT doc_id AS arrival, id FROM documents JOIN first ON sha256(text) = hash",
    "so4_content_dedup": "SELECT DISTINCT sha256(text) AS hash FROM documents",
    "ag10_duplicates": "SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "sc17_delete": "SELECT doc_id AS id FROM documents WHERE lang <> 'de'",
    "sc19_chunks": """WITH p AS (SELECT doc_id AS id, string_split(text, chr(10)) AS p FROM documents), x AS (SELECT id, unnest(p) AS raw, unnest(range(0, len(p)))::INT AS chunk FROM p),
s AS (SELECT *, coalesce(sum(strlen(raw) + 2) OVER (PARTITION BY id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(raw) - strlen(ltrim(raw)) AS start FROM x)
SELECT id, chunk, start::BIGINT AS start, (start + strlen(trim(raw)))::BIGINT AS "end", sha256(trim(raw)) AS h FROM s WHERE trim(raw) <> ''""",
    "sc23_transcript": "WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM conversations) SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN '' ELSE trim(t) || ' ' END || 'end ' || role AS said, 'abcdefghijk' AS video FROM c",
    "sc24_fetched_kind": "SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'pdf' ELSE 'html' END AS kind FROM pages",
    "sc25_import_docs": f"WITH {DOCS} SELECT id, uri, title, ts // 1000 AS published_ts FROM docs ORDER BY ts DESC, id DESC LIMIT 100",
    "sc26_due_sources": "WITH r AS (SELECT c_custkey AS id, c_custkey % 50 * 10 AS interval, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 3 END AS last_sync FROM customer) SELECT * FROM r WHERE \"interval\" > 0 AND coalesce(last_sync, 0) + \"interval\" <= 1000 ORDER BY coalesce(last_sync, 0), id LIMIT 100",
    "sc27_session_sweep": "WITH m AS (SELECT conv_id, turn, role, repeat(text, 3) AS t FROM conversations WHERE trim(text) <> ''), s AS (SELECT *, unnest(CASE WHEN length(t) > 1000 THEN range(0, length(t), 350) ELSE [0] END) AS s FROM m) SELECT conv_id, turn, (s // 350)::INT AS part, '[' || role || '|msg' || turn || '] ' || CASE WHEN length(t) > 1000 THEN substr(t, s + 1, 400) ELSE t END AS text FROM s",
    "sc35_jn20_snapshot_merge": f"WITH {DOCS}, x AS (SELECT uri, title, text, meta, sha256(text) AS hash, id FROM docs) SELECT uri, CASE WHEN id % 3 <> 0 THEN title ELSE 'other' END AS title, text, CASE WHEN id % 4 = 0 AND id % 2 <> 0 THEN NULL WHEN id % 3 <> 0 AND id % 2 <> 0 AND id % 4 = 0 THEN NULL ELSE meta END AS meta, hash FROM x WHERE id % 3 <> 0 OR id % 4 <> 0",
    "jn21_lww": f"WITH {EVENTS}, o AS (SELECT lpad(event_id::VARCHAR, 10, '0') AS op_id, kind, event_id % 700 AS doc_id, ts % 1000 AS ts, content AS payload FROM ev) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, op_id DESC) = 1",
    "so11_map_merge": f"WITH {DOCS}, w AS (SELECT uri, 'actor' || i AS actor, id * (i + 1) % 17 AS ts, i, id, lang, source FROM docs, (SELECT unnest([0, 1, 2]) AS i) WHERE id % 3 <> i), e AS (SELECT uri, actor, ts, 'k' || i AS key, lang AS value FROM w UNION ALL SELECT uri, actor, ts, 'shared', 'v' || i || '-' || source FROM w) SELECT uri, key, arg_max(value, (ts, actor)) AS value FROM e GROUP BY uri, key",
    "jn4_active_memories": f"WITH {MEMORIES} SELECT memory_type, count(*) AS n FROM memories WHERE superseded_by IS NULL GROUP BY 1",
    "mm4_wn9_memory_state": f"WITH {MEMORIES} SELECT doc_id, id, memory_type FROM memories QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY superseded_by IS NOT NULL, updated_ts DESC, id DESC) = 1",
    "mm2_promote": f"WITH {MEMORIES}, p AS (SELECT CASE WHEN hit THEN 'lesson' ELSE memory_type END AS memory_type, CASE WHEN hit THEN doc_id % 12 / 10.0 ELSE confidence END AS confidence FROM (SELECT *, doc_id % 7 = 0 AND doc_id % 12 <= 10 AND superseded_by IS NULL AND memory_type = 'raw' AS hit FROM memories)) SELECT memory_type, count(*) AS n, round(sum(confidence), 6) AS c FROM p GROUP BY 1",
    "mm3_supersede": f"WITH {MEMORIES} SELECT id, CASE WHEN doc_id % 5 = 0 AND id <> doc_id * 2 THEN doc_id * 2 ELSE superseded_by END AS superseded_by FROM memories",
    "jn12_without_raw": f"WITH {MEMORIES} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM memories WHERE memory_type = 'raw' AND superseded_by IS NULL)",
    "jn11_without_vector": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "jn14_semi_scope": f"WITH {EVENTS} SELECT event_id FROM ev WHERE uri IN (SELECT 'mem://' || doc_id FROM documents WHERE lang = 'fr')",
    "jn16_similar_pairs": f"WITH t0 AS (SELECT doc_id AS id, list_sort({_LONG}) AS w FROM documents), t AS (SELECT min(id) AS id, w FROM t0 GROUP BY w) SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.id < b.id AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) WHERE len(a.w) > 0 AND {_JAC} >= 0.8",
    "jn16_text_groups": f"WITH t AS (SELECT doc_id AS id, list_sort({_LONG}) AS w FROM documents) SELECT id, min(id) OVER (PARTITION BY w) AS rep FROM t WHERE len(w) > 0",
    "mm8_compact": f"WITH RECURSIVE {_PAIR}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), walk(id, c) AS (SELECT DISTINCT x, x FROM e UNION SELECT id, y FROM walk JOIN e ON x = c) SELECT id, max(c) AS survivor FROM walk GROUP BY id",
    "mm7_evolve": f"WITH t AS (SELECT doc_id AS id, {_LONG} AS w FROM documents), j AS (SELECT a.id, b.id AS old, {_JAC} AS j FROM t a, (SELECT * FROM t ORDER BY id DESC LIMIT 64) b WHERE a.id <> b.id) SELECT id, arg_max(old, (j, -old)) AS replaces FROM j WHERE j BETWEEN 0.5 AND 1.1 GROUP BY id",
    "ag15_evaluate": f"WITH {_GOLD}, p AS (SELECT qid, max(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS f, min(rank) FILTER (hit = 1) AS first, count(*) FILTER (rank <= 5) AS shown, count(*) FILTER (rank <= 5 AND hit = 0) AS wrong FROM m GROUP BY qid) SELECT round(avg(f), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(sum(wrong) / sum(shown), 6) AS false_recall FROM p",
    "ag17_latency": f"WITH {EVENTS}, r AS (SELECT kind AS category, value AS ms, row_number() OVER (PARTITION BY kind ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM ev) SELECT category, n, round(max(ms) FILTER (i = n // 2), 6) AS p50, round(max(ms) FILTER (i = least(floor(n * 0.95::DOUBLE), n - 1)), 6) AS p95 FROM r GROUP BY category, n",
    "ud3_rewards": f"WITH {EVENTS} SELECT kind AS arm, sum((event_id % 3 = 0)::INT)::BIGINT AS wins, sum((event_id % 3 <> 0)::INT)::BIGINT AS losses FROM ev GROUP BY kind",
    "st9_sweep": "SELECT 1::BIGINT AS misses",
    "ma21_corrections": f"WITH e AS (SELECT event_id % 101 / 100.0::DOUBLE AS score, (event_id % 3 = 0)::INT AS good FROM events) SELECT least(greatest(floor(score * 10), 0), 9)::BIGINT AS bucket, round(avg(good) / nullif(avg(score), 0), 6) AS correction FROM e GROUP BY 1",
    "xt21_to_embed": "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "vs28_xt13_hash_embedding": "SELECT doc_id AS id, 64 AS dim FROM documents",
    "cx5_state": f"WITH {MEMORIES} SELECT id, doc_id, memory_type FROM memories WHERE superseded_by IS NULL AND memory_type IN ('fact', 'decision') ORDER BY updated_ts DESC, id DESC LIMIT 40",
    "so8_delta_ids": "SELECT doc_id AS id FROM documents WHERE doc_id % 5 <> 0",
    "jn22_cx9_freshness": "SELECT p_partkey AS id, p_size AS have, CASE WHEN p_partkey % 4 <> 0 THEN p_size + p_partkey % 2 END AS latest, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 2 = 1 THEN 'outdated' ELSE 'current' END AS status FROM part",
    "jn9_tags_for_doc": f"WITH {DOCS}, {TAGS} SELECT tag FROM doc_tags WHERE doc_id = 4",
    "jn9_docs_for_tag": f"WITH {DOCS}, {TAGS} SELECT DISTINCT doc_id FROM doc_tags WHERE tag = 'lang:de'",
    "jn10_tag_usage": f"WITH {DOCS}, {TAGS} SELECT tag, count(doc_id) AS n FROM tags LEFT JOIN doc_tags USING (tag) GROUP BY tag",
    "ag9_tag_stats": f"WITH {DOCS}, {TAGS} SELECT tag, count(doc_id) AS n FROM tags LEFT JOIN doc_tags USING (tag) GROUP BY tag ORDER BY n DESC, tag LIMIT 10",
    "jn13_orphan_tags": f"WITH {DOCS}, {TAGS} SELECT tag FROM tags WHERE tag NOT IN (SELECT tag FROM doc_tags)",
    "cx10_merge_tags": f"WITH {DOCS}, {TAGS} SELECT DISTINCT doc_id, CASE WHEN tag = 'src:src2' THEN 'lang:en' ELSE tag END AS tag FROM doc_tags",
    "sf26_tag_rules": "SELECT doc_id, 'a' AS tag FROM documents WHERE contains(lower(text), 'eringble') UNION SELECT doc_id, 'b' FROM documents WHERE contains(lower(text), 'nichtch')",
    "ag5_store_stats": "SELECT 'docs' AS name, count(*) AS n FROM documents UNION ALL SELECT 'vecs', count(*) FROM embeddings",
    "xt8_set_embedding": "SELECT vec_id AS id, round(CASE WHEN vec_id % 10 = 0 THEN 0 ELSE list_sum(list_transform(embedding, lambda x: x::DOUBLE)) END, 5) AS s FROM embeddings",
    "sl5_topk_per_group": f"WITH {EVENTS} SELECT agent, row_number() OVER (PARTITION BY agent ORDER BY value DESC, event_id)::INT AS r, event_id FROM ev QUALIFY r <= 3",
    "mm16_hierarchy": "SELECT source AS wing, count(*) AS drawers FROM documents GROUP BY source",
    "xt17_ingest_extract": "WITH k AS (SELECT min(conv_id * 1000 + turn) AS id, text FROM conversations GROUP BY text) SELECT id, CASE WHEN regexp_matches(lower(text), 'decided|chose|we will') THEN 'decision' WHEN regexp_matches(lower(text), 'learned|turns out|lesson') THEN 'lesson' WHEN regexp_matches(lower(text), 'prefer|likes|hates') THEN 'preference' ELSE 'fact' END AS memory_type FROM k",
}
