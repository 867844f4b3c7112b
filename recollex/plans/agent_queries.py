"""Agents' tools, sources read back, clustered search, and composed retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.functions import text as tx
from recollex.operators import agent as ag, corpus as cp, fusion, gazetteer as gz, graph as g, predicates as pr, vectors as vs
from recollex.plans.models import DOCS, EVENTS, VECTORS, docs, events, graph, memories, vectors
from recollex.plans.search_queries import _ANY_TERMS, _COS, _D64, _Q, ANY, _bm25, query_vector, token_rows
from recollex.session import table
from recollex.sources import files, snapshots
from recollex.storage import materialize, new_path


def _r(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _files(s, d, fmt):
    """Documents written in a format and read again."""
    path = f"{new_path(s, 'file')}.{fmt}"
    files.write_documents(docs(s, d), path)
    return files.read_documents(s, path).select("uri", F.length("text").alias("n"), F.sha2(F.translate("text", "\r", ""), 256).alias("h"))


def _snapshot(s, d):
    path = new_path(s, "snapshot")
    snapshots.export(s, {"docs": docs(s, d), "vectors": vectors(s, d)}, path)
    return snapshots.restore(s, path)["docs"].select("id", F.sha2("text", 256).alias("h"))


def _mentions(s, d):
    rows = docs(s, d)
    return rows, rows.select("id", F.explode(tx.entities(F.col("text"))).alias("entity"))


def _hippo(s, d):
    mentions = materialize(_mentions(s, d)[1], "mentions")
    return _r(ag.hippo_retrieve(mentions, None, "Thntblere", 10, rounds=3), "score")


def _memory_edges(s, d):
    return memories(s, d).select(F.col("id").alias("from_id"), (F.col("id") * 7 % 900).alias("to_id"), F.lit("rel").alias("rel"), (F.col("id") % 5 + 1).cast("double").alias("weight"))


def _ivf(s, d):
    path = new_path(s, "ivf")
    centres = vs.ivf_build(vectors(s, d), 8, path)
    return _r(vs.ivf_search(s, path, centres, query_vector(s, d), 10, probes=8), "distance")


def _rss(s, d):
    pages = table(s, d, "pages")
    item = F.concat(F.lit("<item><title><![CDATA[t"), "page_id", F.lit("]]></title><link>http://x/"), "page_id", F.lit("</link><description>a &amp; b</description></item>"))
    feeds = pages.select(F.col("url").alias("uri"), F.concat(F.lit("<rss><channel>"), item, item, F.lit("</channel></rss>")).alias("body"))
    return cp.rss_items(feeds).select("uri", "n", "title", "link", "guid", "text")


def _polled(s, d):
    """Pages as items of feeds by site, polled in two rounds of a stream that is started anew between them."""
    from recollex.sources import feeds as fd

    s.dataSource.register(fd.PolledFeeds)
    home = new_path(s, "feeds")
    pages = table(s, d, "pages").withColumn("feed", F.col("page_id") % 20)
    item = F.concat(F.lit("<item><title>t"), "page_id", F.lit("</title><link>"), "url", F.lit("</link></item>"))
    pages.select("feed", item.alias("value")).repartition("feed").write.partitionBy("feed").text(f"{home}/bodies")
    pages.select("feed").distinct().select(F.col("feed").alias("id"), F.concat(F.lit(f"{home}/bodies/feed="), "feed").alias("uri"), (F.col("feed") * 10).alias("interval")).write.parquet(f"{home}/registry")
    for second in (30, 60):
        s.createDataFrame([(str(second),)], "value string").coalesce(1).write.mode("overwrite").text(f"{home}/clock")
        stream = s.readStream.format("polled_feeds").option("registry", f"{home}/registry").option("clock", f"{home}/clock").load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{home}/state").trigger(once=True).start(f"{home}/out").awaitTermination()
    polled = s.read.parquet(f"{home}/out")
    return cp.rss_items(polled.select(F.concat_ws(" ", "id", "polled").alias("uri"), "body")).select("uri", "title", "link")


def _sessions(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", "text")


def _hits(s, d):
    k = F.element_at(F.array(F.lit("fact"), F.lit("lesson"), F.lit("code")), (F.col("id") % 3 + 1).cast("int"))
    return docs(s, d).select("id", "title", "text", k.alias("kind"), (F.col("id") % 41 / 41.0).alias("score"))


def _kinds(s, column, values):
    return s.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias(column)) for k, v in values.items()])))


def _queue(s, d):
    q = events(s, d).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "done").otherwise("pending").alias("status"), (F.col("event_id") % 4).cast("int").alias("attempts"))
    return ag.settle(q, ag.next_batch(q, 50).select("id", (F.col("id") % 2 == 0).alias("ok")))


def _names(s, d):
    """Names of two and of three words from the benchmark's items, as documents have them: (name, documents, times)."""
    words = tx.tokens(F.col("text"))
    items = table(s, d, "benchmark").select(F.explode(F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (2, 3)])).alias("name"), F.lit("item").alias("kind"))
    found = gz.find(docs(s, d).select("id", "text"), items)
    return found.groupBy(F.lower("text").alias("name")).agg(F.countDistinct("id").alias("documents"), F.count(F.lit(1)).alias("times"))


def _table_functions(s, d):
    """By SQL functions over the graph: each node's edges in and out, and how far it is from node 1."""
    ag.register_graph_functions(s, graph(s, d), "customers")
    return s.sql("""
        WITH nodes AS (SELECT DISTINCT from_id AS id FROM customers_edges),
        outs AS (SELECT n.id, count(*) AS n_out FROM nodes n, LATERAL customers_out(n.id) o GROUP BY n.id),
        ins AS (SELECT n.id, count(*) AS n_in FROM nodes n, LATERAL customers_in(n.id) i GROUP BY n.id)
        SELECT outs.id, n_out, coalesce(n_in, 0) AS n_in, coalesce(h.depth, -1) AS depth FROM outs LEFT JOIN ins ON ins.id = outs.id LEFT JOIN customers_hops(1, 8) h ON h.id = outs.id""")


def _fusion(s, d):
    t = token_rows(s, d)
    return _r(ag.full_fusion(vectors(s, d), vs.sparse_encode(docs(s, d)), t, query_vector(s, d), {"eringble": 1.0, "thined": 0.5}, t.filter("id = 0 and token < 4"), 10), "score")


def _cross(s, d):
    """Every label's mean vector against all vectors."""
    means = vectors(s, d).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("embedding")).select(F.col("label").cast("long").alias("qid"), "embedding")
    return _r(vs.knn_join(queries, vectors(s, d), 3, dim=64), "distance")


def _sql_functions(s, d):
    ag.register_functions(s)
    docs(s, d).select("id", F.col("text").alias("t")).createOrReplaceTempView("_match_docs")
    return s.sql("select id, round(semantic_match(t, t), 6) as same, semantic_match(t, 'other') between 0 and 1 as inside from _match_docs")


QUERIES = {
    "sc3_csv": lambda s, d: _files(s, d, "csv"),
    "sc3_tsv": lambda s, d: _files(s, d, "tsv"),
    "sc4_jsonl": lambda s, d: _files(s, d, "jsonl"),
    "sc6_parquet": lambda s, d: _files(s, d, "parquet"),
    "sc20_rss": _rss,
    "st6_polled_feeds": _polled,
    "sc34_snapshot": _snapshot,
    "xt1_search_lex": lambda s, d: _r(ag.search(docs(s, d), "lex", ANY, 10), "score"),
    "xt1_search_vec": lambda s, d: _r(ag.search(docs(s, d), "vec", "", 10, vecs=vectors(s, d), query_vector=query_vector(s, d)), "score"),
    "xt1_search_hybrid_where": lambda s, d: _r(ag.search(docs(s, d), "hybrid", ANY, 10, vecs=vectors(s, d), query_vector=query_vector(s, d), where=pr.eq("lang", "en")), "score"),
    "sf18_gazetteer_names": _names,
    "aj10_ud5_table_functions": _table_functions,
    "sf18_so10_tiered_entities": lambda s, d: ag.tiered_entities(docs(s, d), {"thntblere": "name", "eringble": "name"}).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "gr13_hippo": _hippo,
    "gr15_relate_triples": lambda s, d: _r(ag.relate_triples(events(s, d).select(F.col("agent").alias("subject"), F.upper("kind").alias("rel"), F.col("session_id").alias("object"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 15 / 10.0).alias("confidence"))), "weight"),
    "gr17_ground": lambda s, d: _r(ag.ground(docs(s, d), memories(s, d), _memory_edges(s, d), ANY), "score"),
    "cx4_context_pack": lambda s, d: ag.context_pack(_hits(s, d), "eringble thined", bonuses=_kinds(s, "bonus", {"fact": 0.02})).select("position", "id", "tier", "tokens"),
    "sl14_rank_hits": lambda s, d: _r(ag.rank_hits(_hits(s, d), _kinds(s, "prior", {"fact": 0.1, "code": 0.05}), _kinds(s, "bonus", {"lesson": 0.03})).select("id", "score"), "score"),
    "cx6_session_log": lambda s, d: ag.session_log(_sessions(s, d)).select("session_id", "n", F.sha2("text", 256).alias("h")),
    "cx6_session_replay": lambda s, d: ag.session_replay(_sessions(s, d), 100).select("session_id", "turn", "used"),
    "cx7_ft7_index_in_scope": lambda s, d: ag.index_in_scope(docs(s, d), "eringble thined", "src1", 20).select("id", "score"),
    "mm9_queue": _queue,
    "mm12_promotions": lambda s, d: ag.ready_promotions(events(s, d).select((F.col("event_id") % 400).alias("chunk_id"), F.lit("memory").alias("kind"), F.when(F.col("kind") == "view", "verified").otherwise("queued").alias("status"), (F.col("ts") * 100000 + F.col("event_id")).alias("ts"))),
    "vs15_vs16_ag21_ivf": _ivf,
    "vs22_late_two_stage": lambda s, d: _r(ag.late_two_stage(token_rows(s, d), token_rows(s, d).filter("id = 3 and token < 5"), 64, 20, 5), "score"),
    "vs24_full_fusion": _fusion,
    "vs27_jn25_cross_modal": _cross,
    "vs18_shards": lambda s, d: ag.shards_for(ag.shard_table(docs(s, d), docs(s, d).select("id", (F.col("id") % 6).alias("shard"))), ["eringble"]),
    "pf20_ud5_sql_functions": _sql_functions,
    "wn5_rrf_two": lambda s, d: _r(fusion.rrf([fusion.ranked(vs.knn(vectors(s, d), query_vector(s, d), 30), "dense", by="distance", descending=False), fusion.ranked(vs.int8_knn(vectors(s, d), query_vector(s, d), 30), "i8")], k=20.0), "score"),
    "ag25_mean_pool": lambda s, d: _r(vectors(s, d).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")), "m"),
    "aj10_graph_views": lambda s, d: _views(s, d),
}


def _views(s, d):
    ag.register_graph_views(s, graph(s, d))
    return s.sql("select n.from_id, d.n, count(*) as edges from graph_neighbors n join graph_degree d using (from_id) join graph_pagerank p on p.id = n.from_id group by n.from_id, d.n")


_READ = f"WITH {DOCS} SELECT uri, length(text)::INT AS n, sha256(replace(text, chr(13), '')) AS h FROM docs WHERE trim(text) <> ''"
ORACLE_SQL = {
    "sc3_csv": _READ, "sc3_tsv": _READ, "sc4_jsonl": _READ, "sc6_parquet": _READ,
    "st6_polled_feeds": "WITH f AS (SELECT page_id % 20 AS feed, page_id, url FROM pages), r AS (SELECT 30 AS polled UNION ALL SELECT 60) SELECT feed || ' ' || polled AS uri, 't' || page_id AS title, url AS link FROM f, r WHERE feed > 0 AND (polled = 30 OR 60 // (feed * 10) > 30 // (feed * 10))",
    "sc20_rss": "SELECT url AS uri, n::INT AS n, 't' || page_id AS title, 'http://x/' || page_id AS link, 'http://x/' || page_id AS guid, 'a & b' AS text FROM pages, (SELECT unnest([0, 1]) AS n)",
    "sc34_snapshot": "SELECT doc_id AS id, sha256(text) AS h FROM documents",
    "xt1_search_lex": f"WITH {DOCS}, {_bm25(_ANY_TERMS, 1, 10)} SELECT id, round(score, 6) AS score FROM hits",
    "xt1_search_vec": f"WITH {VECTORS}, {_Q} SELECT id, round(1 / (1 + d), 6) AS score FROM (SELECT id, {_COS} AS d FROM vectors, q) ORDER BY round(d, 9), id LIMIT 10",
    "gr15_relate_triples": f"WITH {EVENTS} SELECT agent AS from_entity, session_id AS to_entity, kind AS rel, round(max(least(greatest(CASE WHEN event_id % 2 = 0 THEN event_id % 15 / 10.0::DOUBLE ELSE 0.5 END, 0.1), 1.0)), 6) AS weight FROM ev GROUP BY 1, 2, 3",
    "sl14_rank_hits": "SELECT doc_id AS id, round(doc_id % 41 / 41.0::DOUBLE + CASE doc_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.03 ELSE 0.05 END, 6) AS score FROM documents",
    "cx6_session_log": "SELECT conv_id::VARCHAR AS session_id, count(*)::INT AS n, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS h FROM conversations GROUP BY conv_id",
    "mm9_queue": "WITH q AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'pending' END AS status, (event_id % 4)::INT AS attempts FROM events), b AS (SELECT id, id % 2 = 0 AS ok FROM q WHERE status = 'pending' AND attempts < 3 ORDER BY id LIMIT 50) SELECT id, CASE WHEN ok THEN 'done' ELSE status END AS status, attempts + coalesce((NOT ok)::INT, 0) AS attempts FROM q LEFT JOIN b USING (id)",
    "mm12_promotions": f"WITH {EVENTS}, p AS (SELECT event_id % 400 AS chunk_id, arg_max(kind, ts * 100000 + event_id) AS k FROM ev GROUP BY 1) SELECT chunk_id, 'memory' AS kind FROM p WHERE k = 'view'",
    "vs15_vs16_ag21_ivf": f"WITH {VECTORS}, {_Q} SELECT id, round(d, 6) AS distance FROM (SELECT id, {_COS} AS d FROM vectors, q) ORDER BY round(d, 9), id LIMIT 10",
    "vs27_jn25_cross_modal": f"WITH m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2), q AS (SELECT label AS qid, list(x ORDER BY i) AS v FROM m GROUP BY label), p AS (SELECT qid::BIGINT AS qid, vec_id AS id, 1 - list_cosine_similarity(v, {_D64}) AS d FROM q, embeddings) SELECT qid, rank::INT AS rank, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM p) WHERE rank <= 3",
    "vs18_shards": "WITH h AS (SELECT DISTINCT doc_id % 6 AS shard FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 'eringble')) SELECT shard FROM h UNION SELECT doc_id % 6 FROM documents WHERE NOT EXISTS (SELECT 1 FROM h)",
    "pf20_ud5_sql_functions": "SELECT doc_id AS id, 1.0::DOUBLE AS same, true AS inside FROM documents",
    "ag25_mean_pool": "SELECT label, i::INT AS i, round(avg(x::DOUBLE), 6) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2",
}
