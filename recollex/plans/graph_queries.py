"""Graph operators over the customers' graph and the decisions' graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.functions.text import entities
from recollex.operators import cypher, datalog, events as ev, graph as g
from recollex.plans.models import DECISIONS, DOCS, EVENTS, GRAPH, decisions, docs, graph


def _seeds(spark):
    return spark.range(1).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).alias("id"))


def _ancestors(spark, sf_dir):
    p = datalog.Program(spark)
    p.add_facts("edge", graph(spark, sf_dir).filter("rel = 'CAUSED'").select("from_id", "to_id"))
    p.add_rule("reach(X, Y) :- edge(X, Y).")
    p.add_rule("reach(X, Z) :- reach(X, Y), edge(Y, Z).")
    p.run()
    return p


def _updates(spark, sf_dir):
    e = graph(spark, sf_dir)
    return e.filter("from_id % 10 = 0").select("from_id", "to_id", "rel", (F.col("weight") + 1).alias("weight"), F.lit(1).alias("seq"))


def _sightings(spark, sf_dir):
    from recollex.plans.models import events

    return events(spark, sf_dir).select("uri", "kind", F.when(F.col("event_id") % 3 == 0, F.col("agent")).alias("title"), (F.col("ts") * 100000 + F.col("event_id")).alias("ts"))


def _decision_edges(spark, sf_dir):
    return ev.decisions_graph(decisions(spark, sf_dir))[1]


def _chain(spark, sf_dir):
    """Each document replaced by the next, in chains of 120; one runs into a circle."""
    d = docs(spark, sf_dir).select("id")
    return d.select(F.col("id").alias("from_id"), F.when(F.col("id") == 150, F.lit(140).cast("long")).otherwise(F.col("id") + 1).alias("to_id")).filter("from_id % 120 <> 119")


_R = lambda df, *c: df.withColumns({x: F.round(x, 6) for x in c})
QUERIES = {
    "gr1_relate": lambda s, d: _R(g.relate(graph(s, d), _updates(s, d)), "weight"),
    "gr2_upsert_nodes": lambda s, d: g.upsert_nodes(_sightings(s, d)),
    "gr3_edge_counts": lambda s, d: graph(s, d).groupBy("from_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("w")),
    "gr4_sl8_neighbors": lambda s, d: _R(g.neighbors(graph(s, d), 5, 10), "weight"),
    "gr5_traverse": lambda s, d: _R(g.traverse(graph(s, d), 1, 3, 5, 0.8), "score").select("id", "depth", "score"),
    "gr6_why": lambda s, d: g.why(_decision_edges(s, d), "goal://7", 3),
    "gr7_expand": lambda s, d: g.expand(_decision_edges(s, d), "mem://5", 3),
    "gr8_dot": lambda s, d: g.dot(_decision_edges(s, d), g.expand(_decision_edges(s, d), "mem://5", 3)),
    "gr9_shortest_path": lambda s, d: g.shortest_path(graph(s, d), 1, 255, 8).select(F.round("cost", 6).alias("cost"), F.array_join("path", ">").alias("path")),
    "gr10_pagerank": lambda s, d: _R(g.pagerank(graph(s, d), 0.85, 4), "score"),
    "sl9_pagerank_top": lambda s, d: _R(g.pagerank(graph(s, d), 0.85, 4).orderBy(F.desc(F.round("score", 12)), "id").limit(10), "score"),
    "gr11_personalized": lambda s, d: _R(g.personalized_pagerank(graph(s, d), _seeds(s).withColumn("score", F.lit(1.0)), 0.15, 3), "score"),
    "gr12_communities": lambda s, d: g.communities(graph(s, d), 5).select("id", "label"),
    "sl10_community_sizes": lambda s, d: g.communities(graph(s, d), 5).groupBy("label").agg(F.count(F.lit(1)).alias("members")).orderBy(F.desc("members"), "label"),
    "gr16_hops": lambda s, d: g.hops(graph(s, d), _seeds(s), 3, cap=64),
    "gr19_cypher_match": lambda s, d: cypher.run(graph(s, d), "MATCH (a)-[:CAUSED*1..3]->(b) WHERE id(a) = 1 RETURN b LIMIT 20"),
    "gr19_cypher_one_hop": lambda s, d: cypher.run(graph(s, d), "MATCH (a)-[r]->(b) WHERE id(a) = 4 RETURN b"),
    "gr20_jn23_datalog_closure": lambda s, d: _ancestors(s, d).query("reach"),
    "ag14_datalog_aggregate": lambda s, d: _ancestors(s, d).aggregate("reach", 0, 1, "max"),
    "gr21_supersession": lambda s, d: g.supersession(_chain(s, d)),
    "gr14_jn18_entity_graph": lambda s, d: _R(g.entity_graph(docs(s, d)), "weight"),
    "sf17_entities": lambda s, d: docs(s, d).select("id", F.explode(entities(F.col("text"))).alias("entity")),
    "so7_components": lambda s, d: g.components(graph(s, d).filter("rel = 'CAUSED'")),
    "so1_nodes": lambda s, d: graph(s, d).select(F.col("from_id").alias("id")).union(graph(s, d).select("to_id")).distinct(),
    "so2_recursive_views": lambda s, d: g.expand(_decision_edges(s, d), "dec://11", 20),
    "aj9_graph_json": lambda s, d: g.to_json(g.neighbors(graph(s, d), 5, 10).withColumn("w", (F.col("weight") * 10).cast("int")), "to_id", "rel", "w"),
    "jn5_like_entities": lambda s, d: g.like_entities(docs(s, d).select(F.col("title").alias("name")).distinct(), ["the", "ing"], 10),
}

_DE = "de AS (SELECT source_uri AS from_uri, uri AS to_uri FROM decisions WHERE source_uri IS NOT NULL UNION SELECT uri, target_uri FROM decisions WHERE source_uri IS NOT NULL)"


def _walk(start: str, depth: int, here: str, there: str) -> str:
    return f"""WITH RECURSIVE {EVENTS}, {DECISIONS}, {_DE}, walk(uri, depth) AS (SELECT uri, 0 FROM (SELECT from_uri AS uri FROM de UNION SELECT to_uri FROM de) WHERE uri = '{start}' UNION SELECT {there}, depth + 1 FROM walk JOIN de ON {here} = uri WHERE depth + 1 < {depth})
SELECT uri, min(depth)::INT AS depth FROM walk GROUP BY uri"""


def _pagerank(rounds: int) -> str:
    parts = [f"{GRAPH}, nodes AS (SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges), n AS (SELECT count(*) AS n FROM nodes), f AS (SELECT from_id, to_id, sum(weight) AS w FROM edges GROUP BY 1, 2), flow AS (SELECT from_id, to_id, w / sum(w) OVER (PARTITION BY from_id) AS share FROM f), r0 AS (SELECT id, 1.0 / n AS score FROM nodes, n)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT nodes.id, 0.15 / n + 0.85 * (SELECT coalesce(sum(score), 0) FROM r{i} WHERE id NOT IN (SELECT from_id FROM flow)) / n + 0.85 * coalesce(came, 0) AS score FROM nodes CROSS JOIN n LEFT JOIN (SELECT to_id, sum(score * share) AS came FROM r{i} JOIN flow ON id = from_id GROUP BY to_id) ON to_id = nodes.id)")
    return ", ".join(parts)


def _ppr(rounds: int) -> str:
    parts = [f"{GRAPH}, f AS (SELECT from_id, to_id, sum(weight) AS w FROM edges GROUP BY 1, 2), flow AS (SELECT from_id, to_id, w / sum(w) OVER (PARTITION BY from_id) AS share FROM f), seed AS (SELECT unnest([1, 2])::BIGINT AS id, 0.5 AS home), r0 AS (SELECT id, home AS score FROM seed)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT id, sum(s) AS score FROM (SELECT to_id AS id, 0.85 * score * share AS s FROM r{i} JOIN flow ON id = from_id WHERE score >= 1e-9 UNION ALL SELECT id, (0.15 + 0.85 * (SELECT coalesce(sum(score), 0) FROM r{i} WHERE score >= 1e-9 AND id NOT IN (SELECT from_id FROM flow))) * home FROM seed) GROUP BY id)")
    return ", ".join(parts)


ORACLE_SQL = {
    "gr1_relate": f"WITH {GRAPH} SELECT from_id, to_id, rel, round(CASE WHEN from_id % 10 = 0 THEN weight + 1 ELSE weight END, 6) AS weight FROM edges",
    "gr2_upsert_nodes": f"WITH {EVENTS}, o AS (SELECT uri, kind, CASE WHEN event_id % 3 = 0 THEN agent END AS title, ts * 100000 + event_id AS ts FROM ev) SELECT uri, arg_min(kind, ts) AS kind, arg_max(title, ts) FILTER (title IS NOT NULL) AS title, min(ts) AS first_seen, max(ts) AS last_seen FROM o GROUP BY uri",
    "gr3_edge_counts": f"WITH {GRAPH} SELECT from_id, count(*) AS n, round(sum(weight), 6) AS w FROM edges GROUP BY from_id",
    "gr4_sl8_neighbors": f"WITH {GRAPH} SELECT to_id, rel, round(weight, 6) AS weight FROM edges WHERE from_id = 5 ORDER BY weight DESC, to_id LIMIT 10",
    "gr6_why": _walk("goal://7", 3, "to_uri", "from_uri"),
    "gr7_expand": _walk("mem://5", 3, "from_uri", "to_uri"),
    "so2_recursive_views": _walk("dec://11", 20, "from_uri", "to_uri"),
    "gr9_shortest_path": f"WITH RECURSIVE {GRAPH}, walk(id, cost, path, n) AS (SELECT 1::BIGINT, 0.0::DOUBLE, '1', 0 UNION ALL SELECT to_id, cost + greatest(1 - weight, 0), path || '>' || to_id, n + 1 FROM walk JOIN edges ON from_id = id WHERE n < 8) SELECT round(cost, 6) AS cost, path FROM walk WHERE id = 255 ORDER BY round(cost, 12), path LIMIT 1",
    "gr10_pagerank": f"WITH {_pagerank(4)} SELECT id, round(score, 6) AS score FROM r4",
    "sl9_pagerank_top": f"WITH {_pagerank(4)} SELECT id, round(score, 6) AS score FROM r4 ORDER BY round(r4.score, 12) DESC, id LIMIT 10",
    "gr11_personalized": f"WITH {_ppr(3)} SELECT id, round(score, 6) AS score FROM r3",
    "gr16_hops": f"WITH RECURSIVE {GRAPH}, walk(id, hop) AS (SELECT unnest([1, 2])::BIGINT, 0 UNION SELECT to_id, hop + 1 FROM walk JOIN edges ON from_id = id WHERE hop < 3) SELECT id, min(hop)::INT AS hop FROM walk GROUP BY id",
    "gr19_cypher_match": f"WITH RECURSIVE {GRAPH}, walk(id, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT to_id, hop + 1 FROM walk JOIN edges ON from_id = id AND rel = 'CAUSED' WHERE hop < 3) SELECT id, min(hop)::INT AS hop FROM walk WHERE id <> 1 GROUP BY id ORDER BY hop, id LIMIT 20",
    "gr19_cypher_one_hop": f"WITH {GRAPH} SELECT to_id AS id, 1 AS hop FROM edges WHERE from_id = 4 ORDER BY weight DESC, to_id LIMIT 10",
    "gr20_jn23_datalog_closure": f"WITH RECURSIVE {GRAPH}, reach(c0, c1) AS (SELECT from_id, to_id FROM edges WHERE rel = 'CAUSED' UNION SELECT c0, to_id FROM reach JOIN edges ON from_id = c1 AND rel = 'CAUSED') SELECT c0::VARCHAR AS c0, c1::VARCHAR AS c1 FROM reach",
    "ag14_datalog_aggregate": f"WITH RECURSIVE {GRAPH}, reach(c0, c1) AS (SELECT from_id, to_id FROM edges WHERE rel = 'CAUSED' UNION SELECT c0, to_id FROM reach JOIN edges ON from_id = c1 AND rel = 'CAUSED') SELECT c0::VARCHAR AS key, max(c1)::DOUBLE AS value FROM reach GROUP BY c0",
    "sf17_entities": "SELECT DISTINCT doc_id AS id, e AS entity FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ɏ]', '0', 'g'), '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)) AS e FROM documents) WHERE length(e) >= 3",
    "gr14_jn18_entity_graph": "WITH r AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(regexp_replace(text, '[À-ɏ]', '0', 'g'), '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)) AS e FROM documents), k AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM r WHERE length(e) >= 3) SELECT a.e AS from_entity, b.e AS to_entity, round(sum(1 / sqrt(a.n)), 6) AS weight FROM k a JOIN k b ON a.id = b.id AND a.e <> b.e GROUP BY 1, 2",
    "so1_nodes": f"WITH {GRAPH} SELECT from_id AS id FROM edges UNION SELECT to_id FROM edges",
    "so7_components": f"WITH RECURSIVE {GRAPH}, b AS (SELECT from_id AS x, to_id AS y FROM edges WHERE rel = 'CAUSED' UNION SELECT to_id, from_id FROM edges WHERE rel = 'CAUSED'), walk(id, c) AS (SELECT DISTINCT x, x FROM b UNION SELECT id, y FROM walk JOIN b ON x = c) SELECT id, min(c) AS component FROM walk GROUP BY id",
    "jn5_like_entities": f"WITH {DOCS}, p AS (SELECT DISTINCT t AS term, title AS name FROM docs, (SELECT unnest(['the', 'ing']) AS t) WHERE contains(lower(title), t)) SELECT term, name FROM p QUALIFY row_number() OVER (PARTITION BY term ORDER BY length(name), name) <= 10",
}
