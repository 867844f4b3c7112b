"""Tools that agents call: search in one call, grounding, context, sessions, observations, queues."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.functions import text as tx
from recollex.operators import fulltext, fusion, gazetteer as gz, graph, packing, predicates as pr, vectors
from recollex.storage import small

MODES = ("lex", "vec", "hybrid")


def search(docs: DataFrame, mode: str, query: str, limit: int, *, vecs: DataFrame | None = None, query_vector: list[float] | None = None, where: pr.Predicate | None = None) -> DataFrame:
    """(id, score) by one of three modes; the filter is applied before ranking, so full pages come back."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    if mode != "lex" and (vecs is None or not query_vector):
        raise ValueError(f"mode {mode} needs vectors and a query vector")
    if where is not None:
        docs = pr.filtered(docs, where)
        vecs = vecs.join(docs.select("id"), "id", "left_semi") if vecs is not None else None
    if mode == "lex":
        return fulltext.search(docs, query, limit)
    near = vectors.knn(vecs, query_vector, limit if mode == "vec" else 3 * limit)
    if mode == "vec":
        return near.select("id", (1 / (1 + F.col("distance"))).alias("score"))
    legs = [fusion.ranked(fulltext.search(docs, query, 3 * limit), "fts"), fusion.ranked(near, "vec", by="distance", descending=False)]
    return fusion.rrf(legs, limit)


# --- entities and grounding -------------------------------------------------


#: Kinds of entities that are told by their shape.
SHAPES = (("email", r"[\w.+-]+@[\w-]+\.[\w.-]*\w"), ("url", r"https?://[^\s<>\"]+"), ("date", r"\b\d{4}-\d{2}-\d{2}\b"), ("pair", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"))


def tiered_entities(docs: DataFrame, gazetteer: DataFrame | dict[str, str]) -> DataFrame:
    """(id, start, end, kind, text): names of the gazetteer (name, kind), leftmost-longest and without case, addresses, urls, dates, capitalised pairs; a span inside a longer one drops out."""
    if isinstance(gazetteer, dict):
        gazetteer = docs.sparkSession.createDataFrame(list(gazetteer.items()), "name string, kind string")
    out = gz.find(docs, gazetteer)
    for kind, pattern in SHAPES:
        shaped = docs.select("id", F.inline(gz.spans(pattern)))
        out = out.unionByName(shaped.select("id", "start", "end", F.lit(kind).alias("kind"), "text"))
    return gz.outermost(out, "id").select("id", "start", "end", "kind", "text")


def hippo_retrieve(mentions: DataFrame, edges: DataFrame | Callable[[DataFrame], DataFrame] | None, query: str, k: int, *, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(id, score): documents by PageRank personalised to the query's entities.

    mentions: (id, entity); edges: (from_entity, to_entity, weight), or a function
    from entities' numbers (id, XXH64) to the edges between numbers that leave them,
    such as ``graph.edges_of``; without edges walks go through shared documents
    (``graph.shared_walks``). All entities that hold a word of the query are seeds,
    all their partners are walked to. A document scores the best of its entities.
    """
    spark = mentions.sparkSession
    asked = spark.range(1).select(tx.entities(F.lit(query)).alias("e")).first()["e"] or query.split()
    names = mentions.select(F.col("entity").alias("name")).distinct()
    seeds = graph.like_entities(names, asked, None).select(F.xxhash64("name").alias("id"), F.lit(1.0).alias("score")).distinct()
    if edges is None:
        ranks = graph.shared_walks(graph.entity_rows(mentions), seeds, 1 - damping, rounds)
    else:
        numbered = edges if callable(edges) else edges.select(F.xxhash64("from_entity").alias("from_id"), F.xxhash64("to_entity").alias("to_id"), "weight")
        ranks = graph.personalized_pagerank(numbered, seeds, 1 - damping, rounds, least=0.0)
    hits = mentions.withColumn("e", F.xxhash64("entity")).join(small(ranks.withColumnRenamed("id", "e"), graph.BROADCAST_SCORES), "e")
    return hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def relate_triples(triples: DataFrame, fallback: float = 0.5) -> DataFrame:
    """Edges of extracted (subject, rel, object, confidence): weight within 0.1 and 1, the best of repeats."""
    weight = F.least(F.greatest(F.coalesce("confidence", F.lit(fallback)), F.lit(0.1)), F.lit(1.0))
    clean = lambda c: F.lower(F.trim(c))
    return triples.filter("trim(subject) <> '' and trim(object) <> ''").groupBy(clean("subject").alias("from_entity"), clean("object").alias("to_entity"), clean("rel").alias("rel")).agg(F.max(weight).alias("weight"))


def ground(docs: DataFrame, memories: DataFrame, edges: DataFrame, query: str, k: int = 8) -> DataFrame:
    """(kind, id, score): lexical seeds, what PageRank from their memories reaches, and what traversal of each finds.

    Edges join memories, so documents are turned into their memories first.
    """
    seeds = fulltext.search(docs, query, k)
    own = seeds.join(memories.filter("superseded_by is null").select(F.col("doc_id").alias("id"), F.col("id").alias("memory")), "id").select(F.col("memory").alias("id"), "score")
    spread = graph.personalized_pagerank(edges, own).orderBy(F.desc(F.round("score", 12)), "id").limit(k)
    near = graph.hops(edges, own, 2, cap=64).select("id", (1 / (1 + F.col("hop"))).alias("score")).orderBy(F.desc("score"), "id").limit(4 * k)
    name = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "score")
    return name(seeds, "seed").unionByName(name(spread, "ppr")).unionByName(name(near, "near"))


# --- context ----------------------------------------------------------------


def context_pack(hits: DataFrame, query: str, *, bonuses: DataFrame | None = None, budget: int = 2000, open_packs: int = 0) -> DataFrame:
    """Hits (id, title, text, kind, score) without noise, scored by bonus and overlap with the query, packed."""
    live = fusion.best_of_each(hits).filter(~pr.is_noise(F.col("text"), F.col("title")))
    score = F.col("score") + tx.grade(F.lit(query), F.col("text")) + tx.grade(F.lit(query), F.coalesce("title", F.lit("")))
    if bonuses is not None:
        live = live.join(bonuses, "kind", "left")
        score = score + F.coalesce("bonus", F.lit(0.0))
    rows = live.select(F.lit(0).cast("long").alias("qid"), "id", "kind", score.alias("score"), "text")
    return packing.pack(rows, packing.PackOptions(budget=packing.shrunk_budget(budget, open_packs)))


def rank_hits(hits: DataFrame, priors: DataFrame, bonuses: DataFrame) -> DataFrame:
    """Score plus the prior and the learned bonus of a hit's kind."""
    out = hits.join(priors, "kind", "left").join(bonuses, "kind", "left")
    return out.withColumn("score", F.col("score") + F.coalesce("prior", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).drop("prior", "bonus").orderBy(F.desc(F.round("score", 12)), "id")


def session_log(messages: DataFrame) -> DataFrame:
    """(session_id, n, text): a session's messages (session_id, turn, role, text) as one document."""
    ordered = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ms"))
    return ordered.select("session_id", F.size("ms").alias("n"), F.array_join(F.transform("ms", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("text"))


def session_replay(messages: DataFrame, budget: int) -> DataFrame:
    """Messages of each session in order until the budget of tokens is used."""
    rows = messages.withColumn("tokens", tx.estimate_tokens(F.col("text")))
    return fusion.take_while_fits(rows, budget, order=["turn"], group=["session_id"])


def observe(docs: DataFrame, new: DataFrame, scope: str) -> DataFrame:
    """Observations (text, ts) of a scope added to the documents, once each."""
    rows = new.select(F.concat(F.lit(scope + "/"), tx.short_id(F.col("text"))).alias("uri"), "text", "ts")
    return docs.unionByName(rows.dropDuplicates(["uri"]).join(docs.select("uri"), "uri", "left_anti"), allowMissingColumns=True)


def index_in_scope(docs: DataFrame, query: str, scope: str, limit: int) -> DataFrame:
    """Documents of a scope that hold any term, joined with its newest, ranked."""
    inside = docs.filter(F.startswith("uri", F.lit(scope)))
    terms = [r["t"] for r in docs.sparkSession.range(1).select(F.explode(tx.agent_terms(F.lit(query))).alias("t")).collect()]
    low = F.lower(F.concat_ws(" ", "title", "text"))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(low, F.lit(t))
    pool = max(12 * limit, 80)
    found = inside.filter(hit).orderBy(F.desc("id")).limit(pool).unionByName(inside.orderBy(F.desc("ts"), F.desc("id")).limit(pool)).dropDuplicates(["id"])
    return fusion.agent_rank(found, query, terms, limit)


# --- queues -----------------------------------------------------------------


def next_batch(queue: DataFrame, n: int, most_attempts: int = 3) -> DataFrame:
    """The oldest open entries (id, status, attempts)."""
    return queue.filter((F.col("status") == "pending") & (F.col("attempts") < most_attempts)).orderBy("id").limit(n)


def settle(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Queue after results (id, ok): done, or pending with one more attempt."""
    done = results.select("id", "ok")
    return queue.join(done, "id", "left").select("id", F.when(F.col("ok"), "done").otherwise(F.col("status")).alias("status"), (F.col("attempts") + F.coalesce((~F.col("ok")).cast("int"), F.lit(0))).alias("attempts"))


def ready_promotions(promotions: DataFrame) -> DataFrame:
    """Newest state of each chunk's promotion (chunk_id, kind, status, ts) where that is verified."""
    last = promotions.groupBy("chunk_id", "kind").agg(F.max_by("status", "ts").alias("status"))
    return last.filter("status = 'verified'").select("chunk_id", "kind")


# --- routing ----------------------------------------------------------------


@dataclass
class Router:
    """Picks a search strategy by recall seen and time taken; strategies have a least size of the corpus."""

    strategies: dict[str, int] = field(default_factory=lambda: {"exact": 0, "int8": 1000, "signs": 5000, "cascade": 5000, "ivf": 20000})
    hits: dict[str, list[int]] = field(default_factory=dict)
    times: dict[str, float] = field(default_factory=dict)

    def observe(self, name: str, right: int, of: int, ms: float) -> None:
        good, bad = self.hits.get(name, [1, 1])
        self.hits[name] = [good + right, bad + of - right]
        self.times[name] = ms if name not in self.times else 0.7 * self.times[name] + 0.3 * ms

    def pick(self, corpus: int, target: float) -> str:
        """The quickest strategy whose recall is believed to reach the target; exact search if none."""
        fit = [n for n, least in self.strategies.items() if corpus >= least and (n == "exact" or (n in self.hits and self.hits[n][0] / sum(self.hits[n]) >= target))]
        return min(fit, key=lambda n: (self.times.get(n, 0.0 if n == "exact" and len(fit) == 1 else float("inf")), n))


# --- composed vector searches -----------------------------------------------


def late_two_stage(doc_tokens: DataFrame, query_tokens: DataFrame, dim: int, pool: int, k: int) -> DataFrame:
    """Nearest by one vector a document, then by tokens."""
    fde = vectors.bucket_sums(doc_tokens, dim).withColumnRenamed("fde", "embedding")
    asked = vectors.bucket_sums(query_tokens.withColumn("id", F.lit(0).cast("long")), dim).first()["fde"]
    near = vectors.knn(fde, list(asked), pool, metric="dot").select("id")
    return vectors.max_sim(query_tokens, doc_tokens.join(F.broadcast(near), "id")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)  # pool ids


def full_fusion(dense: DataFrame, sparse: DataFrame, doc_tokens: DataFrame, query_vector: list[float], query_terms: dict[str, float], query_tokens: DataFrame, k: int) -> DataFrame:
    """A hundred by vector and a hundred by terms, fused to fifty, then by tokens."""
    legs = [fusion.ranked(vectors.knn(dense, query_vector, 100), "dense", by="distance", descending=False), fusion.ranked(vectors.sparse_search(sparse, query_terms, 100), "sparse")]
    pool = fusion.rrf(legs, 50).select("id")
    return vectors.max_sim(query_tokens, doc_tokens.join(F.broadcast(pool), "id")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)  # fifty ids


def shard_table(docs: DataFrame, shards: DataFrame) -> DataFrame:
    """(shard, token): which tokens each shard has, exactly. shards: (id, shard)."""
    return docs.join(shards, "id").select("shard", F.explode(tx.tokens(F.col("text"))).alias("token")).distinct()


def shards_for(table: DataFrame, terms: list[str]) -> DataFrame:
    """Shards with any of the terms; all if there is none."""
    hit = table.filter(F.col("token").isin(terms)).select("shard").distinct()
    return table.select("shard").distinct() if hit.isEmpty() else hit


# --- functions for SQL ------------------------------------------------------


def _hash_vector(text: str, dim: int = 32) -> np.ndarray:
    v = np.random.default_rng(packing.fnv1a((text or "").encode())).standard_normal(dim)
    return v / np.linalg.norm(v)


def register_functions(spark: SparkSession) -> None:
    """semantic_match(a, b): 1 for equal texts, within 0 and 1 for others, by hashed vectors; a stand-in for a model."""
    @F.pandas_udf("double")
    def semantic_match(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float((1 + _hash_vector(x) @ _hash_vector(y)) / 2) for x, y in zip(a, b, strict=True)])

    spark.udf.register("semantic_match", semantic_match)


def register_graph_views(spark: SparkSession, edges: DataFrame) -> None:
    """Views over the graph for SQL: graph_neighbors, graph_degree, graph_pagerank."""
    edges.createOrReplaceTempView("graph_neighbors")
    edges.groupBy("from_id").agg(F.count(F.lit(1)).alias("n")).createOrReplaceTempView("graph_degree")
    graph.pagerank(edges, rounds=10).createOrReplaceTempView("graph_pagerank")


def register_graph_functions(spark: SparkSession, edges: DataFrame, prefix: str) -> None:
    """Functions for SQL that return tables, named after ``prefix``, so that several graphs of a session stay apart.

    ``<prefix>_out(node)`` and ``<prefix>_in(node)``: a node's edges;
    ``<prefix>_between(node, least)``: those of at least a weight, both ways;
    ``<prefix>_hops(start, most)``: (id, depth) of what is reached along edges in at
    most so many steps, with the fewest steps. Arguments may come from other tables
    by LATERAL, but for those of hops.
    """
    if not re.fullmatch(r"[a-z][a-z0-9_]*", prefix):
        raise ValueError("a prefix is lower-case letters, digits and _")
    view = f"{prefix}_edges"
    edges.select("from_id", "to_id", "rel", "weight").createOrReplaceTempView(view)
    row = "from_id BIGINT, to_id BIGINT, rel STRING, weight DOUBLE"
    made = "CREATE OR REPLACE TEMPORARY FUNCTION"
    spark.sql(f"{made} {prefix}_out(node BIGINT) RETURNS TABLE ({row}) RETURN SELECT from_id, to_id, rel, weight FROM {view} WHERE from_id = node")
    spark.sql(f"{made} {prefix}_in(node BIGINT) RETURNS TABLE ({row}) RETURN SELECT from_id, to_id, rel, weight FROM {view} WHERE to_id = node")
    spark.sql(f"{made} {prefix}_between(node BIGINT, least DOUBLE) RETURNS TABLE ({row}) RETURN SELECT from_id, to_id, rel, weight FROM {view} WHERE (from_id = node OR to_id = node) AND weight >= least")
    spark.sql(f"""{made} {prefix}_hops(start BIGINT, most INT) RETURNS TABLE (id BIGINT, depth INT) RETURN
        WITH RECURSIVE walk(id, depth) AS (SELECT start, 0 UNION ALL SELECT DISTINCT e.to_id, w.depth + 1 FROM walk w JOIN {view} e ON e.from_id = w.id WHERE w.depth < most)
        SELECT id, min(depth) FROM walk GROUP BY id""")


def top_per(hits: DataFrame, group: str, n: int, by: Column) -> DataFrame:
    return hits.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(by, "id"))).filter(F.col("_r") <= n).drop("_r")
