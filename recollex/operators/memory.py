"""Typed memories: state, promotion, supersession, recall, evolution, compaction, evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions import scores, text
from recollex.operators import fulltext, fusion, graph, vectors
from recollex.operators.ordering import with_positions
from recollex.operators.selection import select_ranks
from recollex.session import small_batches
from recollex.storage import materialize


def active(memories: DataFrame) -> DataFrame:
    return memories.filter("superseded_by is null")


def state(memories: DataFrame) -> DataFrame:
    """One memory a document: an active one before others, then the newest."""
    order = Window.partitionBy("doc_id").orderBy(F.col("superseded_by").isNotNull(), F.desc("updated_ts"), F.desc("id"))
    return memories.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def without_raw(docs: DataFrame, memories: DataFrame) -> DataFrame:
    """Documents without an active raw memory."""
    return docs.join(active(memories).filter("memory_type = 'raw'").select(F.col("doc_id").alias("id")), "id", "left_anti")


def promote(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Active raw memories of the documents in changes (doc_id, memory_type, confidence in [0, 1]) get the new type in place."""
    new = changes.filter(F.col("confidence").between(0, 1)).select("doc_id", F.col("memory_type").alias("_type"), F.col("confidence").alias("_conf"))
    joined = memories.join(new, "doc_id", "left")
    hit = F.col("_type").isNotNull() & F.col("superseded_by").isNull() & (F.col("memory_type") == "raw")
    return joined.withColumns({"memory_type": F.when(hit, F.col("_type")).otherwise(F.col("memory_type")), "confidence": F.when(hit, F.col("_conf")).otherwise(F.col("confidence"))}).select(*memories.columns)


def supersede(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mark memories as replaced by pairs (old_id, new_id); none replaces itself."""
    new = pairs.filter("old_id <> new_id").groupBy("old_id").agg(F.max("new_id").alias("_new"))
    return memories.join(new, memories["id"] == new["old_id"], "left").withColumn("superseded_by", F.coalesce("_new", "superseded_by")).select(*memories.columns)


@dataclass(frozen=True)
class RecallParams:
    query: str
    k: int = 10
    rerank_top: int = 20
    hops: int = 0
    ppr: bool = False
    now: int = 0


def recall(docs: DataFrame, memories: DataFrame, vecs: DataFrame | None, edges: DataFrame | None, params: RecallParams, query_vector: list[float] | None = None) -> DataFrame:
    """(id, score, memory_type, uri): fused legs, spread over memory edges, weighted by type and age.

    Documents that only the graph brings in are fetched like others.
    """
    pool = max(4 * max(params.k, params.rerank_top), 40)
    lists = [fusion.ranked(fulltext.search(docs, params.query, pool), "lex")]
    if vecs is not None and query_vector:
        lists.append(fusion.ranked(vectors.knn(vecs, query_vector, pool), "vec", by="distance", descending=False))
    base = fusion.rrf(lists, pool)
    legs, weights = [fusion.ranked(base, "base")], {"base": 1.0}
    if edges is not None and params.ppr:
        spread = graph.personalized_pagerank(edges, base.select("id", "score"))
        legs.append(fusion.ranked(spread.orderBy(F.desc("score"), "id").limit(200), "ppr"))
    elif edges is not None and params.hops:
        reached = graph.hops(edges, base.select("id"), params.hops, cap=64)
        for hop in range(1, params.hops + 1):
            legs.append(fusion.ranked(reached.filter(F.col("hop") == hop).withColumn("score", F.lit(1.0)).orderBy("id").limit(200), f"hop{hop}"))
            weights[f"hop{hop}"] = 0.6**hop
    types = state(active(memories)).select(F.col("doc_id").alias("id"), "memory_type", "updated_ts")
    fused = fusion.rrf(legs, k=60.0, weights=weights)
    weighted = fused.join(types, "id", "left").withColumn("score", F.col("score") * scores.type_weight(F.coalesce("memory_type", F.lit("raw"))))
    if params.now:
        weighted = weighted.withColumn("score", scores.recall_heat(F.col("score"), F.coalesce("updated_ts", F.lit(params.now)), params.now))
    top = weighted.orderBy(F.desc(F.round("score", 12)), "id").limit(params.k).select("id", "score", "memory_type")
    return top.join(docs.select("id", "uri", "text"), "id", "left")


def pipeline_recall(docs: DataFrame, memories: DataFrame, query: str, k: int, *, floor: float = 0.0, few: int = 3, **options) -> DataFrame:
    """Recall of each part of a query, again with an expanded query if there is little, fused; hits below the floor of relevance drop out."""
    spark = docs.sparkSession
    parts = spark.range(1).select(text.decompose(F.lit(query)).alias("p")).first()["p"] or [query]
    found = [recall(docs, memories, None, None, RecallParams(part, k, **options)).select("id", "score") for part in parts]
    if found[0].count() < few:
        wide = fulltext.Query(fulltext.compile_loose(f"a document that answers {query}").terms)
        found.append(fulltext.search(docs, wide, k))
    fused = fusion.rrf([fusion.ranked(f, f"part{i}") for i, f in enumerate(found)])
    graded = fused.join(docs.select("id", "text"), "id").withColumn("grade", text.grade(F.lit(query), F.col("text"))).filter(F.col("grade") >= floor)
    return graded.select("id", scores.grade_blend(F.col("score"), F.col("grade")).alias("score"), "grade").orderBy(F.desc(F.round("score", 12)), "id").limit(k)


def evolve(new: DataFrame, known: DataFrame, low: float, high: float, *, window: int = 64) -> DataFrame:
    """(id, replaces): for each new text the most similar of the ``window`` newest known ones within [low, high]."""
    small_batches(new.sparkSession)
    late = known.orderBy(F.desc("id")).limit(window).select(F.col("id").alias("old"), text.long_tokens(F.col("text")).alias("u")).orderBy(F.desc("old")).collect()  # window rows
    olds = [r["old"] for r in late]
    words = sorted({w for r in late for w in r["u"]})
    place = {w: i for i, w in enumerate(words)}
    held = np.zeros((len(words) + 1, len(late)), np.int32)  # the last row: words of none
    for j, r in enumerate(late):
        held[[place[w] for w in r["u"]], j] = 1
    sizes = held.sum(axis=0)
    named = pa.array(words, pa.string())

    @F.arrow_udf("array<double>")
    def overlap(tokens: pa.Array) -> pa.Array:
        """Jaccard's index of a row's set with each of the window's, 0 if both are empty."""
        n = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        at = pc.fill_null(pc.index_in(tokens.flatten(), value_set=named), len(words)).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(n))
        both = np.stack([held[at[i:j]].sum(axis=0) for i, j in zip(ends[:-1], ends[1:], strict=True)]) if len(n) else np.zeros((0, len(late)))
        union = n[:, None] + sizes[None] - both
        j = np.where(union > 0, both / np.maximum(union, 1), 0.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(late), pa.int32()), pa.array(j.ravel()))

    if not late:
        return new.select("id", F.col("id").alias("replaces")).limit(0)
    pairs = new.select("id", overlap(text.long_tokens(F.col("text"))).alias("_j")).select("id", F.posexplode("_j").alias("at", "j"))
    rows = pairs.filter(F.col("j").between(low, high)).withColumn("old", F.get(F.array(*[F.lit(o) for o in olds]), F.col("at")))
    return rows.filter(F.col("id") != F.col("old")).groupBy("id").agg(F.max_by("old", F.struct("j", (-F.col("old")).alias("o"))).alias("replaces"))


def text_groups(rows: DataFrame) -> DataFrame:
    """(id, rep): texts with the same set of tokens, under the smallest id of them; texts without tokens are in no group."""
    sets = rows.select("id", F.array_sort(text.long_tokens(F.col("text"))).alias("t")).filter(F.size("t") > 0).select("id", F.xxhash64("t").alias("h"), F.sha2(F.array_join("t", " "), 256).alias("s"))
    first = sets.groupBy("h", "s").agg(F.min("id").alias("rep"))
    return sets.join(first, ["h", "s"]).select("id", "rep")


def _least(size: Column, threshold: float) -> Column:
    """Tokens that a set of a size shares at least with any that is similar enough."""
    return F.ceil(size * threshold - 1e-9)


def _shared(size: Column, threshold: float) -> Column:
    """Tokens of their prefixes that two sets must share, by the size of the smaller: more for larger sets, whose next tokens are hardly more common."""
    steps = sum((size >= least).cast("int") for least in (16, 64, 256))
    return F.least(steps + 1, _least(size, threshold))


def _met(ordered: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets that share enough of their prefixes to be compared whole, the smaller first."""
    size = F.size("t")
    prefix = F.slice("t", F.lit(1), (size - _least(size, threshold) + _shared(size, threshold)).cast("int"))
    head = ordered.select("id", size.alias("size"), F.posexplode(prefix).alias("place", "token"))
    head = head.withColumn("step", F.floor(F.log("size") / -math.log(threshold) + 1e-9) if threshold < 1 else F.col("size"))
    short = head.select(F.col("id").alias("a"), F.col("size").alias("n"), F.col("place").alias("p"), "token", F.explode(F.array(F.col("step"), F.col("step") + 1)).alias("step"))
    long_ = head.select(F.col("id").alias("b"), F.col("size").alias("m"), F.col("place").alias("q"), "token", "step")
    n, m = F.col("n"), F.col("m")
    larger = (n < m) | ((n == m) & (F.col("a") < F.col("b")))
    most = F.least(n - F.col("p"), m - F.col("q")) + _shared(n, threshold) - 1  # shared tokens, if this is one of the first k
    enough = (n >= threshold * m) & (most >= threshold / (1 + threshold) * (n + m) - 1e-9)
    met = short.join(long_, ["token", "step"]).filter(larger & enough).groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("times"))
    return met.filter(F.col("times") >= _shared(n, threshold)).select("a", "b")


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): groups of texts (``text_groups``) whose token sets overlap by the threshold, by prefix filter.

    A group stands for all its copies, so copies make no pairs. Tokens are numbered
    from rare to common, and sets are sorted lists of numbers. Two sets of n and m
    tokens that overlap enough share k of the first n - ceil(threshold * n) + k for
    each k; only these are joined, so common tokens don't bring rows together, and
    k, which grows with the smaller set (``_shared``), tells chance meetings, which
    grow with the square of the rows, from near copies before any list is fetched.
    Sizes differ by the threshold at most: a set meets those as large or larger in
    its own class of sizes and the next, whose steps are the threshold. From the
    places of one of the first k shared tokens follows how much two sets can share
    at most, which drops most meetings within the join; what is left is compared
    whole.
    """
    sets = rows.select("id", F.array_sort(text.long_tokens(F.col("text"))).alias("t")).filter(F.size("t") > 0)
    sets = materialize(sets.withColumns({"h": F.xxhash64("t"), "s": F.sha2(F.array_join("t", " "), 256)}), "token-sets")
    first = sets.groupBy("h", "s").agg(F.min("id").alias("id")).select("id")
    one = sets.select("id", F.explode("t").alias("token"))
    often = one.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    numbered = with_positions(often, "n", "token", position="number").select("token", "number")
    ordered = one.join(numbered, "token").groupBy("id").agg(F.array_sort(F.collect_set("number")).alias("t")).join(first, "id", "left_semi")
    ordered = materialize(ordered, "ordered-tokens")  # read three times from here on
    met = _met(ordered, threshold)
    left, right = ordered.select(F.col("id").alias("a"), F.col("t").alias("ta")), ordered.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    found = met.join(left, "a").join(right, "b").filter(shared / (F.size("ta") + F.size("tb") - shared) >= threshold)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def compact(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, survivor): clusters of similar texts and the greatest id of each; texts like no other are left out."""
    groups = materialize(text_groups(rows), "text-groups")
    pairs = similar_pairs(rows, threshold).select(F.col("a").alias("from_id"), F.col("b").alias("to_id"))
    parts = graph.components(pairs).select(F.col("id").alias("rep"), "component")
    placed = groups.join(parts, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    best = placed.groupBy("component").agg(F.max("id").alias("survivor"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return placed.join(best, "component").select("id", "survivor")


def mmr(hits: DataFrame, k: int, *, weight: float = 0.72) -> DataFrame:
    """(qid, id, position): hits taken one after the other by relevance less similarity to those taken. hits: (qid, id, score, text), a pool a query."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        sets = [{t for t in str(x).lower().split() if len(t) > 2} for x in rows["text"]]
        top = rows["score"].max() or 1.0
        taken: list[int] = []
        left = list(range(len(rows)))
        while left and len(taken) < k:
            best = max(left, key=lambda i: (weight * rows["score"][i] / top - (1 - weight) * max((len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in taken), default=0.0), -i))
            taken.append(best)
            left.remove(best)
        return pd.DataFrame({"qid": rows["qid"].iloc[taken], "id": rows["id"].iloc[taken], "position": range(1, len(taken) + 1)})

    return hits.select("qid", "id", "score", "text").groupBy("qid").applyInPandas(run, "qid long, id long, position int")


def corpus_search(chunks: DataFrame, query: str, k: int, vecs: DataFrame | None = None, query_vector: list[float] | None = None) -> DataFrame:
    """Fused legs over three times the pool, then diversified."""
    lists = [fusion.ranked(fulltext.search(chunks, fulltext.compile_loose(query), 3 * k, fields=("text",)), "lex")]
    if vecs is not None and query_vector:
        lists.append(fusion.ranked(vectors.knn(vecs, query_vector, 3 * k), "vec", by="distance", descending=False))
    pool = fusion.rrf(lists, 3 * k).join(chunks.select("id", "text"), "id").withColumn("qid", F.lit(0).cast("long"))
    return mmr(pool, k)


# --- evaluation -------------------------------------------------------------


def evaluate(gold: DataFrame, rankings: DataFrame, *, at: int = 5) -> DataFrame:
    """(recall, mrr, false_recall), one row. gold: (qid, id); rankings: (qid, rank, id)."""
    marked = rankings.join(gold.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    per = marked.groupBy("qid").agg(
        F.max(F.when(F.col("rank") <= at, F.col("hit")).otherwise(0)).alias("found"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.count(F.when(F.col("rank") <= at, 1)).alias("shown"), F.count(F.when((F.col("rank") <= at) & (F.col("hit") == 0), 1)).alias("wrong"),
    )
    asked = gold.select("qid").distinct().join(per, "qid", "left")
    return asked.agg(
        F.avg(F.coalesce("found", F.lit(0))).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.coalesce(F.sum("wrong") / F.nullif(F.sum("shown"), F.lit(0)), F.lit(0.0)).alias("false_recall"),
    )


def gate(gold: DataFrame, baseline: DataFrame, candidate: DataFrame, least: int) -> DataFrame:
    """(passed,): the candidate beats the baseline in all three measures, over enough questions."""
    a = evaluate(gold, baseline).toDF("r0", "m0", "f0")
    b = evaluate(gold, candidate).toDF("r1", "m1", "f1")
    n = gold.select("qid").distinct().agg(F.count(F.lit(1)).alias("n"))
    return a.crossJoin(b).crossJoin(n).select(((F.col("r1") > F.col("r0")) & (F.col("m1") > F.col("m0")) & (F.col("f1") < F.col("f0")) & (F.col("n") >= least)).alias("passed"))  # one row each


def latency_report(runs: DataFrame) -> DataFrame:
    """(category, n, p50, p95): order statistics at n // 2 and int(0.95 n), exact. runs: (category, ms)."""
    n = F.col("n")
    return select_ranks(runs, ["category"], "ms", {"p50": F.floor(n / 2), "p95": F.least(F.floor(n * 0.95), n - 1)})
