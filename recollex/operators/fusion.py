"""Rank fusion and orderings of ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.functions.scores import type_weight
from recollex.operators.ordering import with_positions

K = 60.0


def ranked(hits: DataFrame, leg: str, *, by: str = "score", key: str = "id", group: list[str] | None = None, descending: bool = True) -> DataFrame:
    """(group..., key, leg, rank): positions in a list from 1; ties go to the smaller key."""
    order = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc(by) if descending else F.asc(by), key)
    return hits.select(*(group or []), key, F.lit(leg).alias("leg"), F.row_number().over(order).alias("rank"))


def rrf(lists: list[DataFrame], limit: int | None = None, *, k: float = K, weights: dict[str, float] | None = None, key: str = "id", group: list[str] | None = None, sources: bool = False) -> DataFrame:
    """Reciprocal rank fusion: (group..., key, score[, source]), best first, ties to the smaller key."""
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    weight = F.lit(1.0)
    for leg, w in (weights or {}).items():
        weight = F.when(F.col("leg") == leg, w).otherwise(weight)
    aggregates = [F.sum(weight / (F.lit(k) + F.col("rank"))).alias("score")]
    if sources:
        aggregates.append(F.when(F.count_distinct("leg") > 1, "both").otherwise(F.min("leg")).alias("source"))
    fused = both.groupBy(*(group or []), key).agg(*aggregates)
    if limit is None:
        return fused
    if group:
        order = Window.partitionBy(*group).orderBy(F.desc(F.round("score", 12)), key)
        return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return fused.orderBy(F.desc(F.round("score", 12)), key).limit(limit)


def rrf_typed(lists: list[DataFrame], types: DataFrame, weights: dict[str, float], limit: int, *, k: float = K, key: str = "id") -> DataFrame:
    """Fusion weighted by list and by the type of each key; types: (key, memory_type)."""
    fused = rrf(lists, k=k, weights=weights, key=key)
    return fused.join(types, key, "left").withColumn("score", F.col("score") * type_weight(F.col("memory_type"))).orderBy(F.desc(F.round("score", 12)), key).limit(limit)


def rrf_blend(first: DataFrame, second: DataFrame, alpha: float, limit: int, **options) -> DataFrame:
    """Fusion of two lists that count (1 - alpha) and alpha."""
    return rrf([first.withColumn("leg", F.lit("first")), second.withColumn("leg", F.lit("second"))], limit, weights={"first": 1 - alpha, "second": alpha}, **options)


def serial_position(rank: Column) -> Column:
    """Place of a rank if the best stands first, the second-best last, and the rest between."""
    return F.when(rank == 1, F.lit(0)).when(rank == 2, F.lit(2)).otherwise(F.lit(1))


def serial_order(blocks: DataFrame, *, rank: str = "rank") -> DataFrame:
    return with_positions(blocks, serial_position(F.col(rank)), rank).withColumn("position", F.col("position").cast("int"))


def cache_stable_order(blocks: DataFrame, previous: list[int], *, rank: str = "rank", key: str = "id") -> DataFrame:
    """Blocks used before come first, in the order they had then; the rest in serial order."""
    known = F.array_position(F.array(*[F.lit(x).cast("long") for x in previous]) if previous else F.array().cast("array<long>"), F.col(key).cast("long"))
    place = F.when(known > 0, F.lit(-1)).otherwise(serial_position(F.col(rank)))
    return with_positions(blocks, place, F.when(known > 0, known).otherwise(F.lit(0)), rank).withColumn("position", F.col("position").cast("int"))


def relative(hits: DataFrame, *, group: list[str] | None = None) -> DataFrame:
    """Add relevance: score over the greatest score of the list."""
    over = Window.partitionBy(*(group or [F.lit(0)]))
    return hits.withColumn("relevance", F.coalesce(F.col("score") / F.nullif(F.max("score").over(over), F.lit(0.0)), F.lit(0.0)))


def take_while_fits(hits: DataFrame, budget: int, *, cost: str = "tokens", order: list | None = None, group: list[str] | None = None) -> DataFrame:
    """Hits in order until one would exceed the budget, for each group or all in one."""
    order = order or [F.desc("score"), "id"]
    if not group:
        return with_positions(hits, *order, position="_position", total=cost).filter(F.col("used") <= budget).drop("_position")
    over = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("used", F.sum(cost).over(over)).filter(F.col("used") <= budget)


def best_of_each(hits: DataFrame, *, key: str = "id", score: str = "score") -> DataFrame:
    """One hit a key: that with the greatest score."""
    others = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.max_by(F.struct(*others), score).alias("h")).select(key, "h.*")


def hydrated(hits: DataFrame, docs: DataFrame, *, key: str = "id", order: str = "rank") -> DataFrame:
    """Documents of hits in the order of the hits; missing ones drop out. Text is fetched for these alone."""
    return docs.join(hits, key).orderBy(order)


def scoped_rank(hits: DataFrame, query: str, terms: list[str], limit: int) -> DataFrame:
    """1000 for the exact phrase, 10 for each term, and the score of the hit."""
    text = F.lower(F.concat_ws(" ", "title", "text"))
    exact = F.contains(text, F.lit(query.lower())).cast("int") * 1000
    present = F.lit(0)
    for term in terms:
        present = present + F.contains(text, F.lit(term)).cast("int")
    return best_of_each(hits).withColumn("score", exact + 10 * present + F.col("score")).orderBy(F.desc("score"), "id").limit(limit)


def agent_rank(docs: DataFrame, query: str, terms: list[str], limit: int) -> DataFrame:
    """A million for the exact phrase, ten thousand for each term, and newer (greater) ids first."""
    text = F.lower(F.concat_ws(" ", "title", "text"))
    overlap = F.lit(0)
    for term in terms:
        overlap = overlap + F.contains(text, F.lit(term)).cast("int")
    score = F.contains(text, F.lit(query.lower())).cast("long") * 1_000_000 + overlap.cast("long") * 10_000 + F.col("id")
    return docs.withColumn("score", score).orderBy(F.desc("score"), F.desc("id")).limit(limit)
