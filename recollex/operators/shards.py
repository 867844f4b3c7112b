"""Shards' metadata: Bloom filters of their tokens and centroids; adjacency in rows of offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.operators.ordering import with_positions

RATE = 0.01


def _places(token: Column, bits: Column, hashes: int) -> Column:
    """Bit numbers of a token, one for each hash."""
    return F.array(*[F.pmod(F.xxhash64(token, F.lit(i)), bits) for i in range(hashes)])


def hash_count(rate: float = RATE) -> int:
    return max(1, round(-math.log2(rate)))


def bloom(tokens: DataFrame, *, rate: float = RATE) -> DataFrame:
    """(shard, bits, word, mask): a Bloom filter for each shard of (shard, token), as rows of 64-bit words that have a bit.

    The number of bits follows the shard's distinct tokens, so a stranger passes with the chance ``rate``.
    """
    distinct = tokens.select("shard", "token").distinct()
    sizes = distinct.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) * (-math.log(rate) / math.log(2) ** 2) + 64).cast("long").alias("bits"))
    at = distinct.join(F.broadcast(sizes), "shard").select("shard", "bits", F.explode(_places(F.col("token"), F.col("bits"), hash_count(rate))).alias("bit"))  # one row a shard
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    return at.groupBy("shard", "bits", F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(one).alias("mask"))


def may_hold(filters: DataFrame, asked: DataFrame, *, rate: float = RATE) -> DataFrame:
    """(shard, token): shards whose filter passes the token; asked: (token)."""
    hashes = hash_count(rate)
    sizes = filters.select("shard", "bits").distinct()
    probes = asked.distinct().crossJoin(F.broadcast(sizes)).select("shard", "token", F.explode(F.array_distinct(_places(F.col("token"), F.col("bits"), hashes))).alias("bit"))  # one row a shard
    probes = probes.select("shard", "token", F.floor(F.col("bit") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int")).alias("one"))
    need = probes.groupBy("shard", "token", "word").agg(F.bit_or("one").alias("need"))
    met = need.join(filters.select("shard", "word", "mask"), ["shard", "word"], "left")
    return met.groupBy("shard", "token").agg(F.bool_and(F.coalesce(F.col("mask").bitwiseAND(F.col("need")) == F.col("need"), F.lit(False))).alias("passes")).filter("passes").select("shard", "token")


def centroids(vectors: DataFrame, *, shard: str = "shard") -> DataFrame:
    """(shard, n, centroid): the mean vector of each shard."""
    parts = vectors.select(F.col(shard).alias("shard"), F.posexplode("embedding").alias("i", "x")).groupBy("shard", "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy("shard").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("centroid"))


def adjacency(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compact adjacency: (id, first, degree) of nodes with edges, (at, to_id, rel_id, weight) of edges, and (rel_id, rel).

    A node's edges are those from ``first`` on, ``degree`` of them, heaviest first.
    """
    rels = with_positions(edges.select("rel").distinct(), "rel", position="rel_id").withColumn("rel_id", F.col("rel_id") - 1)
    placed = with_positions(edges.join(F.broadcast(rels), "rel"), "from_id", F.desc("weight"), "to_id", "rel", position="at").withColumn("at", F.col("at") - 1)  # a few kinds
    nodes = placed.groupBy(F.col("from_id").alias("id")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("degree"))
    return nodes, placed.select("at", "to_id", "rel_id", "weight"), rels.select("rel_id", "rel")


def edges_of(nodes: DataFrame, edges: DataFrame, rels: DataFrame, ids: list[int]) -> DataFrame:
    """(from_id, to_id, rel, weight) of some nodes, by their offsets."""
    own = nodes.filter(F.col("id").isin(ids)).select(F.col("id").alias("from_id"), F.explode(F.sequence("first", F.col("first") + F.col("degree") - 1)).alias("at"))
    return own.join(edges, "at").join(F.broadcast(rels), "rel_id").select("from_id", "to_id", "rel", "weight")
