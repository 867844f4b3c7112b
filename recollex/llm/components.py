"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.storage import Scratch

MAX_ROUNDS = 64


def components(edges: DataFrame, *, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    Each round joins every node's larger neighbours to its smallest neighbour,
    then its smaller ones; the number of edges never grows, and rounds grow with
    the logarithm of the longest chain. Rounds are written to the shared folder.
    A star around one node is aggregated in parts before its rows meet, and only
    its minimum is joined back.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter("a <> b").distinct()
    pairs = scratch.write(pairs, "round0")
    for number in range(1, MAX_ROUNDS + 1):
        # Large star: u's neighbours above u get u's smallest neighbour, u included.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # Small star: u's neighbours below u, and u, get the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        after = scratch.write(small, f"round{number}")
        # Sums tell most rounds apart; only equal ones are compared row by row.
        same = [x.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first() for x in (pairs, after)]
        done = same[0] == same[1] and after.join(pairs, ["a", "b"], "left_anti").isEmpty()
        pairs = after
        scratch.drop(f"round{number - 1}")
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
