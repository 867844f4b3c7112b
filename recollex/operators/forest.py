"""Near pairs of vectors by a forest of random projections with bounded leaves.

Each tree halves its nodes until none has more than ``leaf`` vectors: a node's
vectors are projected on a direction drawn from the node's own name, and the median
of the projections (a mergeable sketch) parts them. All trees and nodes are split in
the same passes, whose number is the logarithm of the size. Pairs are compared within
leaves, so work is vectors x trees x leaf. Equal vectors are one, with a row for each
copy that names its representative instead of all pairs.

A near pair is missed if every tree parts it: with ``trees`` more, the chance falls
geometrically. A node whose vectors can't be told apart by a direction is dealt by
hash, so that no leaf is too large. Vectors that are null, empty, zero, or hold null
or non-finite components take no part, neither do null ids; vectors of different
lengths are never in one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.session import small_batches
from recollex.storage import Scratch, small

LEAF, TREES, BLOCK = 256, 6, 2048


def _unit(rows: DataFrame) -> DataFrame:
    """(id, v): usable rows on the unit sphere."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(e, lambda x: x != 0)
    length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
    return rows.filter(fine).select(F.col("id").cast("long").alias("id"), F.transform(e, lambda x: (x / length).cast("float")).alias("v")).distinct()


def _projected(seed: int):
    """Projection of each vector on the direction of its node."""

    @F.arrow_udf("double")
    def run(node: pa.Array, v: pa.Array) -> pa.Array:
        nodes = node.to_numpy(zero_copy_only=False)
        out = np.zeros(len(nodes))
        for name in np.unique(nodes):
            at = np.flatnonzero(nodes == name)
            x = [v[int(i)].values.to_numpy(zero_copy_only=False) for i in at]
            direction = np.random.default_rng([seed, int(name) & 0x7FFFFFFFFFFFFFFF]).standard_normal(len(x[0]))
            out[at] = np.stack(x) @ direction
        return pa.array(out)

    return run(F.col("node"), F.col("v"))


def leaves(nodes: DataFrame, scratch: Scratch, *, trees: int = TREES, leaf: int = LEAF, seed: int = 1) -> DataFrame:
    """(node, rep, v): distinct vectors (rep, v), once for each tree, in nodes of at most ``leaf``, or about so where they are dealt by hash."""
    at = nodes.select(F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), "rep", "v").select(F.xxhash64("tree", F.size("v")).alias("node"), "rep", "v")
    at, done, number = scratch.write(at, "nodes0"), [], 0
    while True:
        sizes = at.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.filter(F.col("n") > leaf)
        met = at.join(small(large), "node", "left")
        done.append(scratch.write(met.filter("n is null").select("node", "rep", "v"), f"leaves{number}"))
        rest = scratch.write(met.filter("n is not null").withColumn("x", _projected(seed)), f"split{number}")
        if rest.isEmpty():
            break
        cuts = rest.groupBy("node").agg(F.percentile_approx("x", 0.5, 1000).alias("cut"), F.min("x").alias("low"), F.max("x").alias("high"))
        told = rest.join(small(cuts), "node")
        # Where no direction tells vectors apart, the hash does.
        side = F.when(F.col("low") == F.col("high"), F.pmod(F.xxhash64("rep", F.lit(number)), F.lit(2))).when(F.col("cut") == F.col("high"), (F.col("x") == F.col("high")).cast("long")).otherwise((F.col("x") > F.col("cut")).cast("long"))
        number += 1
        at = scratch.write(told.select(F.xxhash64("node", side).alias("node"), "rep", "v"), f"nodes{number}")
        scratch.drop(f"nodes{number - 1}", f"split{number - 1}")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _pairs_of(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        reps = table.column("rep").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(reps), -1).astype(np.float64)
        order = np.argsort(reps)
        reps, x = reps[order], x[order]
        cosine = np.triu(x @ x.T, 1)
        i, j = np.nonzero(cosine > threshold)
        return pa.table({"keep": reps[i], "drop": reps[j], "cosine": cosine[i, j]})

    return run


def _packed(key: tuple, table: pa.Table) -> pa.Table:
    x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4")
    return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "reps": [table.column("rep").to_numpy().astype("<i8").tobytes()], "matrix": [x.tobytes()]}, schema=pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("reps", pa.binary()), ("matrix", pa.binary())]))


def _near_in_tiles(threshold: float):
    """Pairs of two packed blocks: products in single precision with a slack, which those near it confirm in double."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in ("reps", "reps2", "matrix", "matrix2", "block", "block2")}
                a, b = np.frombuffer(row["reps"], "<i8"), np.frombuffer(row["reps2"], "<i8")
                x, y = np.frombuffer(row["matrix"], "<f4").reshape(len(a), -1), np.frombuffer(row["matrix2"], "<f4").reshape(len(b), -1)
                for start in range(0, len(a), 512):
                    i, j = np.nonzero(x[start : start + 512] @ y.T > threshold - 1e-4)
                    i = i + start
                    once = (a[i] < b[j]) if row["block"] == row["block2"] else np.ones(len(i), bool)
                    i, j = i[once], j[once]
                    cosine = np.einsum("ij,ij->i", x[i].astype(np.float64), y[j].astype(np.float64))
                    i, j, cosine = i[cosine > threshold], j[cosine > threshold], cosine[cosine > threshold]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(cosine)], ["keep", "drop", "cosine"])

    return run


def all_pairs(nodes: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(keep, drop, cosine) of all near pairs of distinct vectors (rep, v), none missed: blocks of about ``BLOCK`` vectors, compared two by two, so a task holds two blocks and a strip of their products."""
    small_batches(nodes.sparkSession)
    blocks = max(-(-nodes.count() // BLOCK), 1)
    dealt = nodes.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)))
    packed = scratch.write(dealt.groupBy("dim", "block").applyInArrow(_packed, "dim int, block long, reps binary, matrix binary"), "packed")
    other = packed.select(F.col("dim").alias("dim2"), F.col("block").alias("block2"), F.col("reps").alias("reps2"), F.col("matrix").alias("matrix2"))
    named = packed.select("dim", "block").crossJoin(other.select("dim2", "block2")).filter("dim = dim2 and block <= block2")  # a row for two blocks
    tiles = named.repartition(min(max(blocks * (blocks + 1) // 2, 1), 2048)).join(packed, ["dim", "block"]).join(other, ["dim2", "block2"])
    return tiles.mapInArrow(_near_in_tiles(threshold), "keep long, drop long, cosine double")


def near_pairs(vectors: DataFrame, threshold: float = 0.95, *, trees: int = TREES, leaf: int = LEAF, seed: int = 1, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """((keep, drop, cosine), (id, rep)): pairs of different vectors whose cosine is above the threshold, the smaller representative kept, and each row's representative, the smallest id of its vector. ``exact`` compares all pairs instead of those that share a leaf."""
    scratch = Scratch(vectors.sparkSession, "forest")
    held = scratch.write(_unit(vectors), "held")
    nodes = scratch.write(held.groupBy("v").agg(F.min("id").alias("rep")), "nodes")
    members = held.join(nodes, "v").select("id", "rep")  # a very common vector is split by the adaptive skew join
    if exact:
        return all_pairs(nodes, threshold, scratch), members
    found = leaves(nodes, scratch, trees=trees, leaf=leaf, seed=seed).groupBy("node").applyInArrow(_pairs_of(threshold), "keep long, drop long, cosine double")
    return found.groupBy("keep", "drop").agg(F.max("cosine").alias("cosine")), members


def consolidate(vectors: DataFrame, threshold: float = 0.95, **options) -> DataFrame:
    """(keep, drop, cosine): a row for each near pair of different vectors, and one for each copy, to its representative."""
    pairs, members = near_pairs(vectors, threshold, **options)
    return pairs.unionByName(members.filter("id <> rep").select(F.col("rep").alias("keep"), F.col("id").alias("drop"), F.lit(1.0).alias("cosine")))
