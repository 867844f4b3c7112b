"""K-means on a grid of integers; nearest centroids are found by annulus search.

A vector's nearest centroid c satisfies ``|‖c‖ - ‖v‖| <= u`` for any upper bound u
of the distance to it. Centroids are kept sorted by norm; each vector's bound is
its distance to the nearest of a few of them (about the square root of their
number), binary search gives the run of centroids within the annulus, and these
alone are compared, in exact integer arithmetic. Norms are floating point, so the annulus is wider by more than their
error: a centroid on its border, which may tie, is inside.

A round is one pass: each task assigns its vectors and sums them by cluster, and
k rows a task with exact sums are merged by cluster and dimension. The driver
holds the centroids (k x d integers, at most ``MOST_CELLS``), never vectors. No
vector is shuffled, so copies and clusters of any share of the rows are as cheap as
others.

Defined results. Vectors that are null, of another length than ``dim``, or hold
null or non-finite components take no part. A component beyond ``LARGEST`` on the
grid is refused, since squared distances would not fit a long. First centroids are
the vectors with the smallest SHA-256 of ``<seed>:<key>``, ties by the vector;
a null key starts none. With fewer vectors than centroids asked for, each starts
one; without any key there is one result for no row. Equal centroids: the smaller
number gets the vectors, the others stay as they are. Repeated rows are assigned
each. An empty table gives an empty one. Other columns are dropped, whatever their
names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.storage import Scratch, materialize

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
#: Largest size of a component on the grid.
LARGEST = 1 << 27
#: Most numbers in all centroids.
MOST_CELLS = 1 << 26
#: Pairs of a vector and a candidate that are compared at a time.
PAIRS = 1 << 15
KEPT = "key long, x array<int>"


def kept(rows: DataFrame, *, key: str, vector: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(key, x): the vectors that take part, on the grid."""
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return rows.filter(F.col(vector).isNotNull() & fine).select(F.col(key).cast("long").alias("key"), F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c).cast("int")).alias("x"))


class Annuli:
    """Centroids (k x d integers) sorted by norm; every so many of them, about the square root of k in all, are pivots for bounds."""

    def __init__(self, centroids: np.ndarray):
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], centroids[self.order]
        step = max(math.isqrt(len(norms)), 1)
        self.pivots = self.sorted[step // 2 :: step].astype(np.float64)
        self.pivot_squares = (self.pivots**2).sum(axis=1)

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last of the sorted centroids that each vector's annulus holds."""
        v = x.astype(np.float64)
        squares = (v**2).sum(axis=1)
        nearest = (self.pivot_squares - 2 * (v @ self.pivots.T)).min(axis=1) + squares
        # Both margins are more than rounding can take away.
        bound = np.sqrt(np.maximum(nearest, 0) + 1e-11 * (squares + self.pivot_squares.max()))
        norm = np.sqrt(squares)
        bound += (norm + bound + 1) * 1e-9
        return np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each vector, and the squared distance to it; ties to the smaller number."""
        first, last = self.candidates(x)
        sizes = last - first
        number, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(x):
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")), start + 1)
            n = sizes[start:stop]
            heads = np.cumsum(n) - n
            owner = np.repeat(np.arange(start, stop), n)
            place = np.arange(n.sum()) - np.repeat(heads, n) + np.repeat(first[start:stop], n)
            apart = ((x[owner] - self.sorted[place]) ** 2).sum(axis=1)
            least = np.minimum.reduceat(apart, heads)
            named = np.where(apart == np.repeat(least, n), self.order[place], len(self.order))
            number[start:stop], distance[start:stop] = np.minimum.reduceat(named, heads), least
            start = stop
        return number, distance


def _grid(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
    if x.size and max(-int(x.min()), int(x.max())) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} on the grid")
    return x


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(key, cluster, distance) of each vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Annuli(centroids)
        for batch in batches:
            number, distance = index.nearest(_grid(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number), pa.array(distance)], ["key", "cluster", "distance"])

    return vectors.select("key", "x").mapInArrow(run, "key long, cluster int, distance long")


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) of each task's own vectors."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, count, total = Annuli(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x = _grid(batch.column(0), dim)
            number, _ = index.nearest(x)
            order = np.argsort(number, kind="stable")
            held, heads, n = np.unique(number[order], return_index=True, return_counts=True)
            if len(held):
                total[held] += np.add.reduceat(x[order], heads, axis=0)
                count[held] += n
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(count[full]), pa.array(list(total[full]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return vectors.select("x").mapInArrow(run, "cluster int, n long, sums array<long>")


def start(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """First centroids: the vectors with the smallest hash of their key."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = vectors.filter("key is not null").select("x", hashed.alias("h")).orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in first], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the exact floor of each non-empty cluster's mean."""
    dim = centroids.shape[1]
    parts = _sums(vectors, centroids).select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    merged = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in merged.collect():  # k x d numbers
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out.reshape(-1, dim)


def fit(vectors: DataFrame, *, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dim: int = DIM) -> np.ndarray:
    """Centroids after ``rounds`` rounds over (key, x)."""
    if clusters * dim > MOST_CELLS:
        raise ValueError(f"{clusters} centroids of {dim} components are more than the driver is to hold")
    centroids = start(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        after = moved(vectors, centroids)
        if np.array_equal(after, centroids):
            break  # further rounds change nothing
        centroids = after
    return centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "clusters")
    vectors = scratch.write(kept(rows, key=key, vector=vector, dim=dim, scale=scale), "grid")
    centroids = fit(vectors, clusters=clusters, rounds=rounds, seed=seed, dim=dim)
    schema = "cluster int, centroid_sha256 string"
    if not len(centroids):
        centroids = np.zeros((0, dim), np.int64)
        vectors = vectors.limit(0)
    assigned = materialize(assign(vectors, centroids), "assigned")
    scratch.drop("grid")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    inertia = sum(r["cluster_inertia"] for r in sums)
    facts = [(r["cluster"], digest(centroids[r["cluster"]]), r["cluster_inertia"]) for r in sums]
    known = spark.createDataFrame(facts, f"{schema}, cluster_inertia long")
    out = assigned.join(F.broadcast(known), "cluster")  # k rows
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")
