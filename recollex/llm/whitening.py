"""Whitening of embeddings: moments merged by Chan's formula, axes from ``eigh``.

Vectors become grid vectors, ``floor(scale * c)`` of each component as long. The
fit list holds each distinct grid vector once. Each of its partitions computes its
count, exact sums, mean and scatter around its own mean; ``treeReduce`` merges
pairs of these::

    d = mean_b - mean_a
    scatter = scatter_a + scatter_b + outer(d, d) * n_a * n_b / (n_a + n_b)

so nothing is multiplied before it is centred. The driver gets one matrix of d x d
and takes its eigenvectors. A second pass over the fit list projects it, computes
the covariance of what comes out in the same way and tells how far it is from the
identity.

What moves is the distinct grid vectors (one shuffle, after each task has dropped
its own copies) and a matrix a task.

Defined results. Vectors that are null, empty, or hold null or non-finite
components take no part. Vectors of different lengths have no common axes: each
length is fitted and whitened for itself. Grid components beyond a long are its
ends. Copies and vectors equal on the grid count once in the fit, and each row is
whitened. Axes along which the fit list doesn't vary (an eigenvalue within rounding
of zero) can't be scaled to one and are left out, so a length with one distinct
vector has no components. Equal eigenvalues leave their axes free to turn; those
that ``eigh`` gives are taken, for all rows. Null keys and repeated rows pass
through; an empty table gives an empty one. Other columns stay; ``out`` replaces a
column of its name.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollex.storage import Scratch

SCALE = 256
COMPONENTS = 4
#: Column that ``whiten`` adds.
OUT = "length int, n long, deviation decimal(38,0), whitened array<double>, explained array<double>"


@dataclass
class Moments:
    """Count, exact sums (Python integers; None of vectors that aren't on a grid), mean and scatter around it."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    scatter: np.ndarray


def moments_of(block: np.ndarray) -> Moments:
    """Moments of the rows of one block."""
    values = block.astype(np.float64)
    mean = values.mean(axis=0)
    centred = values - mean
    sums = None
    if block.dtype == np.int64:
        safe = len(block) * int(max(abs(int(block.min())), abs(int(block.max())))) < 1 << 62
        sums = (block.sum(axis=0) if safe else block.astype(object).sum(axis=0)).astype(object)
    return Moments(len(block), sums, mean, centred.T @ centred)


def merge(a: Moments, b: Moments) -> Moments:
    """Moments of two sets of vectors together."""
    n, apart = a.n + b.n, b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n)
    return Moments(n, None if a.sums is None else a.sums + b.sums, a.mean + apart * (b.n / n), scatter)


def _merge_lengths(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {d: merge(a[d], b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def _blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of the arrays of each length."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        part = column if len(at) == len(lengths) else column.take(pa.array(at))
        yield int(d), at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))


def moments(vectors: DataFrame, project: dict[int, Axes] | None = None) -> dict[int, Moments]:
    """Moments, by length, of a column of arrays without nulls; or of what ``project`` makes of those whose length it knows."""

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record of a partition: its moments by length."""
        found: dict[int, Moments] = {}
        for batch in batches:
            for d, _, grid in _blocks(batch.column(0)):
                if project is None or d in project:
                    own = moments_of(grid if project is None else project[d].project(grid))
                    found = _merge_lengths(found, {d: own})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

    parts = vectors.mapInArrow(partials, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return parts.treeReduce(_merge_lengths) if parts.getNumPartitions() else {}


@dataclass(frozen=True)
class Axes:
    """Whitening of one length: count and exact sums of the fit list, axes as rows, their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, grid: np.ndarray) -> np.ndarray:
        mean = np.array([int(s) / self.n for s in self.sums])
        return (grid - mean) @ self.axes.T / np.sqrt(self.values)

    def deviation(self, grid: np.ndarray) -> pa.Array:
        """Sum of ``(n * x - sum)**2`` of each row, exact; null beyond 38 digits."""
        most = self.n * max(abs(int(grid.min())), abs(int(grid.max()))) + max(abs(int(s)) for s in self.sums)
        if most * most * grid.shape[1] < 1 << 62:
            return pa.array(((self.n * grid - self.sums.astype(np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = ((self.n * grid.astype(object) - self.sums) ** 2).sum(axis=1)
        return pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


@dataclass(frozen=True)
class Whitening:
    """Axes by length, and the largest entry of the whitened fit list's covariance minus the identity, over all lengths."""

    lengths: dict[int, Axes]
    identity_error: float
    scale: int = SCALE


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return vector.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))


def on_grid(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))


def _axes(m: Moments, components: int) -> Axes:
    covariance = m.scatter / m.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    floor = max(values.max(), 0.0) * len(values) * np.finfo(float).eps
    order = [i for i in order if values[i] > floor][:components]
    return Axes(m.n, m.sums, vectors[:, order].T.copy(), values[order], float(np.trace(covariance)))


def fit(rows: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Fit on the distinct grid vectors of ``rows``; ``components`` axes of each length at most."""
    scratch = Scratch(rows.sparkSession, "whitening")
    fit_list = scratch.write(rows.filter(usable(F.col(vector))).select(on_grid(F.col(vector), scale).alias("x")).distinct(), "fit-list")
    lengths = {d: a for d, m in moments(fit_list).items() if len((a := _axes(m, components)).values)}

    worst = 0.0
    for m in moments(fit_list, lengths).values() if lengths else ():
        worst = max(worst, float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max()))
    scratch.drop("fit-list")
    return Whitening(lengths, worst, scale)


def whiten(rows: DataFrame, model: Whitening, *, vector: str = "embedding", out: str = "whitening") -> DataFrame:
    """The usable rows with the struct ``out``: length, n, deviation, and the whitened value and explained share of each component."""
    lengths = model.lengths

    @F.arrow_udf(OUT)
    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        deviation, whitened, explained = [None] * n, [[]] * n, [[]] * n
        length, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
        for d, at, grid in _blocks(column):
            length[at] = d
            if d not in lengths:
                continue
            axes = lengths[d]
            count[at] = axes.n
            share = (axes.values / axes.trace).tolist()
            for i, w, dev in zip(at, axes.project(grid).tolist(), axes.deviation(grid).to_pylist(), strict=True):
                deviation[i], whitened[i], explained[i] = dev, w, share
        doubles = pa.list_(pa.float64())
        return pa.StructArray.from_arrays(
            [pa.array(length), pa.array(count), pa.array(deviation, pa.decimal128(38, 0)), pa.array(whitened, doubles), pa.array(explained, doubles)],
            ["length", "n", "deviation", "whitened", "explained"],
        )

    return rows.filter(usable(F.col(vector))).withColumn(out, run(on_grid(F.col(vector), model.scale)))
