"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Build. A first graph comes from blocks: vectors are hashed by the signs of random
projections, and each block of at most ``BLOCK`` vectors is compared within
itself, ``TREES`` times. Then, in rounds, each vertex introduces its neighbours
(``SAMPLE`` new and old ones, in both directions) to each other, in joins of the
graph with itself and with the vectors; a pair that improves either side's list
is kept. Rounds end when few new neighbours come in.

Search. A query starts at given vertices (its own neighbours if it is indexed,
the members of its blocks otherwise) and expands, hop by hop, every vertex of its
beam over the edges of the graph in both directions, until the nearest vertices,
as many as the beam holds, are all expanded; no number of hops ends it before. The
beam grows with the logarithm of the vertices. Its vertices are compared again in
double precision on the original vectors, all of them whose distance by codes,
with the codes' error, could be among the nearest.

``neighbours(..., exact=True)`` compares each query with every vector instead, in
blocks, for tables where a recall below 1 won't do.

Equal vectors are one vertex, so copies take no place in lists; they are set
apart again in the answers. Vectors are compared in the rounds by 8-bit codes
with a scale of their own, around the mean of all.

Every round is written to the shared folder. All of it is joins keyed by vertex;
nothing is broadcast but the mean and the projections, whose sizes depend on the
dimension alone.

Defined results. Vectors that are null, empty or zero, or hold null or non-finite
components, take no part; neither do null ids. Vectors of different dimensions
have no distance: each dimension has a graph of its own, and a query is answered
from its own. Rows that share an id but not the vector are candidates and queries
each; of repeated rows (id and vector) one counts. A query's own id is never among
its answers. With fewer candidates than asked for, all are returned if the beam
has them, which it has for up to ``BEAM`` vertices. Ties go to the smaller id. An
empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollex.storage import Scratch, materialize

K = 24
SAMPLE = 12
TREES = 3
BLOCK = 512
ROUNDS = 12
#: A round that brings in fewer new neighbours than this share of the graph is the last.
ENOUGH = 0.08
#: Least beam; and what each doubling of the vertices adds to it.
BEAM = 96
BEAM_STEP = 16
#: Queries that are compared with all vectors at a time by the exact way.
EXACT_BLOCK = 1024
SEED = 11


def beam_for(n: int) -> int:
    """Vertices that a search keeps among ``n``."""
    return max(BEAM, math.ceil(BEAM_STEP * math.log2(max(n, 2))))


def usable(rows: DataFrame, *, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = (
        F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        & F.exists(v, lambda x: x != 0)
    )
    return rows.filter(fine).select(F.col(key).cast("long").alias("id"), v.alias("v")).distinct()


def _with_codes(nodes: DataFrame, mean: list[float]) -> DataFrame:
    """Add ``code`` (bytes) and ``scale`` of each vector around the mean."""
    centre = np.array(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1) - centre
            scale = np.maximum(np.abs(v).max(axis=1), 1e-300) / 127
            codes = np.rint(v / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], ["u", "code", "scale"])

    return nodes.select("u", "v").mapInArrow(run, "u long, code binary, scale double")


def _decoded(codes: pa.Array, scales: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(len(codes), -1)
    return raw.astype(np.float32) * scales.to_numpy().astype(np.float32)[:, None]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole groups at a time; the first column is sorted by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy()
        changes = np.flatnonzero(group[1:] != group[:-1])
        start = int(changes[-1]) + 1 if len(changes) else 0
        if held and held[-1].column(0)[0].as_py() != group[0]:
            yield pa.concat_batches(held)
            held = []
        if start:
            yield pa.concat_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _distances(x: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", x, x)
    return np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0)


def _edges(u: list[np.ndarray], v: list[np.ndarray], d: list[np.ndarray]) -> pa.RecordBatch:
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(cat(u, np.int64)), pa.array(cat(v, np.int64)), pa.array(cat(d, np.float32))], ["u", "v", "d"])


def _nearest(edges: DataFrame, k: int, by: str = "u") -> DataFrame:
    """The k nearest of each vertex; a pair that is there twice counts as old if it was."""
    one = edges.groupBy("u", "v").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    order = Window.partitionBy(by).orderBy("d", "v")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block_edges(codes: DataFrame, n: int, dim: int, k: int, trees: int, block: int) -> DataFrame:
    """(u, v, d) within blocks of vectors with the same signs of random projections."""
    bits = max(0, round(math.log2(max(1, n / block))))
    planes = np.random.default_rng(SEED).standard_normal((trees, bits, dim)).astype(np.float32)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _decoded(batch.column(1), batch.column(2))
            keys = [((x @ p.T > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(x))).astype(np.int64) * trees + t for t, p in enumerate(planes)]
            at = np.tile(np.arange(len(x)), trees)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *[c.take(pa.array(at)) for c in batch.columns]], ["block", "u", "code", "scale"])

    keyed = codes.mapInArrow(signs, "block long, u long, code binary, scale double")
    # A block of many is dealt into pieces, so that none is larger than a task can compare.
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", F.ceil(F.col("n") / (2 * block)).cast("int").alias("pieces"))
    dealt = keyed.join(sizes, "block").select((F.xxhash64("block", F.pmod(F.xxhash64("u"), "pieces"))).alias("piece"), "u", "code", "scale")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            group, ids = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            x = _decoded(rows.column(2), rows.column(3))
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                d = _distances(x[a:b])
                np.fill_diagonal(d, np.inf)
                m = min(k, b - a - 1)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                own = ids[a:b]
                yield _edges([np.repeat(own, m)], [own[near].ravel()], [np.take_along_axis(d, near, 1).ravel()])

    return dealt.repartition("piece").sortWithinPartitions("piece").mapInArrow(compare, "u long, v long, d float")


def _introduce(graph: DataFrame, codes: DataFrame, k: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of neighbours of the same vertex that improve a list; and the edges that took part as new."""
    dice = F.xxhash64("u", "v", F.lit(SEED))

    def drawn(edges: DataFrame, hub: str, other: str) -> DataFrame:
        order = Window.partitionBy(hub, "new").orderBy(dice)
        return edges.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= sample).select(F.col(hub).alias("m"), F.col(other).alias("x"), "new")

    def own(edges: DataFrame) -> DataFrame:
        order = Window.partitionBy("u").orderBy(dice)
        fresh = edges.filter("new").withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= sample)
        return fresh.select("u", "v")

    used = own(graph)
    fresh = used.withColumn("new", F.lit(True))
    stale = graph.filter("not new").select("u", "v", "new")
    members = (
        fresh.select(F.col("u").alias("m"), F.col("v").alias("x"), "new")
        .unionByName(drawn(fresh, "v", "u"))
        .unionByName(stale.select(F.col("u").alias("m"), F.col("v").alias("x"), "new"))
        .unionByName(drawn(stale, "v", "u"))
        .groupBy("m", "x").agg(F.max("new").alias("new"))
    )
    # The last distance of a full list is the one to beat.
    beat = graph.groupBy("u").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(math.inf)).cast("float").alias("worst"))
    known = codes.join(beat, "u", "left").withColumnRenamed("u", "x")
    told = members.join(known, "x").select("m", "x", "new", "worst", "code", "scale")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            group, ids, new = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy(zero_copy_only=False)
            worst = rows.column(3).fill_null(math.inf).to_numpy(zero_copy_only=False)
            x = _decoded(rows.column(4), rows.column(5))
            cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
            u, v, d = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2:
                    continue
                near, fresh, w, own = _distances(x[a:b]), new[a:b], worst[a:b], ids[a:b]
                better = (fresh[:, None] | fresh[None, :]) & (near < w[:, None])
                np.fill_diagonal(better, False)
                i, j = np.nonzero(better)
                u.append(own[i])
                v.append(own[j])
                d.append(near[i, j])
            yield _edges(u, v, d)

    found = told.repartition("m").sortWithinPartitions("m").mapInArrow(pairs, "u long, v long, d float")
    return found, used


def build(nodes: DataFrame, codes: DataFrame, n: int, dim: int, *, k: int = K, sample: int = SAMPLE, trees: int = TREES, block: int = BLOCK, rounds: int = ROUNDS, enough: float = ENOUGH) -> DataFrame:
    """(u, v, d): approximately the k nearest vertices of each vertex."""
    spark = nodes.sparkSession
    scratch = Scratch(spark, "graph")
    start = _block_edges(codes, n, dim, k, trees, block).withColumn("new", F.lit(True))
    graph = scratch.write(_nearest(start, k).select("u", "v", "d", "new"), "graph0")
    for number in range(1, rounds + 1):
        found, used = _introduce(graph, codes, k, sample)
        kept = graph.join(used.withColumn("took", F.lit(True)), ["u", "v"], "left").select("u", "v", "d", (F.col("new") & F.col("took").isNull()).alias("new"))
        merged = kept.unionByName(found.withColumn("new", F.lit(True)))
        graph = scratch.write(_nearest(merged, k).select("u", "v", "d", "new"), f"graph{number}")
        scratch.drop(f"graph{number - 1}")
        spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of the round
        fresh, edges = graph.agg(F.coalesce(F.sum(F.col("new").cast("int")), F.lit(0)), F.count(F.lit(1))).first()
        if fresh <= enough * edges:
            break
    return graph.select("u", "v", "d")


def search(starts: DataFrame, queries: DataFrame, graph: DataFrame, codes: DataFrame, *, beam: int = BEAM) -> DataFrame:
    """(q, u, d): the beam of each query by greedy search.

    starts: (q, u), vertices to begin at. queries: (q, code, scale).
    """
    spark = graph.sparkSession
    scratch = Scratch(spark, "search")
    links = scratch.write(graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    asked = queries.select("q", F.col("code").alias("q_code"), F.col("scale").alias("q_scale"))

    def measured(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                gap = _decoded(rows.column(2), rows.column(3)) - _decoded(rows.column(4), rows.column(5)) if rows.num_rows else np.zeros((0, 1), np.float32)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.einsum("ij,ij->i", gap, gap).astype(np.float32))], ["q", "u", "d"])

        joined = pairs.join(asked, "q").join(codes, "u").select("q", "u", "q_code", "q_scale", "code", "scale")
        return joined.mapInArrow(run, "q long, u long, d float")

    order = Window.partitionBy("q").orderBy("d", "u")

    def ranked(rows: DataFrame) -> DataFrame:
        """Add ``front``: in the beam and not expanded before; these are expanded now, so they count as done from here on."""
        inside = F.row_number().over(order) <= beam
        return rows.withColumn("inside", inside).select("q", "u", "d", (F.col("inside") & ~F.col("done")).alias("front"), (F.col("inside") | F.col("done")).alias("done"), "inside")

    # seen: every vertex that a query has met.
    seen = scratch.write(ranked(measured(starts.distinct()).withColumn("done", F.lit(False))), "seen0")
    number = 0
    while not (front := seen.filter("front").select("q", "u")).isEmpty():  # a vertex is expanded once, so this ends
        number += 1
        met = front.join(links, "u").select("q", F.col("v").alias("u")).distinct().join(seen.select("q", "u"), ["q", "u"], "left_anti")
        seen = scratch.write(ranked(seen.select("q", "u", "d", "done").unionByName(measured(met).withColumn("done", F.lit(False)))), f"seen{number}")
        scratch.drop(f"seen{number - 1}")
        spark.sparkContext._jvm.System.gc()
    return seen.filter("inside").select("q", "u", "d")


class Index:
    """Vertices, codes and graphs of a table of vectors, one graph for each dimension."""

    def __init__(self, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", **options):
        self.vectors = materialize(usable(rows, key=key, vector=vector), "vectors")
        dims = [r["dim"] for r in self.vectors.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]
        self.parts = [_Part(self.vectors.filter(F.size("v") == dim), dim, options) for dim in dims]

    def neighbours(self, asked: Column, k: int, *, beam: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, rank, vec_id, score) of the indexed vectors for which ``asked`` (a condition on id) holds, themselves left out."""
        out = self.vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        for part in self.parts:
            out = out.unionByName(part.neighbours(asked, k, beam, exact))
        return out


class _Part:
    """Vectors of one dimension."""

    def __init__(self, vectors: DataFrame, dim: int, options: dict):
        self.vectors, self.dim, self.options = vectors, dim, options
        # Equal vectors are one vertex; a vertex is named when it is written, for ids may repeat.
        named = vectors.groupBy("v").agg(F.count(F.lit(1)).alias("copies")).select("v", "copies", F.monotonically_increasing_id().alias("u"))
        self.nodes = materialize(named, "vertices")
        self.n = self.nodes.count()
        self.members = materialize(vectors.join(self.nodes.select("v", "u", "copies"), "v").select("id", "u", "copies"), "members")
        self._built = None

    def built(self) -> tuple[DataFrame, DataFrame]:
        """Codes and graph, made when they are first asked for."""
        if self._built is None:
            mean = [x["m"] for x in self.nodes.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()]  # one row a dimension
            codes = materialize(_with_codes(self.nodes, mean), "codes")
            self._built = codes, build(self.nodes, codes, self.n, self.dim, **self.options)
        return self._built

    def neighbours(self, asked: Column, k: int, beam: int | None, exact: bool) -> DataFrame:
        queries = materialize(self.members.filter(asked).select(F.col("id").alias("query_id"), F.col("u").alias("q")), "queries")
        scored = self._compared(queries, k) if exact else self._searched(queries, k, max(beam or beam_for(self.n), k + 1))
        # Set copies apart: of each vertex the k + 1 smallest ids can be among the nearest.
        first = Window.partitionBy("u").orderBy("id")
        members = (
            self.members.filter("copies > 1").withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1).select("u", "id")
            .unionByName(self.members.filter("copies = 1").select("u", "id"))
        )
        best = Window.partitionBy("query_id", "q").orderBy("score", "vec_id")
        return (
            scored.join(members, "u").join(queries, "q").filter(F.col("id") != F.col("query_id"))
            .select("query_id", "q", F.col("id").alias("vec_id"), "score")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )

    def _searched(self, queries: DataFrame, k: int, beam: int) -> DataFrame:
        """(q, u, score) of the vertices that the graph search finds near each query."""
        all_codes, graph = self.built()
        distinct = queries.select("q").distinct()
        starts = graph.join(distinct, F.col("u") == F.col("q"), "left_semi").select(F.col("u").alias("q"), F.col("v").alias("u")).unionByName(distinct.select("q", F.col("q").alias("u")))
        codes = all_codes.join(distinct, F.col("u") == F.col("q"), "left_semi").select(F.col("u").alias("q"), "code", "scale")
        found = search(starts, codes, graph, all_codes, beam=beam)
        # A code is off by half a step in each dimension at most, so a distance lies within both vectors' errors.
        half = 0.5 * math.sqrt(self.dim)
        bounded = found.join(all_codes.select("u", F.col("scale").alias("u_scale")), "u").join(codes.select("q", F.col("scale").alias("q_scale")), "q")
        far, error = F.sqrt(F.col("d").cast("double")), (F.col("u_scale") + F.col("q_scale")) * half * 1.001 + F.sqrt(F.col("d").cast("double")) * 1e-6
        bounded = bounded.select("q", "u", (far - error).alias("low"), (far + error).alias("high"))
        # The query's own vertex may be one of the k + 1, and so may stand for others' copies.
        order = Window.partitionBy("q").orderBy("high", "u")
        safe = bounded.withColumn("nth", F.row_number().over(order)).groupBy("q").agg(F.max(F.when(F.col("nth") <= k + 1, F.col("high"))).alias("bound"))
        pool = bounded.join(safe, "q").filter("low <= bound").select("q", "u")
        near = pool.join(self.nodes.select(F.col("u").alias("q"), F.col("v").alias("q_v")), "q").join(self.nodes.select("u", "v"), "u")
        gap = F.aggregate(F.zip_with("q_v", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        return near.select("q", "u", F.sqrt(gap).alias("score"))

    def _compared(self, queries: DataFrame, k: int, block: int = EXACT_BLOCK) -> DataFrame:
        """(q, u, score) of the k + 1 nearest vertices by comparing every vertex; queries are sent out in blocks of ``block``."""
        spark, dim = self.nodes.sparkSession, self.dim
        asked = self.nodes.join(queries.select(F.col("q").alias("u")).distinct(), "u", "left_semi").select("u", "v")
        count = max(-(-asked.count() // block), 1)
        asked = materialize(asked.withColumn("part", F.pmod(F.xxhash64("u"), F.lit(count)).cast("int")), "exact-queries")
        out = []
        for number in range(count):
            part = asked.filter(F.col("part") == number).toPandas()  # about block rows
            if len(part):
                near = self.nodes.select("u", "v").mapInArrow(_all_near(part["u"].to_numpy(np.int64), np.stack(part["v"].to_list()).reshape(-1, dim), k + 1), "q long, u long, score double")
                best = Window.partitionBy("q").orderBy("score", "u")
                out.append(materialize(near.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth"), "exact"))
        found = spark.createDataFrame([], "q long, u long, score double")
        for part in out:
            found = found.unionByName(part)
        return found


def _all_near(ids: np.ndarray, asked: np.ndarray, k: int):
    """Of each batch of vectors the k nearest of each query, in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            for a in range(0, len(ids), 64):
                q = asked[a : a + 64]
                rough = (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T
                m = min(len(u), 4 * k)
                near = np.argpartition(rough, m - 1, axis=1)[:, :m]
                score = np.sqrt(((q[:, None, :] - x[near]) ** 2).sum(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + 64], m)), pa.array(u[near].ravel()), pa.array(score.ravel())], ["q", "u", "score"])

    return run
