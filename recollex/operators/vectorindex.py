"""Vector indexes kept in folders: clustered cells with inserts and removals, a neighbour graph, and tiers.

Single-machine graph indexes are searched from memory; over a cluster the same
interface stands on cells: vectors lie in the folder of their nearest centre, a
query opens the cells of its nearest centres. ``probes`` trades recall for reading
as a beam does; with all cells the answer is exact. Storage is 32-bit, 16-bit or
8-bit; what the codes propose is compared again with the stored 32-bit vectors
where ``rescore`` is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.functions import scores
from recollex.operators import vectors as vs
from recollex.storage import Scratch, exists, materialize, new_path, remove, small

ROW = "id long, embedding array<float>, gen int, cell int"


class AnnIndex(Protocol):
    """What every vector index does."""

    def insert(self, rows: DataFrame) -> None: ...

    def remove(self, ids: DataFrame) -> None: ...

    def search(self, query: list[float], k: int) -> DataFrame: ...

    def rebuild(self) -> None: ...




class CellIndex:
    """Cells of vectors (id, embedding) under ``path``; ``storage`` is f32, f16 or i8."""

    def __init__(self, spark: SparkSession, path: str, *, storage: str = "f32", probes: int = 4):
        if storage not in ("f32", "f16", "i8"):
            raise ValueError("storage is f32, f16 or i8")
        self.spark, self.path, self.storage, self.probes = spark, path, storage, probes

    # A generation is a folder of rows or of removed ids, and a commit written last.
    def _commits(self) -> list:
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema("gen int, kind string").option("recursiveFileLookup", "true").json(f"{self.path}/commits").orderBy("gen").collect()
        start = max((i for i, r in enumerate(rows) if r["kind"] == "base"), default=0)
        return rows[start:]

    def _commit(self, gen: int, kind: str) -> None:
        self.spark.range(1).select(F.lit(gen).alias("gen"), F.lit(kind).alias("kind")).coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{gen}")

    def _next(self) -> int:
        live = self._commits()
        return live[-1]["gen"] + 1 if live else 0

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("gen", "cell").collect()  # one row a cell
        last = max(r["gen"] for r in rows)
        return np.array([r["centre"] for r in rows if r["gen"] == last])

    def build(self, rows: DataFrame, cells: int, *, seed: int = 1) -> CellIndex:
        """Fit centres and deal all rows to them."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        gen = self._next()
        features = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
        centres = [c.tolist() for c in KMeans(k=cells, seed=seed, maxIter=10).fit(features).clusterCenters()]
        self.spark.createDataFrame([(gen, i, c) for i, c in enumerate(centres)], "gen int, cell int, centre array<double>").coalesce(1).write.mode("append").parquet(f"{self.path}/centres")
        self._write(rows, gen, np.array(centres))
        self._commit(gen, "base")
        return self

    def _write(self, rows: DataFrame, gen: int, centres: np.ndarray) -> None:
        """Rows by cell, and what each cell holds: (cell, n, radius, zeros)."""
        placed = _placed(rows.select("id", F.col("embedding").cast("array<float>").alias("embedding")), centres, np.float16 if self.storage == "f16" else np.float32)
        placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows/gen={gen}")
        held = self.spark.read.schema(ROW + ", away double").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows/gen={gen}")
        facts = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.count_if(F.col("away").isNull()).alias("zeros"))
        materialize(facts, "spheres", f"{self.path}/spheres/gen={gen}")

    def spheres(self) -> pd.DataFrame:
        """(cell, n, radius, zeros) over what the live generations hold or held; one row a cell and generation comes to the driver."""
        live = [r["gen"] for r in self._commits() if r["kind"] != "remove"]
        rows = [r.asDict() for g in live for r in self.spark.read.parquet(f"{self.path}/spheres/gen={g}").collect()]
        return pd.DataFrame(rows, columns=["cell", "n", "radius", "zeros"]).groupby("cell", as_index=False).agg({"n": "sum", "radius": "max", "zeros": "sum"})

    def bounds(self, query: list[float]) -> list[tuple[int, float]]:
        """(cell, least cosine distance that a vector in it can have), nearest first.

        Between unit vectors the cosine distance is half the squared Euclidean one, and
        that is at least the distance to a cell's direction less its radius. Vectors
        without a direction have distance 1. Directions are those of the numbers that
        storage compares; the slack of 16 bits is for their rounding.
        """
        q, centres = np.asarray(query, float), self.centres()
        q = q / np.linalg.norm(q)
        move = 0.0 if self.storage == "f32" else 1e-3
        out = []
        for cell, _, radius, zeros in self.spheres().itertuples(index=False):
            if cell < 0:
                continue
            bound = 0.0 if np.isnan(radius) else max(np.linalg.norm(q - _direction(centres[cell])) - radius - move, 0.0) ** 2 / 2
            out.append((int(cell), min(bound, 1.0) if zeros else bound))
        return sorted(out, key=lambda c: (c[1], c[0]))

    def proven(self, query: list[float], k: int, *, first: int | None = None) -> tuple[DataFrame, list[int]]:
        """The k nearest as ``search`` gives them over all cells, and the cells that were opened for it.

        The ``first`` cells by bound give a k-th distance; of the others only those
        whose bound does not exceed it are opened. Not for 8-bit storage, whose codes
        order vectors by other numbers.
        """
        if self.storage == "i8":
            raise ValueError("proven answers need f32 or f16 storage")
        if not any(query):
            return self.search(query, k), []
        order = self.bounds(query)
        start = [c for c, _ in order[: first or self.probes]]
        found = self._open(start, query, k).collect()  # k rows
        limit = found[-1]["distance"] + 1e-8 if len(found) == k else float("inf")
        more = [c for c, bound in order[len(start) :] if bound <= limit]
        known = self.spark.createDataFrame(found, "id long, distance double")
        both = known.unionByName(self._open(more, query, k)) if more else known
        return both.orderBy(F.round("distance", 9), "id").limit(k), start + more

    def _open(self, cells: list[int], query: list[float], k: int) -> DataFrame:
        near = self.rows().filter(F.col("cell").isin(cells))
        return vs.knn(near if self.storage == "f32" else near.withColumn("embedding", scores.half(F.col("embedding"))), query, k)

    def insert(self, rows: DataFrame) -> None:
        """Add rows; those with ids that are there replace them."""
        gen = self._next()
        materialize(rows.select("id").distinct(), "gone", f"{self.path}/gone/gen={gen}")
        self._write(rows, gen, self.centres())
        self._commit(gen, "insert")

    def remove(self, ids: DataFrame) -> None:
        gen = self._next()
        materialize(ids.select("id").distinct(), "gone", f"{self.path}/gone/gen={gen}")
        self._commit(gen, "remove")

    def rows(self) -> DataFrame:
        """(id, embedding, gen, cell) of what the index holds."""
        live = self._commits()
        held = [r["gen"] for r in live if r["kind"] != "remove"]
        if not held:
            return self.spark.createDataFrame([], ROW)
        out = self.spark.read.schema(ROW).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/gen={g}" for g in held])
        ids = None
        for r in live:
            if r["kind"] != "base":
                part = self.spark.read.schema("id long").parquet(f"{self.path}/gone/gen={r['gen']}").select(F.col("id").alias("_id"), F.lit(r["gen"]).alias("_before"))
                ids = part if ids is None else ids.unionByName(part)
        if ids is None:
            return out
        last = small(ids.groupBy("_id").agg(F.max("_before").alias("_before")))
        return out.join(last, (F.col("id") == F.col("_id")) & (F.col("gen") < F.col("_before")), "left_anti")

    def size(self) -> int:
        return self.rows().count()

    def search(self, query: list[float], k: int, *, probes: int | None = None, rescore: int = 0) -> DataFrame:
        """(id, distance) by cosine in the nearest cells; with ``rescore`` that many by codes first."""
        centres = self.centres()
        order = np.argsort(((centres - np.array(query)) ** 2).sum(1), kind="stable")
        near = self.rows().filter(F.col("cell").isin([int(c) for c in order[: probes or self.probes]]))
        if self.storage == "f32":
            return vs.knn(near, query, k)
        coded = near.withColumn("embedding", scores.half(F.col("embedding"))) if self.storage == "f16" else near
        if self.storage == "i8":
            first = vs.int8_knn(near, query, rescore or k)
        else:
            first = vs.knn(coded, query, rescore or k)
        return vs.knn(near.join(F.broadcast(first.select("id")), "id"), query, k) if rescore else first  # at most ``rescore`` ids

    def cascade(self, query: list[float], k: int, *, rough: int = 10) -> DataFrame:
        """Fewest differing signs first, ``rough`` times what is asked for, then the exact distance."""
        return vs.cascade(self.rows(), query, k, first=rough * k)

    def rebuild(self, cells: int | None = None) -> None:
        """Centres fitted again over what is held; older generations go."""
        live = self._commits()
        held = materialize(self.rows().select("id", "embedding"), "held")
        self.build(held, cells or len(self.centres()))
        for r in live:
            for kind in ("rows", "gone"):
                remove(self.spark, f"{self.path}/{kind}/gen={r['gen']}")


def _direction(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v)
    return v / length if length > 0 else v


def _placed(rows: DataFrame, centres: np.ndarray, kind: type) -> DataFrame:
    """(id, embedding, away, cell): the nearest centre of each vector, ties to the smaller number, and how far its direction is from the centre's.

    Vectors are compared with all centres as a matrix product in Arrow batches; the
    centres go to the tasks with the function. Vectors of other dimensions, null ones
    and those with entries that are null or not finite are kept in cell -1, which no
    search opens. ``away`` is null where a vector has no direction as ``kind`` of numbers.
    """
    dim = centres.shape[1]
    sizes, directions = (centres**2).sum(1), np.array([_direction(c) for c in centres])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = np.array([v is not None and len(v) == dim and bool(np.isfinite(np.asarray(v, float)).all()) for v in batch["embedding"]], bool)
            cell, away = np.full(len(batch), -1, np.int32), np.full(len(batch), np.nan)
            if good.any():
                x = np.stack(batch["embedding"][good].to_list()).astype(float)
                best = (sizes[None] - 2 * x @ centres.T).argmin(1)
                with np.errstate(over="ignore"):
                    x = x.astype(kind).astype(float)
                length = np.linalg.norm(x, axis=1)
                unit = x / np.where(length > 0, length, 1)[:, None]
                cell[good], away[good] = best, np.where(length > 0, np.linalg.norm(unit - directions[best], axis=1), np.nan)
            yield batch.assign(away=pd.array(away, dtype="Float64"), cell=cell)

    return rows.mapInPandas(place, "id long, embedding array<float>, away double, cell int")


class TieredIndex:
    """Rows up to a number of ids stay cached, the rest is read from storage; answers are merged by distance."""

    def __init__(self, rows: DataFrame, *, hot: int = 100_000):
        ids = rows.select("id").orderBy("id").limit(hot + 1).collect() if hot < 2 else None
        edge = ids[hot]["id"] if ids and len(ids) > hot else None
        if ids is None:
            border = rows.select("id").orderBy("id").offset(hot).limit(1).collect()
            edge = border[0]["id"] if border else None
        self.hot = (rows.filter(F.col("id") < edge) if edge is not None else rows).cache()
        self.cold = rows.filter(F.col("id") >= edge) if edge is not None else rows.limit(0)

    def close(self) -> None:
        """Free the cached rows; searches after it read all from storage."""
        self.hot.unpersist()

    def __enter__(self) -> TieredIndex:
        return self

    def __exit__(self, *failure) -> None:
        self.close()

    def search(self, query: list[float], k: int) -> DataFrame:
        both = vs.knn(self.hot, query, k).unionByName(vs.knn(self.cold, query, k))
        return both.orderBy(F.round("distance", 9), "id").limit(k)


def neighbour_graph(rows: DataFrame, k: int, *, dim: int, path: str | None = None) -> DataFrame:
    """(u, v, distance): the k nearest of each vector, both ways; exact, in blocks of queries."""
    near = vs.knn_join(rows.select(F.col("id").alias("qid"), "embedding"), rows, k + 1, dim=dim).filter("qid <> id")
    one = near.select(F.col("qid").alias("u"), F.col("id").alias("v"), "distance")
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "distance")).distinct()
    return materialize(both, "neighbours", path or new_path(rows.sparkSession, "neighbours"))


def beam_search(rows: DataFrame, graph: DataFrame, query: list[float], k: int, *, beam: int = 64, entries: int = 8) -> DataFrame:
    """(id, distance): from a few entries along the graph's edges, until the nearest ``beam`` are all expanded."""
    scratch = Scratch(rows.sparkSession, "beam")
    q = F.array(*[F.lit(float(x)) for x in query])
    vectors = rows.select("id", "embedding")
    measured = lambda ids: vectors.join(F.broadcast(ids), "id").select("id", (1 - scores.cosine(F.col("embedding"), q)).alias("distance"))  # noqa: E731  at most beam vertices' neighbours
    start = vectors.orderBy(F.xxhash64("id"), "id").limit(entries).select("id")
    seen = scratch.write(measured(start).withColumn("done", F.lit(False)), "seen0")
    order = Window.partitionBy(F.lit(0)).orderBy(F.round("distance", 9), "id")
    number = 0
    while True:
        ranked = seen.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam)  # the beam of one query
        front = ranked.filter("not done").select("id")
        if front.isEmpty():
            return ranked.filter(F.col("r") <= k).select("id", "distance").orderBy(F.round("distance", 9), "id")
        number += 1
        met = graph.join(F.broadcast(front.withColumnRenamed("id", "u")), "u").select(F.col("v").alias("id")).distinct().join(ranked.select("id"), "id", "left_anti")
        expanded = ranked.select("id", "distance", F.lit(True).alias("done"))
        new = measured(met).withColumn("done", F.lit(False))
        seen = scratch.write(expanded.unionByName(new), f"seen{number}")
        scratch.drop(f"seen{number - 1}")


def over_fetched(search, keep: DataFrame, k: int, *, share: float | None = None) -> DataFrame:
    """Hits of ``search(n)`` that are kept (id): four times k first, or by the share that passes, up to 256 times; more until k are found or all were seen."""
    n = 4 * k if share is None else int(np.ceil(k * min(1 / max(share, 1e-9), 256)))
    while True:
        hits = materialize(search(n), "over-fetched")
        kept = hits.join(keep.select("id"), "id", "left_semi")
        if kept.count() >= k or hits.count() < n:
            return kept.orderBy(F.round("distance", 9), "id").limit(k)
        n *= 4
