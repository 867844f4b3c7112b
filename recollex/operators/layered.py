"""A layered navigable graph over vectors, kept in a folder, built and searched by joins.

Distinct vectors are nodes; rows point to their node, so copies take no place in
lists. A node's level comes from a hash, each level with about one in ``fan`` of
the nodes below; the top one has at most ``TOP`` nodes, which are compared as one
matrix wherever they are needed.

Build, level by level from the top. Every node knows its ``routes`` nearest nodes
of the level above; those that share one form its cell, and a node's neighbours on
its level are sought in its cells. Of the nearest found, one is linked if it is
nearer to the node than to any neighbour linked before, so links point in different
directions; links count both ways and the nearest ``2 * degree`` stay. The next
level's routes are sought among the members of a node's cells. All comparisons are
within cells of bounded expected size, so work grows with the number of nodes (times
levels); a cell with more than ``CELL`` nodes is dealt to slices, and its centres of
the next level stand in each.

Search descends: the nearest top nodes are the first beam; on each level the beam's
nodes are expanded over the links of that level, the nearest ``step`` a hop, until
all of them are, and what was found starts the next level. A hop joins the open nodes
of all queries with links, and what they meet with the vectors; only what gets into a
query's beam comes back to it.

Inserts are routed like nodes of the build and linked within the cells, both ways.
Removals take a node away when its last row goes, and give each node that linked to
it the neighbours of what is gone instead. Each change is a generation (folders, and
a commit written last); links that a change touches override older ones.

Answers are approximate; ``compared`` tells how much a search looked at, and tests
hold recall against brute force. Equal distances go to the smaller id. Vectors that
are null, or hold null or non-finite components, or (by cosine) are zero, are not
indexed; rows of an id that is there replace it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.storage import Scratch, exists, remove, small

TOP = 64
CELL = 1024
COMMIT = "gen int, base boolean, top int"
NODE = "nid long, v array<float>, level int"
LINK = "level int, u long, v long, d double"
STATE = "qid long, ids array<long>, ds array<double>, done array<boolean>, front array<long>, bound double"
TABLES = {"nodes": NODE, "rows": "id long, nid long", "links": LINK, "routes": "level int, nid long, centre long", "dead": "nid long", "gone": "id long", "touched": "level int, u long"}


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def diverse(d: np.ndarray, degree: int) -> np.ndarray:
    """Of an all-pairs matrix: which columns each row links, by (row, column) mask over its nearest candidates.

    A candidate is linked if no linked one is nearer to it than the row is.
    """
    n = len(d)
    most = min(3 * degree, n - 1)
    own = d + np.diag(np.full(n, np.inf, d.dtype))
    near = np.argpartition(own, most - 1, axis=1)[:, :most] if most < n - 1 else np.argsort(own, axis=1)[:, :most]
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(own, near, 1), axis=1, kind="stable"), 1)
    to_row = np.take_along_axis(own, near, 1)
    kept = np.zeros((n, most), bool)
    for j in range(most):
        between = d[near[:, j][:, None], near[:, :j]]
        free = ~(kept[:, :j] & (between < to_row[:, j : j + 1])).any(axis=1)
        kept[:, j] = free & (kept[:, :j].sum(axis=1) < degree)
    return np.where(kept, near, -1)


class LayeredIndex:
    """Index of rows (id, embedding) under ``path``; ``metric`` is cosine or l2."""

    def __init__(self, spark: SparkSession, path: str, *, metric: str = "cosine", degree: int = 16, fan: int = 32, routes: int = 8, beam: int = 96, step: int = 24, top: int = TOP):
        if metric not in ("cosine", "l2"):
            raise ValueError("metric is cosine or l2")
        self.spark, self.path, self.metric = spark, path, metric
        self.degree, self.fan, self.routes, self.beam, self.step, self.top = degree, fan, routes, beam, step, top

    # --- generations ---------------------------------------------------------

    def commits(self) -> list:
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(f"{self.path}/commits").orderBy("gen").collect()  # one row a change
        start = max((i for i, r in enumerate(rows) if r["base"]), default=0)
        return rows[start:]

    def _commit(self, gen: int, base: bool, top: int) -> None:
        row = self.spark.range(1).select(F.lit(gen).alias("gen"), F.lit(base).alias("base"), F.lit(top).alias("top"))
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{gen}")

    def _write(self, df: DataFrame, table: str, gen: int, *order: str) -> DataFrame:
        path = f"{self.path}/{table}/gen={gen}"
        (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _all(self, table: str) -> DataFrame:
        """Rows of all generations, with ``gen``."""
        found = [p for r in self.commits() if exists(self.spark, p := f"{self.path}/{table}/gen={r['gen']}")]
        schema = f"{TABLES[table]}, gen int"
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*found)

    def _without(self, rows: DataFrame, table: str, *keys: str) -> DataFrame:
        """Rows that no later generation of ``table`` names by these keys."""
        if not any(exists(self.spark, f"{self.path}/{table}/gen={r['gen']}") for r in self.commits()):
            return rows.drop("gen")
        late = self._all(table).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("gen").alias("_gen"))
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"_{k}"))
        return rows.join(small(late), same & (F.col("gen") < F.col("_gen")), "left_anti").drop("gen")

    def nodes(self) -> DataFrame:
        return self._without(self._all("nodes"), "dead", "nid")

    def rows(self) -> DataFrame:
        """(id, nid) of what the index holds."""
        return self._without(self._all("rows"), "gone", "id")

    def links(self) -> DataFrame:
        return self._without(self._all("links"), "touched", "level", "u")

    def cells(self) -> DataFrame:
        """(level, nid, centre): nodes by the nearest nodes of a level; centres that are gone are left out."""
        held = self._without(self._all("routes"), "dead", "nid")
        if not any(exists(self.spark, f"{self.path}/dead/gen={r['gen']}") for r in self.commits()):
            return held
        return held.join(small(self._all("dead").select(F.col("nid").alias("centre")).distinct()), "centre", "left_anti").select("level", "nid", "centre")

    # --- build ---------------------------------------------------------------

    def _usable(self, rows: DataFrame) -> DataFrame:
        """(id, v): rows to index, on the unit sphere by cosine; one for each id, the smallest vector of several."""
        e = F.col("embedding").cast("array<double>")
        fine = F.col("embedding").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        v = e
        if self.metric == "cosine":
            fine = fine & F.exists(e, lambda x: x != 0)
            length = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + x * x))
            v = F.transform(e, lambda x: x / length)
        return rows.filter(F.col("id").isNotNull() & fine).groupBy(F.col("id").cast("long").alias("id")).agg(F.min(v.cast("array<float>")).alias("v"))

    def _level(self) -> Column:
        share = (F.pmod(F.xxhash64("nid", F.lit(7)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
        return F.floor(-F.log(share) / F.lit(math.log(self.fan))).cast("int")

    def build(self, rows: DataFrame) -> LayeredIndex:
        """Index all of ``rows`` anew; older generations are no longer read."""
        live = self.commits()
        gen, scratch = (live[-1]["gen"] + 1 if live else 0), Scratch(self.spark, "layered")
        held = scratch.write(self._usable(rows), "held")
        nodes = self._write(held.groupBy("v").agg(F.min("id").alias("nid")).withColumn("level", self._level()).select("nid", "v", "level"), "nodes", gen, "nid")
        self._write(held.join(nodes.select("nid", "v"), "v").select("id", "nid"), "rows", gen, "nid")  # a very common vector is split by the adaptive skew join
        sizes = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
        at_least = lambda level: sum(n for lv, n in sizes.items() if lv >= level)
        top = next(lv for lv in range(max(sizes, default=0) + 1) if at_least(lv) <= self.top or lv == max(sizes))
        self._write_graph(nodes, nodes, gen, top, scratch)
        self._commit(gen, True, top)
        scratch.drop(*list(scratch.live))
        return self

    def _write_graph(self, new: DataFrame, nodes: DataFrame, gen: int, top: int, scratch: Scratch, cells: DataFrame | None = None, links: DataFrame | None = None) -> None:
        """Route and link ``new`` among ``nodes`` (which hold them); ``cells`` and ``links`` are those of the nodes that are linked already."""
        routes = None
        level_links, level_routes = [], []
        for level in range(top - 1, -1, -1):
            above = level + 1
            routes = self._first_routes(new, self._top(nodes, top)) if routes is None else routes
            routes = scratch.write(routes, f"routes{above}")
            level_routes.append(routes.select(F.lit(above).alias("level"), "nid", "centre"))
            placed = routes.join(new, "nid").select("centre", "nid", "v", "level", F.lit(True).alias("new"))
            if cells is not None:
                old = cells.filter(F.col("level") == above).select("nid", "centre").join(nodes, "nid").join(small(routes.select("centre").distinct()), "centre", "left_semi")
                placed = placed.unionByName(old.select("centre", "nid", "v", "level", F.lit(False).alias("new")).join(small(new.select("nid")), "nid", "left_anti").select(placed.columns))
            placed = scratch.write(placed, f"placed{level}")
            members = placed.filter(F.col("level") >= level)
            pairs = self._dealt(members).groupBy("centre", "slice").applyInArrow(self._link_cell(), "u long, v long, d double")
            level_links.append(pairs.groupBy("u", "v").agg(F.min("d").alias("d")).select(F.lit(level).alias("level"), "u", "v", "d"))
            if level:
                found = self._dealt(placed.filter("new"), members).groupBy("centre", "slice").applyInArrow(self._route_cell(), "nid long, centre long, d double")
                ranked = found.groupBy("nid", "centre").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(Window.partitionBy("nid").orderBy("d", "centre")))
                routes = ranked.filter(F.col("r") <= self.routes).select("nid", "centre")
        if level_routes:
            self._write(_union(level_routes), "routes", gen, "level", "centre")
        one = _union(level_links) if level_links else self.spark.createDataFrame([], LINK)
        one = one.withColumn("r", F.row_number().over(_nearest("level", "u"))).filter(F.col("r") <= self.degree).drop("r")
        both = scratch.write(one.unionByName(one.select("level", F.col("v").alias("u"), F.col("u").alias("v"), "d")).distinct(), "both")
        if links is not None:
            touched = self._write(both.select("level", "u").distinct(), "touched", gen)
            both = both.unionByName(links.join(touched, ["level", "u"], "left_semi").select(both.columns)).distinct()
        self._write(both.withColumn("r", F.row_number().over(_nearest("level", "u"))).filter(F.col("r") <= 2 * self.degree).drop("r"), "links", gen, "level", "u")

    def _top(self, nodes: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray]:
        rows = nodes.filter(F.col("level") >= top).select("nid", "v").orderBy("nid").toPandas()  # about TOP rows, by the choice of the level
        return rows["nid"].to_numpy(np.int64), np.stack(rows["v"].to_list()).astype(np.float32) if len(rows) else np.zeros((0, 1), np.float32)

    def _first_routes(self, new: DataFrame, top: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        return new.select("nid", "v").mapInArrow(_among(*top, self.routes), "nid long, centre long, d double").select("nid", "centre")

    def _dealt(self, placed: DataFrame, everywhere: DataFrame | None = None) -> DataFrame:
        """Members of cells, dealt to slices where they are too many; ``everywhere`` (the cell's own centres of the next level) stand in each slice."""
        counts = placed.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("_slices")).filter("_slices > 1")
        slices = F.coalesce("_slices", F.lit(1))
        dealt = placed.join(small(counts), "centre", "left").withColumn("slice", F.pmod(F.xxhash64("nid"), slices).cast("int")).drop("_slices")
        if everywhere is None:
            return dealt
        copies = everywhere.join(small(counts), "centre", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
        return dealt.withColumn("asks", F.lit(True)).unionByName(copies.withColumn("asks", F.lit(False)))

    def _link_cell(self):
        degree = self.degree

        def run(table: pa.Table) -> pa.Table:
            ids, new = table.column("nid").to_numpy(), table.column("new").to_numpy(zero_copy_only=False)
            if len(ids) < 2 or not new.any():
                return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
            x = _matrix(table.column("v"))
            d = _squares(x, x)
            picked = diverse(d, degree)
            row, place = np.nonzero((picked >= 0) & new[:, None])
            to = picked[row, place]
            return pa.table({"u": ids[row], "v": ids[to], "d": d[row, to].astype(np.float64)})

        return run

    def _route_cell(self):
        most = self.routes

        def run(table: pa.Table) -> pa.Table:
            ids, asks = table.column("nid").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
            asking, centres = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(centres) or not len(asking):
                return pa.table({"nid": pa.array([], pa.int64()), "centre": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
            x = _matrix(table.column("v"))
            d = _squares(x[asking], x[centres])
            near = np.argsort(d, axis=1, kind="stable")[:, :most]
            return pa.table({"nid": np.repeat(ids[asking], near.shape[1]), "centre": ids[centres[near]].ravel(), "d": np.take_along_axis(d, near, 1).ravel().astype(np.float64)})

        return run

    # --- changes -------------------------------------------------------------

    def insert(self, rows: DataFrame) -> LayeredIndex:
        """Add rows, link their nodes in both directions; rows with ids that are there replace them."""
        live = self.commits()
        if not live or self.nodes().isEmpty():
            return self.build(rows)
        scratch = Scratch(self.spark, "layered")
        held = scratch.write(self._usable(rows), "held")
        known = self.rows().join(held.select("id"), "id", "left_semi").select("id")
        if not (known := scratch.write(known, "known")).isEmpty():
            self.remove(known)
            live = self.commits()
            if self.nodes().isEmpty():
                return self.build(held.select("id", F.col("v").alias("embedding")))
        gen, top = live[-1]["gen"] + 1, live[-1]["top"]
        nodes, cells, links, placed = self.nodes(), self.cells(), self.links(), self.rows()
        met = scratch.write(held.join(nodes.select("v", "nid"), "v", "left"), "met")
        fresh = met.filter("nid is null").groupBy("v").agg(F.min("id").alias("nid"))
        # An id whose vector changed may still name an older node of other rows.
        free = max(nodes.agg(F.max("nid")).first()[0], held.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1
        taken = nodes.select("nid", F.lit(True).alias("taken"))
        fresh = fresh.join(taken, "nid", "left").withColumn("nid", F.when(F.col("taken"), F.lit(free) + F.monotonically_increasing_id()).otherwise(F.col("nid"))).drop("taken")
        fresh = self._write(fresh.withColumn("level", F.least(self._level(), F.lit(top))).select("nid", "v", "level"), "nodes", gen, "nid")
        self._write(met.filter("nid is not null").select("id", "nid").unionByName(met.filter("nid is null").select("id", "v").join(fresh, "v").select("id", "nid")), "rows", gen, "nid")
        self._write_graph(fresh, scratch.write(nodes.unionByName(fresh), "all"), gen, top, scratch, cells, links)
        self._commit(gen, False, top)
        return self

    def remove(self, ids: DataFrame) -> LayeredIndex:
        """Take rows away; nodes without rows go, and what linked to them is linked to their neighbours."""
        live = self.commits()
        if not live:
            return self
        gen, scratch = live[-1]["gen"] + 1, Scratch(self.spark, "layered")
        nodes, rows, links = self.nodes(), self.rows(), self.links()
        gone = self._write(ids.select(F.col("id").cast("long").alias("id")).distinct(), "gone", gen)
        left = rows.join(small(gone), "id", "left_anti").select("nid").distinct()
        hit = rows.join(small(gone), "id", "left_semi").select("nid").distinct()
        dead = self._write(hit.join(left, "nid", "left_anti"), "dead", gen)
        out = scratch.write(links.join(small(dead), F.col("v") == F.col("nid"), "left_semi"), "out")  # links to what is gone
        touched = out.select("level", "u").distinct().join(small(dead), F.col("u") == F.col("nid"), "left_anti")
        lost = links.join(small(dead), F.col("u") == F.col("nid"), "left_semi").select("level", "u")
        touched = self._write(touched.unionByName(lost.distinct()), "touched", gen)
        alive = touched.join(small(dead), F.col("u") == F.col("nid"), "left_anti")
        stays = links.join(alive, ["level", "u"], "left_semi").join(small(dead), F.col("v") == F.col("nid"), "left_anti").select("level", "u", "v", "d")
        # u -> gone -> w becomes u -> w.
        came = out.join(small(dead.withColumnRenamed("nid", "u")), "u", "left_anti").select("level", F.col("v").alias("gone"), F.col("u").alias("nid"), F.lit(True).alias("came"))
        went = links.join(small(dead), F.col("u") == F.col("nid"), "left_semi").join(small(dead), F.col("v") == F.col("nid"), "left_anti").select("level", F.col("u").alias("gone"), F.col("v").alias("nid"), F.lit(False).alias("came"))
        around = came.unionByName(went).join(nodes.select("nid", F.col("v").alias("x")), "nid")
        measured = around.groupBy("level", "gone").applyInArrow(_over, LINK)
        merged = stays.unionByName(measured).groupBy("level", "u", "v").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(_nearest("level", "u"))).filter(F.col("r") <= 2 * self.degree).drop("r")
        self._write(merged.select("level", "u", "v", "d"), "links", gen, "level", "u")
        self._commit(gen, False, live[-1]["top"])
        if nodes.filter(F.col("level") >= live[-1]["top"]).join(small(dead), "nid", "left_anti").isEmpty() and not self.nodes().isEmpty():
            self.rebuild()
        return self

    def rebuild(self) -> LayeredIndex:
        """The graph made anew from what the index holds; older generations go."""
        live, scratch = self.commits(), Scratch(self.spark, "layered")
        held = scratch.write(self.rows().join(self.nodes().select("nid", "v"), "nid").select("id", F.col("v").alias("embedding")), "held")
        self.build(held)
        for r in live:
            for table in TABLES:
                remove(self.spark, f"{self.path}/{table}/gen={r['gen']}")
        return self

    # --- search --------------------------------------------------------------

    def _walk(self, queries: DataFrame, beam: int, scratch: Scratch, tally: list[int] | None = None) -> DataFrame:
        """(qid, nid, d) of the nearest ``beam`` nodes that a search met on the lowest level; ``tally`` gets the number of nodes that were compared on each, those met again once.

        A query is a row with its nearest nodes so far, at most ``beam``. What a hop
        meets is measured in tasks and dropped there if it is farther than the last of
        a full row, so little comes back; a node that fell out of a row stays out,
        since the row's last only gets nearer.
        """
        live = self.commits()
        top = live[-1]["top"]
        nodes, links = self.nodes(), self.links()
        matrix = self._top(nodes, top)
        nodes = scratch.write(nodes.select("nid", "v"), "nodes")
        asked = scratch.write(queries.select("qid", F.col("v").alias("x")), "asked")
        near_asked = small(asked)
        width = max(16, self.routes)
        found = asked.select(F.col("qid").alias("nid"), F.col("x").alias("v")).mapInArrow(_among(*matrix, width if top else beam), "nid long, centre long, d double")
        first = found.groupBy(F.col("nid").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("d", F.col("centre").alias("nid")))).alias("b"))
        state = scratch.write(first.select("qid", F.col("b.nid").alias("ids"), F.col("b.d").alias("ds")), "start")
        if tally is not None:
            tally.append(asked.count() * len(matrix[0]))
        for level in range(top - 1, -1, -1):
            size = beam if level == 0 else width
            steps = scratch.write(links.filter(F.col("level") == level).select("u", F.col("v").alias("nid")), "steps")
            state = scratch.write(self._opened(state, width, size), "state")
            starts = state.select("qid", F.explode("ids").alias("nid")) if tally is None else scratch.write(state.select("qid", F.explode("ids").alias("nid")), "starts")
            met = []
            while not state.filter(F.size("front") > 0).isEmpty():
                pairs = state.select("qid", "bound", F.explode("front").alias("u")).join(steps, "u").select("qid", "bound", "nid")
                if tally is not None:
                    met.append(scratch.write(pairs.select("qid", "nid").distinct(), f"met{level}-{len(met)}"))
                placed = pairs.join(nodes, "nid").join(near_asked, "qid").select("qid", "nid", "bound", "v", "x")
                measured = placed.mapInArrow(_within_bound, "qid long, nid long, d double")
                merged = state.groupBy("qid").cogroup(measured.groupBy("qid")).applyInArrow(_merge(size, self.step), STATE)
                state = scratch.write(merged, "state")
            if tally is not None:
                tally.append(_union(met).distinct().join(starts, ["qid", "nid"], "left_anti").count() if met else 0)
        return state.select("qid", F.inline(F.arrays_zip(F.col("ids").alias("nid"), F.col("ds").alias("d"))))

    def _opened(self, state: DataFrame, width: int, size: int) -> DataFrame:
        """Queries at the start of a level: the nearest ``width`` nodes, of which the first are to be expanded."""
        kept = state.select("qid", F.slice("ids", 1, width).alias("ids"), F.slice("ds", 1, width).alias("ds"))
        bound = F.when(F.size("ds") >= size, F.get("ds", F.lit(size - 1))).otherwise(F.lit(math.inf))
        return kept.select("qid", "ids", "ds", F.transform("ids", lambda _, i: i < min(self.step, size)).alias("done"), F.slice("ids", 1, min(self.step, size)).alias("front"), bound.alias("bound"))

    def _asked(self, queries: DataFrame) -> DataFrame:
        return self._usable(queries.select(F.col("qid").alias("id"), "embedding")).select(F.col("id").alias("qid"), "v")

    def search_batch(self, queries: DataFrame, k: int, *, beam: int | None = None) -> DataFrame:
        """(qid, rank, id, distance) for queries of (qid, embedding)."""
        out = "qid long, rank int, id long, distance double"
        if not self.commits() or self.nodes().isEmpty():
            return self.spark.createDataFrame([], out)
        scratch = Scratch(self.spark, "layered-search")
        seen = self._walk(self._asked(queries), max(beam or self.beam, k), scratch)
        best = seen.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("d", "nid"))).filter(F.col("r") <= k).drop("r")
        # Of a node's copies the k smallest ids are enough.
        copies = self.rows().join(small(best.select("nid").distinct()), "nid", "left_semi").withColumn("c", F.row_number().over(Window.partitionBy("nid").orderBy("id"))).filter(F.col("c") <= k)
        distance = F.col("d") / 2 if self.metric == "cosine" else F.sqrt("d")
        hits = best.join(copies, "nid").select("qid", "id", distance.alias("distance"))
        return hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("distance", 7), "id"))).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")

    def search(self, query: list[float], k: int, *, beam: int | None = None) -> DataFrame:
        """(id, distance) of one query."""
        asked = self.spark.createDataFrame([(0, [float(x) for x in query])], "qid long, embedding array<double>")
        return self.search_batch(asked, k, beam=beam).orderBy("rank").select("id", "distance")

    def compared(self, queries: DataFrame, k: int, *, beam: int | None = None) -> float:
        """Share of the nodes that a search compares a query with, on average."""
        tally: list[int] = []
        asked = self._asked(queries)
        self._walk(asked, max(beam or self.beam, k), Scratch(self.spark, "layered-search"), tally)
        return sum(tally) / max(asked.count() * self.nodes().count(), 1)


def _nearest(*keys: str):
    return Window.partitionBy(*keys).orderBy("d", "v")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of two matrices, row by row."""
    return ((x.astype(np.float64) - y.astype(np.float64)) ** 2).sum(axis=1)


def _within_bound(batches):
    """(qid, nid, d) of pairs (qid, nid, bound, v, x) that are within their bound."""
    for batch in batches:
        if batch.num_rows:
            d = _apart(_matrix(batch.column("v")), _matrix(batch.column("x")))
            near = np.flatnonzero(d <= batch.column("bound").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(near)), batch.column("nid").take(pa.array(near)), pa.array(d[near])], ["qid", "nid", "d"])


def _merge(size: int, step: int):
    """A query's row with what a hop measured: the nearest ``size``, and which of them are expanded next."""

    def run(rows: pa.Table, measured: pa.Table) -> pa.Table:
        old, new = rows.column("ids")[0].values.to_numpy(), measured.column("nid").to_numpy()
        ids, at = np.unique(np.concatenate([old, new]), return_index=True)  # of equal ids the first, so that of the row
        ds = np.concatenate([rows.column("ds")[0].values.to_numpy(), measured.column("d").to_numpy()])[at]
        done = np.concatenate([rows.column("done")[0].values.to_numpy(zero_copy_only=False), np.zeros(len(new), bool)])[at]
        near = np.lexsort((ids, ds))[:size]
        ids, ds, done = ids[near], ds[near], done[near]
        front = np.flatnonzero(~done)[:step]
        done[front] = True
        columns = [rows.column("qid").combine_chunks(), pa.array([ids]), pa.array([ds]), pa.array([done]), pa.array([ids[front]], pa.list_(pa.int64())), pa.array([ds[-1] if len(ds) == size else math.inf])]
        return pa.Table.from_arrays(columns, ["qid", "ids", "ds", "done", "front", "bound"])

    return run


def _over(table: pa.Table) -> pa.Table:
    """Links from the nodes that linked to one that is gone to those that it linked to."""
    ids, came, x = table.column("nid").to_numpy(), table.column("came").to_numpy(zero_copy_only=False), _matrix(table.column("x"))
    to, level = np.flatnonzero(~came), table.column("level")[0].as_py()
    parts = []
    for i in np.flatnonzero(came):
        other = to[ids[to] != ids[i]]
        parts.append((np.full(len(other), ids[i]), ids[other], _apart(x[i : i + 1], x[other])))
    u, v, d = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.table({"level": pa.array(np.full(len(u), level), pa.int32()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "d": pa.array(d, pa.float64())})


def _among(ids: np.ndarray, matrix: np.ndarray, most: int):
    """The nearest of a few vectors, for each row (nid, v)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            x = _matrix(batch.column(1))
            near = np.argsort(_squares(x, matrix), axis=1, kind="stable")[:, :most]
            d = _apart(np.repeat(x, near.shape[1], axis=0), matrix[near.ravel()])  # as in the hops
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), near.shape[1])), pa.array(ids[near].ravel()), pa.array(d)], ["nid", "centre", "d"]
            )

    return run
