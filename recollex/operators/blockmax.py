"""Sparse vectors in blocks with their greatest weights: exact top-k that skips most blocks.

Documents are ordered by the sum of their weights, heaviest first, and cut into
ranges of ``block`` documents; a block is what a term has in a range. A folder
holds, for each generation of added rows::

    blocks/gen=<n>/zone=<z>/   term, range, entries (id, weight), top, low, n; a zone is ``ZONE`` ranges
    commits/<n>/            written last: the ranges that the generation starts and ends with

No document of a range scores more than the sum of what its blocks' greatest
weights give (or least ones, where a query's weight is negative). A search first
scores the ranges with the greatest bounds, which yields a lower bound of the k-th
score, and then only those whose own bound reaches it. Answers are exact: with few
hits in the first pass all ranges are opened.

Ranges hold at most ``block`` documents, so a term that every document has is no
larger a group than another. Many queries are asked at a time; heads (blocks without
their entries) and blocks meet them in joins. Documents are moved once, as whole rows,
to the task that writes their range; of what a search opens each range is scored in
one task, which hands on its best alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.operators.ordering import with_positions
from recollex.storage import Scratch, exists, small

BLOCK = 128
ZONE = 256
#: Ranges of the first pass, at least.
LEAD = 4
#: More distinct terms or zones than this are joined instead of named in the scan's filter.
NAMED = 1000
#: Entries that are dealt together; places of documents, or opened ranges, that are sent to all tasks.
DEALT, PLACES = 1_000_000, 4_000_000
COMMIT = "gen int, first long, last long, docs long"


class BlockMaxIndex:
    """Index of sparse vectors (id, term, weight) under ``path``."""

    def __init__(self, spark: SparkSession, path: str, *, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path, block

    def commits(self) -> list:
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").json(f"{self.path}/commits").orderBy("gen").collect()  # one row an addition

    def add(self, rows: DataFrame) -> BlockMaxIndex:
        """Add documents whose ids are not in the index yet; null terms and weights, and weights of zero, are left out."""
        rows = rows.filter("id is not null and term is not null and weight <> 0").groupBy("id", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        return self.add_rows(rows.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("entries")))

    def add_rows(self, rows: DataFrame) -> BlockMaxIndex:
        """Add documents as rows (id, entries (term, weight)), one a document, whose terms differ and have weights other than zero."""
        live = self.commits()
        gen, first = (live[-1]["gen"] + 1, live[-1]["last"] + 1) if live else (0, 0)
        scratch = Scratch(self.spark, "blockmax")
        rows = scratch.write(rows.filter("id is not null and size(entries) > 0").select("id", "entries"), "rows")
        sizes = rows.select("id", F.aggregate("entries", F.lit(0.0), lambda s, e: s + F.abs(e["weight"])).alias("size"), F.size("entries").cast("long").alias("n"))
        placed = with_positions(sizes, F.desc("size"), "id", position="at", total="n")
        placed = scratch.write(placed.select("id", (F.lit(first) + F.floor((F.col("at") - 1) / self.block)).cast("long").alias("range"), "used"), "placed")
        deals = placed.groupBy("range").agg(F.floor(F.max("used") / DEALT).alias("deal"))
        dealt = rows.join(small(placed.join(small(deals), "range").select("id", "range", "deal"), PLACES), "id").repartition("deal")
        each = dealt.select("deal", F.floor(F.col("range") / ZONE).cast("int").alias("zone"), "range", "id", F.inline("entries"))
        blocks = each.groupBy("deal", "zone", "term", "range").agg(
            F.array_sort(F.collect_list(F.struct("id", "weight"))).alias("entries"), F.max("weight").alias("top"), F.min("weight").alias("low"), F.count(F.lit(1)).cast("int").alias("n")
        )
        blocks.drop("deal").sortWithinPartitions("zone", "term", "range").write.mode("overwrite").partitionBy("zone").parquet(f"{self.path}/blocks/gen={gen}")
        docs, last = placed.agg(F.count(F.lit(1)), F.coalesce(F.max("range"), F.lit(first - 1))).first()
        row = self.spark.range(1).select(F.lit(gen).alias("gen"), F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(docs).alias("docs"))
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/commits/{gen}")
        scratch.drop("rows", "placed")
        return self

    def _read(self, what: str, schema: str) -> DataFrame:
        held = [r["gen"] for r in self.commits() if r["docs"]]
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/gen={g}" for g in held])

    def heads(self) -> DataFrame:
        return self._read("blocks", "term string, range long, top double, low double, n int")

    def blocks(self) -> DataFrame:
        return self._read("blocks", "term string, range long, entries array<struct<id: long, weight: double>>, zone int")

    def _named(self, rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
        """Rows with one of the values, named in the filter where they are few, so that the scan can skip."""
        found = values.select(column).distinct().limit(NAMED + 1).collect()
        return rows.filter(F.col(column).isin([r[0] for r in found])) if len(found) <= NAMED else rows

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(qid, range, bound): no document of the range has a higher score for the query."""
        most = F.greatest(F.lit(0.0), F.col("q") * F.col("top"), F.col("q") * F.col("low"))
        met = self._named(self.heads(), "term", queries).join(small(queries), "term")
        # Sums in another order may differ in their last digits.
        return met.groupBy("qid", "range").agg((F.sum(most) * (1 + 1e-9) + 1e-8).alias("bound"), F.sum("n").alias("postings"))

    def _scores(self, queries: DataFrame, opened: DataFrame) -> DataFrame:
        """(qid, id, score) of the documents in the opened (qid, range) that share a term with the query."""
        near = opened.withColumn("zone", F.floor(F.col("range") / ZONE).cast("int"))
        held = self._named(self._named(self.blocks(), "zone", near), "term", queries)
        held = self._named(held, "range", near)
        held = held.join(small(queries.select("term").distinct()), "term", "left_semi").join(small(near.select("range").distinct()), "range", "left_semi")
        met = held.select("term", "range", "entries").repartition("range").join(small(queries), "term").join(small(near.select("qid", "range"), PLACES), ["qid", "range"])
        scored = met.select("qid", "range", "q", F.inline("entries")).groupBy("range", "qid", "id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
        return scored.select("qid", "id", "score")

    def passes(self, queries: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(qid, range) opened first, the hits in them, and (qid, range) that is opened after."""
        bounds = scratch.write(self.bounds(queries), "bounds")
        lead = max(LEAD, -(-2 * k // self.block))
        order = Window.partitionBy("qid").orderBy(F.desc("bound"), "range")
        ranked = scratch.write(bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= lead).drop("r"), "lead")
        first = scratch.write(self._scores(queries, ranked), "first")
        last = first.withColumn("r", F.row_number().over(best_first())).filter(F.col("r") == k).select("qid", F.col("score").alias("least"))
        rest = bounds.join(ranked.select("qid", "range"), ["qid", "range"], "left_anti").join(small(last), "qid", "left").filter("least is null or bound >= least")
        return ranked, first, rest.select("qid", "range", "postings")

    def search_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, rank, id, score) for queries of (qid, term, q): greatest sums of products, ties to the smaller id."""
        scratch = Scratch(self.spark, "blockmax-search")
        queries = scratch.write(queries.filter("qid is not null and term is not null and q <> 0").groupBy("qid", "term").agg(F.sum(F.col("q").cast("double")).alias("q")), "queries")
        _, first, rest = self.passes(queries, k, scratch)
        hits = first.unionByName(self._scores(queries, scratch.write(rest, "rest")))
        return hits.withColumn("rank", F.row_number().over(best_first())).filter(F.col("rank") <= k).select("qid", "rank", "id", "score")

    def search(self, query: dict[str, float], k: int) -> DataFrame:
        """(id, score) of one query."""
        rows = [(0, t, float(w)) for t, w in sorted(query.items())]
        asked = self.spark.createDataFrame(rows, "qid long, term string, q double")
        return self.search_batch(asked, k).orderBy("rank").select("id", "score")

    def work(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """Blocks of the queries' terms, and those that a search opens."""
        scratch = Scratch(self.spark, "blockmax-work")
        lead, _, rest = self.passes(queries, k, scratch)
        met = self.heads().join(queries, "term").select("qid", "range")
        opened = lead.select("qid", "range").unionByName(rest.select("qid", "range"))
        return met.count(), met.join(opened, ["qid", "range"], "left_semi").count()


def best_first():
    return Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "id")
