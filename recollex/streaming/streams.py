"""Streams over folders of Parquet files, with event time in ``ts`` (timestamp)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollex.operators.events import dedup_key
from recollex.operators.predicates import live_filter

LATE = "10 minutes"


def read_folder(spark: SparkSession, path: str, schema, *, files: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most ``files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def change_feed(events: DataFrame, *, title: str | None = None, uri_prefix: str | None = None) -> DataFrame:
    """Puts that a subscriber asked for. At least once, where a broker in memory would drop the oldest."""
    return live_filter(events, title=title, uri_prefix=uri_prefix)


def distinct_events(events: DataFrame, late: str = LATE) -> DataFrame:
    """The first of equal events within the watermark; replays add nothing."""
    return events.withColumn("dedup_key", dedup_key()).withWatermark("ts", late).dropDuplicatesWithinWatermark(["dedup_key"])


def tumbling(events: DataFrame, size: str, by: str, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), by, "n", "value")


def sliding(events: DataFrame, size: str, step: str, by: str, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_windows(events: DataFrame, gap: str, by: str, late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def newest_operations(ops: DataFrame) -> DataFrame:
    """Running last operation of each document by (ts, op_id)."""
    return ops.groupBy("doc_id").agg(F.max(F.struct("ts", "op_id", "kind", "payload")).alias("o")).select("doc_id", "o.*")


def run_once(stream: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything there is now, as a table in memory; for tests and small feeds."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def worker(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Call ``each`` with every batch and its number; a batch may come again after a failure, under its number."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def extract_worker(queue: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Take texts (doc_id, text) from a queue, type them, and write each batch under its number."""
    from recollex.functions.text import memory_type

    def each(batch: DataFrame, number: int) -> None:
        kind, weight = memory_type(F.col("text"))
        batch.select("doc_id", kind.alias("memory_type"), weight.alias("confidence")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return worker(queue, each, checkpoint)


def graph_feed(relations: DataFrame, *, node: str | None = None) -> DataFrame:
    """Relate and unrelate events (op, from_uri, to_uri, rel, ts) that touch a node, or all."""
    known = relations.filter(F.col("op").isin("relate", "unrelate"))
    return known if node is None else known.filter((F.col("from_uri") == node) | (F.col("to_uri") == node))


def poll(sources: DataFrame, now: int, limit: int, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One round over polling sources (id, interval, last_sync): what the due ones give, and the sources after it."""
    from recollex.operators.corpus import due_sources

    due = due_sources(sources, now, limit).select("id")
    after = sources.join(due.withColumn("_due", F.lit(True)), "id", "left").withColumn("last_sync", F.when(F.col("_due"), F.lit(now)).otherwise(F.col("last_sync"))).drop("_due")
    return fetch(due), after
