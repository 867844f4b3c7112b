"""Keyed state of streams: counts over batches, timers, time to live, restarts."""

import time

from pyspark.sql import functions as F

from recollex.streaming import state


def _put(spark, path, name, rows):
    shape = "s long, session_id string, kind string"
    spark.createDataFrame(rows, shape).select(F.timestamp_seconds("s").alias("ts"), "session_id", "kind").coalesce(1).write.parquet(f"{path}/in/{name}")


def _step(spark, path, make, *, once=False):
    """The stream from where it stopped to the end of what there is; all rows it ever gave."""
    rows = spark.readStream.schema("ts timestamp, session_id string, kind string").option("recursiveFileLookup", "true").parquet(f"{path}/in")

    def each(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    make(rows).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(**{"once" if once else "availableNow": True}).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_session_state_over_restarts_and_timers(spark, tmp_path):
    def sessions(e):
        return state.session_state(e, idle=1000, late="0 seconds")

    def rows():
        return {(r["session_id"], r["n"], r["first"], r["last"], tuple(sorted(r["kinds"].items())), r["closed"]) for r in _step(spark, tmp_path, sessions).collect()}

    _put(spark, tmp_path, "1", [(100, "a", "view"), (50, "a", "click"), (100, "b", None)])
    first = rows()
    assert {("a", 2, 50, 100, (("click", 1), ("view", 1)), False), ("b", 1, 100, 100, (("", 1),), False)} == first
    _put(spark, tmp_path, "2", [(700, "a", "view")])
    second = rows()
    assert second - first == {("a", 3, 50, 700, (("click", 1), ("view", 2)), False)}
    # 1500 is past b's 1100 and before a's 1700: b alone ends, with what it had.
    _put(spark, tmp_path, "3", [(1500, "c", "view")])
    third = rows()
    assert third - second == {("c", 1, 1500, 1500, (("view", 1),), False), ("b", 1, 100, 100, (("", 1),), True)}
    # b starts anew.
    _put(spark, tmp_path, "4", [(1600, "b", "buy")])
    assert rows() - third == {("b", 1, 1600, 1600, (("buy", 1),), False)}


def test_odd_events(spark, tmp_path):
    shape = "s long, session_id string, kind string"
    odd = spark.createDataFrame([(None, "a", "x"), (5, None, "x"), (5, None, "x")], shape).select(F.timestamp_seconds("s").alias("ts"), "session_id", "kind")
    odd.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    got = _step(spark, tmp_path, lambda e: state.session_state(e, idle=10))
    assert {(r["session_id"], r["n"]) for r in got.collect()} == {(None, 2)}


def test_feedback_by_time_to_live(spark, tmp_path):
    def packs(e):
        return state.feedback_state(e.select("ts", F.col("session_id").alias("pack_id"), (F.col("kind") == "yes").alias("accepted")), keep=3, clock="processing")

    _put(spark, tmp_path, "1", [(1, "p", "yes"), (2, "p", None)])
    assert [(r["shown"], r["accepted"], r["last"]) for r in _step(spark, tmp_path, packs, once=True).collect()] == [(2, 1, 2)]
    time.sleep(4)
    _put(spark, tmp_path, "2", [(3, "p", "no")])
    assert sorted((r["shown"], r["accepted"], r["last"]) for r in _step(spark, tmp_path, packs, once=True).collect()) == [(1, 0, 3), (2, 1, 2)]


def test_feedback_by_event_time(spark, tmp_path):
    def packs(e):
        return state.feedback_state(e.select("ts", F.col("session_id").alias("pack_id"), (F.col("kind") == "yes").alias("accepted")), keep=100, late="0 seconds")

    _put(spark, tmp_path, "1", [(1, "p", "yes"), (1, "q", "yes")])
    _step(spark, tmp_path, packs)
    _put(spark, tmp_path, "2", [(90, "q", "yes"), (150, "r", "no")])
    _step(spark, tmp_path, packs)
    _put(spark, tmp_path, "3", [(160, "p", "yes"), (160, "q", "yes")])
    got = {(r["pack_id"], r["shown"], r["last"]) for r in _step(spark, tmp_path, packs).collect()}
    assert {("p", 1, 160), ("q", 3, 160)} <= got
