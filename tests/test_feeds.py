"""Polled sources: who is due, in one round and over restarts, and what can't be read."""

import pytest

from recollex.operators import corpus
from recollex.sources import feeds

REGISTRY = "id long, uri string, interval long"


def _registry(spark, path, rows):
    spark.createDataFrame(rows, REGISTRY).repartition(2).write.parquet(f"file://{path}/registry")
    spark.dataSource.register(feeds.PolledFeeds)
    return f"file://{path}/registry"


def _feed(path, name, *titles):
    items = "".join(f"<item><title>{t}</title><link>http://x/{t}</link><description>about {t}</description></item>" for t in titles)
    (path / name).write_text(f"<rss><channel>{items}</channel></rss>")
    return f"file://{path}/{name}"


def test_one_round(spark, tmp_path):
    a, b = _feed(tmp_path, "a.xml", "one", "two"), _feed(tmp_path, "b.xml", "three")
    registry = _registry(spark, tmp_path, [(1, a, 100), (2, b, 70), (3, f"file://{tmp_path}/none.xml", 10), (4, None, 5), (5, a, 0), (6, a, None), (-7, b, 1000)])

    def due(**options):
        return spark.read.format("polled_feeds").option("registry", registry).options(**options).load()

    first = {r["id"]: r for r in due(until=50).collect()}
    assert set(first) == {1, 2, 3, -7} and first[3]["body"] is None and "NotFound" in first[3]["error"] and first[1]["polled"] == 50
    assert {r["id"] for r in due(after=105, until=145, partitions=3).collect()} == {2, 3}
    assert {r["id"] for r in due(after=199, until=200).collect()} == {1, 3}
    assert due(after=200, until=200).count() == 0
    items = corpus.rss_items(due(until=50).filter("error is null"))
    assert {r["title"] for r in items.collect()} == {"one", "two", "three"}
    assert due(until=50).rdd.getNumPartitions() == 8


def test_missing_options(spark, tmp_path):
    spark.dataSource.register(feeds.PolledFeeds)
    with pytest.raises(Exception, match="registry"):
        spark.read.format("polled_feeds").load().collect()


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    a, b = _feed(tmp_path, "a.xml", "one"), _feed(tmp_path, "b.xml", "two")
    registry = _registry(spark, tmp_path, [(1, a, 100), (2, b, 1000)])
    clock = tmp_path / "clock"

    def step(second):
        clock.write_text(str(second))
        rows = spark.readStream.format("polled_feeds").option("registry", registry).option("clock", f"file://{clock}").load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start(f"{tmp_path}/out").awaitTermination()
        return sorted((r["polled"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert step(150) == [(150, 1), (150, 2)]
    assert step(199) == [(150, 1), (150, 2)]  # no turn in between
    _feed(tmp_path, "a.xml", "new")
    assert step(450) == [(150, 1), (150, 2), (450, 1)]  # three turns passed, one fetch
    assert step(1000) == [(150, 1), (150, 2), (450, 1), (1000, 1), (1000, 2)]
    assert {r["body"].count("<title>new<") for r in spark.read.parquet(f"{tmp_path}/out").filter("id = 1 and polled >= 450").collect()} == {1}
