"""Scratch tables in the folder that all machines of the cluster share.

The folder is the one named by ``spark.checkpoint.dir``. A session of one machine
(tests, notebooks) without that setting gets a local one that goes away with the
process; on a cluster its absence is an error, since executors would not find what
others wrote.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared scratch folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if sc.applicationId not in _OWN:
        path = tempfile.mkdtemp(prefix="recollex-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[sc.applicationId] = f"file://{path}"
        sc.setCheckpointDir(_OWN[sc.applicationId])
    return _OWN[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/recollex/{label}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Length and time of the last change of a file or folder."""
    fs, p = _hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a later stage that loses an executor reads the files
    again instead of computing what made them.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 100_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counted up to there."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which is checked; else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if few(df, rows) else df


class Scratch:
    """Names the tables of an iterative job, so that spent ones can be dropped."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.live = spark, label, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, f"{self.label}-{name}")
        out = materialize(df, name, path)
        if name in self.live:
            remove(self.spark, self.live.pop(name))
        self.live[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.live:
                remove(self.spark, self.live.pop(name))
