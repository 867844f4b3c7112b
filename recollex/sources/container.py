"""Containers: tagged chunks of a store in one folder, each with its hash, a header and a manifest written last; packs and backups.

::

    header/            JSON: magic, version, created
    chunk=<tag>/       Parquet with zstd, one folder a kind of data
    manifest/          JSON: tag, rows, digest; a folder without it is no container
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.operators.textindex import TextIndex
from recollex.sources.snapshots import _digest
from recollex.storage import exists, remove

MAGIC, VERSION = "RCXC", 1
KINDS = ("docs", "vectors", "edges", "memories", "events", "text-index")


class Writer:
    """Adds chunks, then closes with the manifest."""

    def __init__(self, spark: SparkSession, path: str, created: int = 0):
        self.spark, self.path, self.rows = spark, path, []
        remove(spark, path)
        spark.range(1).select(F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.lit(created).cast("long").alias("created")).coalesce(1).write.json(f"{path}/header")

    def add(self, tag: str, rows: DataFrame) -> Writer:
        if tag not in KINDS:
            raise ValueError(f"a chunk is one of {KINDS}")
        rows.write.option("compression", "zstd").parquet(f"{self.path}/chunk={tag}")
        self.rows.append((tag, *_digest(self.spark.read.parquet(f"{self.path}/chunk={tag}"))))
        return self

    def add_text_index(self, docs: DataFrame) -> Writer:
        """The inverted index of documents, to search the container without reading its texts."""
        TextIndex(self.spark, f"{self.path}/chunk=text-index").build(docs)
        return self

    def close(self) -> None:
        self.spark.createDataFrame(self.rows, "tag string, n long, digest string").coalesce(1).write.json(f"{self.path}/manifest")


class Reader:
    """Opens a container; ``verify`` compares every chunk with the manifest."""

    def __init__(self, spark: SparkSession, path: str):
        if not exists(spark, f"{path}/manifest"):
            raise ValueError("not a whole container: it has no manifest")
        head = spark.read.schema("magic string, version int, created long").json(f"{path}/header").first()
        if head is None or head["magic"] != MAGIC:
            raise ValueError("not a container")
        if head["version"] > VERSION:
            raise ValueError(f"containers of version {head['version']} can't be read")
        self.spark, self.path, self.created = spark, path, head["created"]
        self.tags = {r["tag"]: (r["n"], r["digest"]) for r in spark.read.schema("tag string, n long, digest string").json(f"{path}/manifest").collect()}  # one row a kind

    def chunk(self, tag: str) -> DataFrame:
        if tag not in self.tags:
            raise KeyError(tag)
        return self.spark.read.parquet(f"{self.path}/chunk={tag}")

    def verify(self) -> list[str]:
        """Tags whose chunks aren't what the manifest says."""
        return [tag for tag, told in self.tags.items() if _digest(self.chunk(tag)) != told]

    def search(self, query: str, limit: int) -> DataFrame:
        return TextIndex(self.spark, f"{self.path}/chunk=text-index").search(query, limit)


def pack(spark: SparkSession, path: str, out: str) -> int:
    """A container's chunks compressed harder, with the manifest that its reader checks; returns the rows."""
    reader = Reader(spark, path)
    writer, n = Writer(spark, out, reader.created), 0
    for tag in reader.tags:
        rows = reader.chunk(tag)
        rows.coalesce(max(1, rows.rdd.getNumPartitions() // 4)).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "19").parquet(f"{out}/chunk={tag}")
        writer.rows.append((tag, *_digest(spark.read.parquet(f"{out}/chunk={tag}"))))
        n += writer.rows[-1][1]
    writer.close()
    if {t: v for t, *v in writer.rows} != {t: list(v) for t, v in reader.tags.items()}:
        raise ValueError("the pack isn't what was packed")
    return n


def unpack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Chunks of a pack by tag, checked."""
    reader = Reader(spark, path)
    if bad := reader.verify():
        raise ValueError(f"broken chunks: {bad}")
    return {tag: reader.chunk(tag) for tag in reader.tags}


def backup(spark: SparkSession, tables: dict[str, DataFrame], folder: str, day: str) -> str:
    """A container of all tables in a folder of the day's name; returns its path."""
    path = f"{folder}/backup-{day}"
    writer = Writer(spark, path)
    for tag, rows in tables.items():
        writer.add(tag, rows)
    writer.close()
    return path
