"""Documents in files: title, uri, text, meta from CSV, TSV, JSON lines, JSON, Parquet and SQLite; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.session import small_batches

# File endings of each format.
ENDINGS = {"csv": "csv", "tsv": "tsv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json", "parquet": "parquet", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite"}
REFUSED = {"lance": "convert it to Parquet first", "qdrant": "export its points as JSON lines first"}
COLUMNS = ("title", "uri", "text", "meta")
#: Characters in a SQLite file, about: files are read and written whole.
FILE_CHARS = 1 << 24


def detect(path: str, forced: str | None = None) -> str:
    """Format of a file by its ending, unless forced."""
    name = (forced or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if name in REFUSED:
        raise ValueError(f"{name} files can't be read: {REFUSED[name]}")
    if name in ENDINGS:
        return ENDINGS[name]
    raise ValueError(f"unknown format: {name}")


def _normal(rows: DataFrame) -> DataFrame:
    """The four columns, found without regard to case; text is needed, empty text drops out, blanks are null, broken metadata is null."""
    found = {c.lower(): c for c in reversed(rows.columns)}
    if "text" not in found:
        raise ValueError("there is no column text")

    def column(name: str) -> Column:
        if name not in found:
            return F.lit(None).cast("string")
        raw = F.col(f"`{found[name]}`")
        kind = rows.schema[found[name]].dataType.typeName()
        return F.to_json(raw) if kind in ("struct", "map", "array") else raw.cast("string")

    meta = column("meta")
    return rows.select(
        F.nullif(F.trim(column("title")), F.lit("")).alias("title"), F.nullif(F.trim(column("uri")), F.lit("")).alias("uri"), column("text").alias("text"),
        F.when(F.try_parse_json(meta).isNotNull(), meta).alias("meta"),
    ).filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def read_documents(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(title, uri, text, meta) of a file or folder."""
    kind = detect(path, fmt)
    if kind in ("csv", "tsv"):
        rows = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", multiLine=True, escape='"', mode="PERMISSIVE")
    elif kind == "jsonl":
        rows = spark.read.json(path, mode="FAILFAST")
    elif kind == "json":
        rows = spark.read.json(path, multiLine=True, mode="FAILFAST")
    elif kind == "parquet":
        rows = spark.read.parquet(path)
    else:
        rows = read_sqlite(spark, path)
    return _normal(rows)


def write_documents(docs: DataFrame, path: str, fmt: str | None = None) -> None:
    """Documents ordered by id. CSV and TSV leave out the metadata and write null as empty."""
    kind, ordered = detect(path, fmt), docs.orderBy("id")
    if kind in ("csv", "tsv"):
        flat = ordered.select("id", "title", "uri", "text", "ts").fillna("")
        flat.write.mode("overwrite").csv(path, header=True, sep="\t" if kind == "tsv" else ",", escape='"', quoteAll=True)
    elif kind in ("jsonl", "json"):
        ordered.select("id", "title", "uri", "text", F.try_parse_json("meta").alias("meta"), "ts").select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    elif kind == "parquet":
        ordered.select("id", "title", "uri", "text", "meta", "ts").write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"{kind} files are only read")


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, uri, text, meta) of the docs tables of SQLite files (a file or a folder of them), which are read as bytes: no path is opened by an executor."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches):
        import sqlite3

        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                there = {row[1] for row in db.execute("pragma table_info(docs)")}
                columns = ", ".join(c if c in there else f"null as {c}" for c in ("id", *COLUMNS))
                rows = db.execute(f"select {columns} from docs")
                while part := rows.fetchmany(200):
                    yield pd.DataFrame(part, columns=["id", *COLUMNS])
                db.close()

    return files.mapInPandas(run, "id long, title string, uri string, text string, meta string")


def write_sqlite(docs: DataFrame, path: str) -> DataFrame:
    """A folder of SQLite files of about ``FILE_CHARS`` characters, so that a task holds one such file; returns (name, n) of them."""
    small_batches(docs.sparkSession)

    def run(batches):
        import sqlite3
        import uuid

        import pandas as pd
        from pyarrow import fs

        def opened():
            db = sqlite3.connect(":memory:")
            db.execute("create table docs (id integer primary key, title text, uri text, text text, meta text)")
            return db

        def kept(db, n):
            db.commit()
            system, folder = fs.FileSystem.from_uri(path)
            system.create_dir(folder, recursive=True)
            name, mine = f"part-{uuid.uuid4().hex}.db", f"{folder}/.{uuid.uuid4().hex}"
            with system.open_output_stream(mine, compression=None) as f:
                f.write(db.serialize())
            system.move(mine, f"{folder}/{name}")
            db.close()
            return pd.DataFrame({"name": [name], "n": [n]})

        db, n, size = opened(), 0, 0
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                db.execute("insert into docs values (?, ?, ?, ?, ?)", tuple(row))
                n, size = n + 1, size + sum(len(c) for c in row[1:] if c)
                if size >= FILE_CHARS:
                    yield kept(db, n)
                    db, n, size = opened(), 0, 0
        if n:
            yield kept(db, n)

    from recollex.storage import materialize

    written = docs.select("id", "title", "uri", "text", "meta").mapInPandas(run, "name string, n long")
    return materialize(written, "sqlite-files")  # read back, so that no file is written twice


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Read, keep the first of equal texts, number them, and write."""
    from recollex.operators.corpus import put

    docs = read_documents(spark, source).withColumn("id", F.monotonically_increasing_id()).withColumn("ts", F.lit(0).cast("long"))
    write_documents(put(docs).drop("hash"), target)
