"""Token counts kept up to date by signed deltas.

A store is a folder in shared storage::

    ledger/batch=<batch>/bucket=<n>/   signed rows of documents: doc_id, source, lang, tokenizer, n_tokens, sign
    changes/<batch>/  what the batch asks for, one row a document
    deltas/<batch>/   signed totals of the batch: source, lang, tokenizer, n_docs, n_tokens
    commits/<batch>/  written last; a batch without it does not exist

A batch holds inserts, deletes and revised counts. A document that the ledger
holds is taken back with a minus sign before its new row comes with a plus sign,
so totals are sums of deltas and never recounted. A batch is committed once:
applying it again does nothing, and one that broke off is written again from the
start. A batch reads the ledger's buckets that its documents are in. ``compact``
folds the committed ledgers and deltas into one of each, by the same protocol, and
removes the folded ones, so that the ledger keeps to the documents there are.

Defined results. A change is an insert, a delete or a revise; if the one that
counts for a document is anything else, null included, the batch is refused and
nothing of it committed. Of several changes to one document in a batch the one with the
greatest ``seq`` counts, then the greatest row. An insert of a known document
replaces it, a delete of an unknown one does nothing, a revision of an unknown one
inserts it. Changes without a doc_id are ignored. Null source, lang or tokenizer
are groups of their own; null counts are 0. Repeated rows are one change. An empty
batch is committed and adds nothing; totals of an empty store are an empty table.
Groups whose documents are all gone leave the totals. Texts of any length are
counted whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollex.storage import exists, materialize, remove

GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, n_tokens long, sign int"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
COMMIT = "batch string, name string, replaces array<string>"
OPS = ("insert", "delete", "revise")
#: Folders that a ledger's documents are dealt to.
BUCKETS = 32
#: Rows of a ledger file.
FILE_ROWS = 4_000_000


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")


class RollupStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @staticmethod
    def _name(batch: str) -> str:
        """A folder name for any batch id."""
        return re.sub(r"[^A-Za-z0-9-]", "-", batch)[:40] + "-" + hashlib.sha256(batch.encode()).hexdigest()[:16]

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.range(0).selectExpr(*[f"cast(null as {x.split(' ', 1)[1]}) as {x.split(' ', 1)[0]}" for x in schema.split(", ")])
        if kind == "ledger":
            found = self.spark.read.schema(f"{schema}, batch string, bucket int").option("basePath", f"{self.path}/ledger")
            return found.parquet(*[f"{self.path}/ledger/batch={n}" for n in names]).drop("batch")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def committed(self) -> list[tuple[str, str, list[str]]]:
        """(batch, folder name, folder names it replaces) of each commit: one row a batch."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.path}/commits").collect()
        return [(r["batch"], r["name"], list(r["replaces"])) for r in rows]

    def _commit(self, batch: str, name: str, replaces: list[str]) -> None:
        row = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(name).alias("name"), F.array(*[F.lit(x) for x in replaces]).cast("array<string>").alias("replaces"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")

    def _live(self) -> list[str]:
        """Folder names of the batches and compactions that no compaction has replaced."""
        done = self.committed()
        replaced = {x for _, _, replaces in done for x in replaces}
        return [name for _, name, _ in done if name not in replaced]

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """Documents that count now, of these buckets or all."""
        names = self._live()
        rows = self._read("ledger", names, LEDGER)
        if names and buckets is not None and len(buckets) < BUCKETS:
            rows = rows.filter(F.col("bucket").isin(buckets))
        return rows.groupBy("doc_id", *GROUP, "n_tokens").agg(F.sum("sign").alias("times")).filter("times > 0").drop("times")

    def _write_ledger(self, rows: DataFrame, name: str, count: int) -> None:
        parts = -(-count // (BUCKETS * FILE_ROWS)) or 1
        dealt = rows.withColumn("bucket", _bucket()).repartition("bucket", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(parts)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/ledger/batch={name}")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens, seq); False if the batch was committed before.

        op is insert, delete or revise.
        """
        name = self._name(batch)
        done = self.committed()
        if any(b == batch for b, _, _ in done):
            return False
        row = F.struct("seq", "op", *GROUP, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        last = changes.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(row).alias("c"))
        # Counting tokens may be dear, and the changes are read twice from here on.
        last = materialize(last.select("doc_id", "c.*"), "changes", f"{self.path}/changes/{name}")
        if not last.filter(F.col("op").isNull() | ~F.col("op").isin(*OPS)).isEmpty():
            remove(self.spark, f"{self.path}/changes/{name}")
            raise ValueError(f"batch {batch!r} has changes that are none of {', '.join(OPS)}")
        count = last.count()
        signed = last.filter("op <> 'delete'").select("doc_id", *GROUP, "n_tokens", F.lit(1).alias("sign"))
        if done:
            touched = [r["bucket"] for r in last.select(_bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
            # Both sides grow with the data, so neither is broadcast.
            before = self.ledger(touched).hint("merge").join(last.select("doc_id"), "doc_id", "left_semi")
            signed = signed.unionByName(before.select("doc_id", *GROUP, "n_tokens", F.lit(-1).alias("sign")))
        self._write_ledger(signed, name, count)
        written = self._read("ledger", [name], LEDGER)
        totals = written.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        totals.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/{name}")
        self._commit(batch, name, [])
        remove(self.spark, f"{self.path}/changes/{name}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens)."""
        rows = self._read("deltas", self._live(), DELTA)
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the ledgers and deltas of all committed batches into one of each, and remove those folded."""
        names = self._live()
        if len(names) < 2:
            return
        name = f"compacted-{uuid.uuid4().hex}"
        held = self.ledger().withColumn("sign", F.lit(1))
        self._write_ledger(held, name, self._read("ledger", names, LEDGER).count())
        self.totals().coalesce(1).write.parquet(f"{self.path}/deltas/{name}")
        self._commit(name, name, names)
        for old in names:
            remove(self.spark, f"{self.path}/ledger/batch={old}")
            remove(self.spark, f"{self.path}/deltas/{old}")


def count_tokens(docs: DataFrame, model: bytes, *, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of a text, null counting as empty.

    ``model`` is a tokenizers file (JSON) or the ranks of a tiktoken file.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    columns = [c for c in docs.columns if c not in (text, out)]
    schema = StructType([*[docs.schema[c] for c in columns], StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(model)
        for batch in batches:
            counts = pa.array(count(batch.column(batch.num_columns - 1).fill_null("")), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], counts], [*columns, out])

    return docs.select(*columns, F.col(text)).mapInArrow(run, schema)


def counter_of(model: bytes):
    """The function from texts (an Arrow array) to their numbers of tokens."""
    from recollex.llm.token_index import encoder_of

    if model.lstrip()[:1] == b"{":
        encoder = encoder_of(model)
        return lambda texts: [len(x) // encoder.dtype.itemsize for x in encoder.encode_all(texts)]
    encoding = _ranked(model)
    return lambda texts: [len(encoding.encode_ordinary(t.as_py())) for t in texts]


_RANKED: dict[int, object] = {}


def _ranked(model: bytes):
    import base64
    import zlib

    import tiktoken

    from recollex.llm.token_index import BYTE_LEVEL

    key = zlib.crc32(model)
    if key not in _RANKED:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in model.splitlines() if line)}
        _RANKED[key] = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    return _RANKED[key]
