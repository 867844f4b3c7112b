"""Operation logs of replicas: state vectors, what a peer lacks, batches for the wire, merging.

An operation is (actor, seq, kind, doc_id, ts, payload); each actor counts its own
by seq from 1, without gaps. A state vector says how far each actor is known. Two
replicas exchange vectors, send each other what is missing, and end with the same
operations; the documents that these leave are told by the last writer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OP = "struct<actor:string,seq:bigint,kind:string,doc_id:bigint,ts:bigint,payload:string>"
COLUMNS = ["actor", "seq", "kind", "doc_id", "ts", "payload"]


def state_vector(ops: DataFrame) -> DataFrame:
    """(actor, known): how far each actor's operations are known without a gap."""
    distinct = ops.select("actor", "seq").distinct()
    runs = distinct.groupBy("actor").agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
    whole = runs.filter("last = n").select("actor", F.col("last").alias("known"))
    # Only actors with gaps need their first missing number looked for.
    broken = distinct.join(runs.filter("last <> n").select("actor"), "actor")
    follows = broken.select("actor", (F.col("seq") + 1).alias("seq")).union(runs.filter("last <> n").select("actor", F.lit(1).cast("long"))).distinct()
    first_gap = follows.join(broken, ["actor", "seq"], "left_anti").groupBy("actor").agg((F.min("seq") - 1).alias("known"))
    return whole.unionByName(first_gap)


def missing(ops: DataFrame, theirs: DataFrame) -> DataFrame:
    """Operations beyond a peer's state vector (actor, known)."""
    return ops.join(theirs, "actor", "left").filter(F.col("seq") > F.coalesce("known", F.lit(0))).drop("known")


def encode(ops: DataFrame, *, batch: int = 1000) -> DataFrame:
    """(actor, batch, body): operations as JSON lists, ``batch`` of an actor's numbers to a body."""
    rows = ops.select("actor", F.floor((F.col("seq") - 1) / batch).alias("batch"), F.struct(*COLUMNS).alias("o"))
    return rows.groupBy("actor", "batch").agg(F.to_json(F.array_sort(F.collect_set("o"))).alias("body"))  # at most ``batch`` numbers


def decode(bodies: DataFrame) -> DataFrame:
    return bodies.select(F.inline(F.from_json("body", f"array<{OP}>")))


def merged(*replicas: DataFrame) -> DataFrame:
    """All operations of all replicas, each once."""
    out = replicas[0].select(*COLUMNS)
    for other in replicas[1:]:
        out = out.union(other.select(*COLUMNS))
    return out.dropDuplicates(["actor", "seq"])


def documents(ops: DataFrame) -> DataFrame:
    """(doc_id, payload, actor, ts): what the last operation by (ts, actor, seq) of each document leaves; deleted ones are gone."""
    last = ops.groupBy("doc_id").agg(F.max_by(F.struct("kind", "payload", "actor", "ts"), F.struct("ts", "actor", "seq")).alias("o")).select("doc_id", "o.*")
    return last.filter("kind <> 'delete'").select("doc_id", "payload", "actor", "ts")


def exchange(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both replicas after a handshake: each gets what its state vector lacks, by way of the wire's bodies."""
    to_b, to_a = missing(a, state_vector(b)), missing(b, state_vector(a))
    return merged(a, decode(encode(to_a))), merged(b, decode(encode(to_b)))


def with_state(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """Documents (id, ...) with the operations behind each as ``state`` (JSON), null without any."""
    kept = ops.groupBy(F.col("doc_id").alias("id")).agg(F.to_json(F.array_sort(F.collect_set(F.struct(*COLUMNS)))).alias("state"))
    return docs.join(kept, "id", "left")
