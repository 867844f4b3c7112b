"""Maps that keep concurrent writes: dots, what each replica has seen, observed-remove.

A write is an entry (uri, key, value) with a dot: the actor that wrote it, and the
actor's own count of writes. A replica is its live entries and its context, the
dots that it has seen, live or not, as runs of each actor's counts. Who writes a key
takes away the entries of it that they saw, and who removes it does only that. When
replicas merge, an entry stays if both have it or if the other has not seen its dot:
what one side took away knowingly goes, what it never saw stays. So a put survives a
concurrent removal, and concurrent puts of one key stay side by side until someone
who has seen both writes again.

Merging is commutative, associative and idempotent. It is joins by dot and by actor;
no key or document is gathered in one place but in ``read``, whose arrays hold the
values that are in conflict on one key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollex.operators.ordering import with_positions
from recollex.storage import materialize, small

ENTRY = "uri string, key string, value string, actor string, n long"
RUN = "actor string, first long, last long"


@dataclass(frozen=True)
class Replica:
    """entries: (uri, key, value, actor, n); context: (actor, first, last), runs of seen counts that neither touch nor overlap."""

    entries: DataFrame
    context: DataFrame

    def kept(self, label: str = "replica") -> Replica:
        """Written to the shared folder and read back."""
        return Replica(materialize(self.entries, f"{label}-entries"), materialize(self.context, f"{label}-context"))


def empty(spark: SparkSession) -> Replica:
    return Replica(spark.createDataFrame([], ENTRY), spark.createDataFrame([], RUN))


def joined_runs(runs: DataFrame) -> DataFrame:
    """Runs that touch or overlap as one."""
    before = Window.partitionBy("actor").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy("actor").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True))
    groups = runs.distinct().withColumn("_opens", opens.cast("long")).withColumn("_run", F.sum("_opens").over(along))
    return groups.groupBy("actor", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("actor", "first", "last")


def _unseen(entries: DataFrame, context: DataFrame) -> DataFrame:
    """Entries whose dot the context lacks."""
    seen = context.groupBy("actor").agg(F.collect_list(F.struct("first", "last")).alias("_runs"))  # one run for an actor without gaps
    met = entries.join(small(seen), "actor", "left")
    held = F.exists(F.coalesce("_runs", F.array().cast("array<struct<first: bigint, last: bigint>>")), lambda r: F.col("n").between(r["first"], r["last"]))
    return met.filter(~held).select(*entries.columns)


def merge(a: Replica, b: Replica) -> Replica:
    """What both know, with the causes of each."""
    dot = ["uri", "key", "actor", "n"]
    both = a.entries.join(b.entries.select(*dot), dot, "left_semi").select("uri", "key", "value", "actor", "n")
    entries = both.unionByName(_unseen(a.entries, b.context)).unionByName(_unseen(b.entries, a.context))
    return Replica(entries, joined_runs(a.context.unionByName(b.context)))


def put(replica: Replica, rows: DataFrame, actor: str) -> Replica:
    """Write (uri, key, value) as ``actor``; entries of these keys that the replica has seen are replaced. Of several rows of a key the greatest value is written."""
    rows = rows.filter("uri is not null and key is not null and value is not null").groupBy("uri", "key").agg(F.max("value").alias("value"))
    last = replica.context.filter(F.col("actor") == actor).agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]
    new = with_positions(rows, "uri", "key", position="n").select("uri", "key", "value", F.lit(actor).alias("actor"), (F.col("n") + last).alias("n"))
    new = materialize(new, "puts")
    count = new.count()
    entries = replica.entries.join(new.select("uri", "key"), ["uri", "key"], "left_anti").unionByName(new)
    context = replica.context
    if count:
        run = context.sparkSession.range(1).select(F.lit(actor).alias("actor"), F.lit(last + 1).cast("long").alias("first"), F.lit(last + count).cast("long").alias("last"))
        context = joined_runs(context.unionByName(run))
    return Replica(entries, context)


def remove(replica: Replica, keys: DataFrame) -> Replica:
    """Take away what the replica has seen of these (uri, key), or of all keys of these uris where there is no column ``key``."""
    on = ["uri", "key"] if "key" in keys.columns else ["uri"]
    return Replica(replica.entries.join(keys.select(*on).distinct(), on, "left_anti"), replica.context)


def read(replica: Replica) -> DataFrame:
    """(uri, key, value, siblings): the value of the greatest (n, actor), and all that are in conflict, in order."""
    found = replica.entries.groupBy("uri", "key").agg(F.max_by("value", F.struct("n", "actor")).alias("value"), F.array_sort(F.collect_list("value")).alias("siblings"))
    return found.select("uri", "key", "value", "siblings")


# --- operation logs -----------------------------------------------------------


def seen_before(actor: Column, seq: Column, seen: Column) -> Column:
    """What an operation's writer had seen: ``seen`` (actor -> seq), and the writer's own earlier ones."""
    others = F.map_filter(F.coalesce(seen, F.create_map().cast("map<string,bigint>")), lambda a, _: a != actor)
    return F.map_concat(others, F.create_map(actor, seq - 1))


def survivors(ops: DataFrame) -> DataFrame:
    """Puts that no operation on the same document has seen.

    ops: (actor, seq, kind, doc_id, payload, seen), with ``seen`` a map of how far the
    writer knew each other actor. Operations that came twice count once. A
    document's puts are held against the farthest that any operation on it has seen
    of each actor, so operations aren't paired.
    """
    ops = ops.dropDuplicates(["actor", "seq"])
    known = ops.select("doc_id", F.explode(seen_before(F.col("actor"), F.col("seq"), F.col("seen"))).alias("actor", "_upto"))
    known = known.groupBy("doc_id", "actor").agg(F.max("_upto").alias("_upto"))
    return ops.filter("kind <> 'delete'").join(known, ["doc_id", "actor"]).filter(F.col("seq") > F.col("_upto")).drop("_upto")


def siblings(ops: DataFrame) -> DataFrame:
    """(doc_id, n, payloads): documents with the payloads that survive, in order."""
    return survivors(ops).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("payload")).alias("payloads"))
