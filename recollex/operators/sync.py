"""Merging of replicas: operation logs, maps, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_lww(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Of all operations (op_id, kind, doc_id, ts, payload) on a document the last by (ts, op_id), ordered by op_id."""
    both = local.unionByName(remote)
    others = [c for c in both.columns if c != "doc_id"]
    return both.groupBy("doc_id").agg(F.max_by(F.struct(*others), F.struct("ts", "op_id")).alias("o")).select("doc_id", "o.*").orderBy("op_id")


def merge_maps(*writers: DataFrame) -> DataFrame:
    """(uri, meta): every key of every writer; of a key with several values the last by (ts, actor) stays. Writers: (uri, actor, ts, meta map)."""
    both = writers[0]
    for other in writers[1:]:
        both = both.unionByName(other)
    entries = both.select("uri", "actor", "ts", F.explode("meta").alias("key", "value"))
    last = entries.groupBy("uri", "key").agg(F.max_by("value", F.struct("ts", "actor", "value")).alias("value"))
    return last.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))


def set_meta(meta, key: str, value) -> object:
    """JSON text of the metadata with one key set."""
    known = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(known, lambda k, _: k != key), F.create_map(F.lit(key), value)))


def merge_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, matched by uri or else by hash; the first wins, but takes metadata that it lacks from the second."""
    key = F.coalesce("uri", "hash")
    left = a.select(key.alias("_k"), F.struct("uri", "title", "text", "meta", "hash").alias("x"))
    right = b.select(key.alias("_k"), F.struct("uri", "title", "text", "meta", "hash").alias("y"))
    both = left.join(right, "_k", "full_outer")
    pick = lambda c: F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    return both.select(*[(F.coalesce("x.meta", "y.meta") if c == "meta" else pick(c)).alias(c) for c in ("uri", "title", "text", "meta", "hash")])


def merge_shards(hits: list[DataFrame], limit: int) -> DataFrame:
    """Hit lists of shards fused by rank, matched by uri."""
    from recollex.operators import fusion

    return fusion.rrf([fusion.ranked(h, f"shard{i}", key="uri") for i, h in enumerate(hits)], limit, key="uri")
