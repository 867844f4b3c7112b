"""Tags of documents: rules, listing, merging, statistics, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.storage import small


def tags_of(doc_tags: DataFrame, doc_id: int) -> DataFrame:
    return doc_tags.filter(F.col("doc_id") == doc_id).select("tag").orderBy("tag")


def docs_of(doc_tags: DataFrame, tag: str) -> DataFrame:
    return doc_tags.filter(F.col("tag") == tag).select("doc_id").distinct()


def usage(tags: DataFrame, doc_tags: DataFrame) -> DataFrame:
    """(tag, n), unused tags included."""
    return tags.join(doc_tags, "tag", "left").groupBy("tag").agg(F.count("doc_id").alias("n"))


def stats(tags: DataFrame, doc_tags: DataFrame, top: int = 10) -> DataFrame:
    return usage(tags, doc_tags).orderBy(F.desc("n"), "tag").limit(top)


def orphans(tags: DataFrame, doc_tags: DataFrame) -> DataFrame:
    return tags.join(doc_tags, "tag", "left_anti")


def merge(doc_tags: DataFrame, old: str, new: str) -> DataFrame:
    """Documents of one tag get another, once each."""
    return doc_tags.withColumn("tag", F.when(F.col("tag") == old, new).otherwise(F.col("tag"))).distinct()


def apply_rules(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, tag) by enabled rules (keyword, tag, enabled) whose keyword the text holds, without case."""
    live = rules.filter("enabled").select(F.lower("keyword").alias("keyword"), "tag")
    low = docs.select("id", F.lower("text").alias("low"))
    return low.join(small(live), F.contains("low", F.col("keyword"))).select(F.col("id").alias("doc_id"), "tag").distinct()


def upsert(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Known names keep their rows."""
    return tags.unionByName(new.join(tags.select("tag"), "tag", "left_anti").dropDuplicates(["tag"]))


def add(doc_tags: DataFrame, new: DataFrame) -> DataFrame:
    return doc_tags.unionByName(new).distinct()
