"""Metadata predicates compiled to Columns.

A leaf is false where the key is missing or the metadata is null or not JSON, also
for ``ne``; ``not`` is plain negation. Equality compares JSON values with their
types, so 1, 1.0 and "1" differ; ranges compare numbers alone.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    op: str
    key: str | None = None
    value: Any = None
    parts: tuple[Predicate, ...] = ()

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate("and", parts=(self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate("or", parts=(self, other))

    def __invert__(self) -> Predicate:
        return Predicate("not", parts=(self,))


def eq(key: str, value: Any) -> Predicate:
    return Predicate("eq", key, value)


def ne(key: str, value: Any) -> Predicate:
    return Predicate("ne", key, value)


def lt(key: str, value: float) -> Predicate:
    return Predicate("lt", key, value)


def lte(key: str, value: float) -> Predicate:
    return Predicate("lte", key, value)


def gt(key: str, value: float) -> Predicate:
    return Predicate("gt", key, value)


def gte(key: str, value: float) -> Predicate:
    return Predicate("gte", key, value)


def within(key: str, values: list) -> Predicate:
    return Predicate("in", key, tuple(values))


def _path(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def _leaf(meta: Column, key: str) -> tuple[Column, Column, Column]:
    """Text of a value, its JSON type, and its number if it is one."""
    variant = F.try_variant_get(F.try_parse_json(meta), f"$['{key}']", "variant")
    kind = F.schema_of_variant(variant)
    text = F.get_json_object(meta, _path(key))
    return text, kind, F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), text.cast("double"))


def _equals(meta: Column, key: str, value: Any) -> Column:
    text, kind, _ = _leaf(meta, key)
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (text == json.dumps(value))
    if isinstance(value, str):
        return (kind == "STRING") & (text == value)
    return kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (text == json.dumps(value))


def compile_predicate(p: Predicate, meta: Column) -> Column:
    """A Column that is never null."""
    if p.op == "and":
        out = F.lit(True)
        for part in p.parts:
            out = out & compile_predicate(part, meta)
        return out
    if p.op == "or":
        out = F.lit(False)
        for part in p.parts:
            out = out | compile_predicate(part, meta)
        return out
    if p.op == "not":
        return ~compile_predicate(p.parts[0], meta)
    text, kind, number = _leaf(meta, p.key)
    if p.op == "eq":
        found = _equals(meta, p.key, p.value)
    elif p.op == "ne":
        found = kind.isNotNull() & ~F.coalesce(_equals(meta, p.key, p.value), F.lit(False))
    elif p.op == "in":
        found = F.lit(False)
        for value in p.value:
            found = found | F.coalesce(_equals(meta, p.key, value), F.lit(False))
    else:
        value = F.lit(float(p.value))
        found = {"lt": number < value, "lte": number <= value, "gt": number > value, "gte": number >= value}[p.op]
    return F.coalesce(found, F.lit(False))


SELECTIVITY = {"eq": 0.5, "ne": 0.9, "lt": 0.3, "gt": 0.3, "lte": 0.35, "gte": 0.35}


def selectivity(p: Predicate) -> float:
    """Share of rows that a predicate is taken to keep."""
    if p.op == "in":
        return min(0.2 * len(p.value), 0.9)
    if p.op == "and":
        return max(math.prod(selectivity(x) for x in p.parts), 0.01)
    if p.op == "or":
        return min(1 - math.prod(1 - selectivity(x) for x in p.parts), 0.99)
    if p.op == "not":
        return max(1 - selectivity(p.parts[0]), 0.01)
    return SELECTIVITY[p.op]


def oversample(p: Predicate) -> int:
    """How many times the limit a search fetches before it filters."""
    return min(max(math.ceil(1 / selectivity(p)), 2), 32)


def filtered(df: DataFrame, p: Predicate, *, meta: str = "meta") -> DataFrame:
    return df.filter(compile_predicate(p, F.col(meta)))


def valid_at(edges: DataFrame, t: int) -> DataFrame:
    """Edges that hold at t; valid_to 0 means still."""
    return edges.filter((F.col("valid_from") <= t) & ((F.col("valid_to") == 0) | (F.col("valid_to") > t)))


def event_time(meta: Column, ts: Column) -> Column:
    """Seconds: the time told in the metadata, else that of the row (milliseconds)."""
    return F.coalesce(F.get_json_object(meta, "$.occurred_ts").cast("bigint"), F.floor(ts / 1000))


def timeline_between(docs: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    rows = docs.withColumn("event_ts", event_time(F.col("meta"), F.col("ts")))
    return rows.filter(F.col("event_ts").between(start, end)).orderBy(F.desc("event_ts"), F.desc("id")).limit(limit)


# Marks of texts that carry no knowledge.
NOISE_IN_TEXT = ["[telepathy]", "<task-notification>", "tool-use-id", '"models_loaded"', '"desktop_procs"', '"cli_sessions"']
NOISE_IN_TITLE = ["[telepathy]", "sched_briefing"]
NOISE_ENDING = ".log"
NOISE_START = "Agent [briefing]"
NOISE_BYTES = 40


def is_noise(text: Column, title: Column, uri: Column | None = None) -> Column:
    """Hits that tell nothing: status messages, notifications, logs and briefings by their marks, or less than ``NOISE_BYTES`` bytes once trimmed."""
    text, title, uri = (F.coalesce(c, F.lit("")) for c in (text, title, F.lit("") if uri is None else uri))
    said = F.startswith(text, F.lit(NOISE_START)) | F.endswith(title, F.lit(NOISE_ENDING)) | F.endswith(uri, F.lit(NOISE_ENDING))
    for column, marks in ((text, NOISE_IN_TEXT), (title, NOISE_IN_TITLE)):
        for mark in marks:
            said = said | F.contains(column, F.lit(mark))
    return said | (F.octet_length(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")) < NOISE_BYTES)


def noise_features(text: Column) -> Column:
    """Eleven numbers of a text for a learned noise filter."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    rate = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return F.array(
        F.log1p(n), F.log1p(count), n / count, F.size(F.array_distinct(words)) / count, rate("[0-9]"), rate("[A-Z]"), rate(r"[^\w\s]"), rate("\n"), rate("[{}\\[\\]<>]"),
        text.rlike("https?://").cast("double"), text.rlike(r"[.!?]\s*$").cast("double"),
    )


def noise_probability(text: Column, weights: list[float], bias: float) -> Column:
    """Logistic model over ``noise_features``."""
    f = noise_features(text)
    z = F.lit(float(bias))
    for i, w in enumerate(weights):
        z = z + F.element_at(f, i + 1) * float(w)
    return 1 / (1 + F.exp(-z))


def noise_by_trees(text: Column, trees: list[tuple[list[tuple[int, float]], list[float]]], bias: float = 0.0) -> Column:
    """Ensemble of oblivious trees: (feature, threshold) of each level, and the leaf values in binary order."""
    f = noise_features(text)
    z = F.lit(float(bias))
    for levels, leaves in trees:
        at = F.lit(0)
        for feature, threshold in levels:
            at = at * 2 + (F.element_at(f, feature + 1) > threshold).cast("int")
        z = z + F.element_at(F.array(*[F.lit(float(x)) for x in leaves]), at + 1)
    return 1 / (1 + F.exp(-z))


def live_filter(events: DataFrame, *, title: str | None = None, uri_prefix: str | None = None) -> DataFrame:
    """Title holds the words, without case; uri starts with the prefix. Works on streams."""
    if title is not None:
        events = events.filter(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(title.lower())))
    if uri_prefix is not None:
        events = events.filter(F.startswith(F.coalesce("uri", F.lit("")), F.lit(uri_prefix)))
    return events


def of_kinds(hits: DataFrame, kinds: list[str], *, column: str = "kind") -> DataFrame:
    return hits.filter(F.exists(F.array(*[F.lit(k) for k in kinds]), lambda k: F.contains(F.col(column), k)))


def not_deleted(docs: DataFrame, prefix: str) -> DataFrame:
    """Documents below a uri prefix that aren't marked as deleted."""
    return docs.filter(F.startswith("uri", F.lit(prefix)) & (F.coalesce(F.get_json_object("meta", "$.deleted"), F.lit("false")) != "true"))


def in_scope(docs: DataFrame, key: str, value: str) -> DataFrame:
    """Documents whose metadata has key = value; the key is a plain name."""
    if not key.replace("_", "").isalnum() or not key.isascii():
        raise ValueError("a scope key has letters, digits and _ only")
    return docs.filter(F.get_json_object("meta", f"$.{key}") == value)
