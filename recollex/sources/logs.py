"""Logs of agents' tools as events and token costs; a journal of checkpoints; a registry's answers with their age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = ("ts", "session_id", "agent", "kind", "uri", "content")
HOOK = "session_id string, hook_event_name string, tool_name string, tool_input string, timestamp string"
USAGE = "session string, model string, input_tokens long, output_tokens long, cost_usd double, ts long"
CALL = "time string, client string, method string, params string"


def _seconds(text) -> F.Column:
    return F.unix_seconds(F.try_to_timestamp(text))


def hook_events(lines: DataFrame, agent: str) -> DataFrame:
    """Events of tool hooks, a JSON object a line (value); lines that aren't are left out."""
    rows = lines.select(F.from_json("value", HOOK).alias("h")).select("h.*").filter("session_id is not null")
    uri = F.concat(F.lit("tool://"), F.lower(F.coalesce("tool_name", F.lit("none"))))
    return rows.select(_seconds(F.col("timestamp")).alias("ts"), "session_id", F.lit(agent).alias("agent"), F.lower("hook_event_name").alias("kind"), uri.alias("uri"), F.coalesce("tool_input", F.lit("")).alias("content"))


def usage_costs(lines: DataFrame, agent: str) -> DataFrame:
    """Token costs of usage lines; missing numbers count as 0."""
    rows = lines.select(F.from_json("value", USAGE).alias("u")).select("u.*").filter("session is not null")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("ts", F.col("session").alias("session_id"), F.lit(agent).alias("agent"), "model", zero("input_tokens"), zero("output_tokens"), zero("cost_usd"))


def call_events(lines: DataFrame) -> DataFrame:
    """Events of a tool server's log: the method called, by client."""
    rows = lines.select(F.from_json("value", CALL).alias("c")).select("c.*").filter("method is not null")
    return rows.select(_seconds(F.col("time")).alias("ts"), F.col("client").alias("session_id"), F.col("client").alias("agent"), F.lit("call").alias("kind"), F.concat(F.lit("mcp://"), "method").alias("uri"), F.coalesce("params", F.lit("")).alias("content"))


def commit_events(log: DataFrame) -> DataFrame:
    """Events of commits, a line each (value): hash, seconds, author and subject with tabs between."""
    part = F.split("value", "\t", 4)
    rows = log.filter(F.size(part) == 4).select(F.get(part, F.lit(0)).alias("hash"), F.get(part, F.lit(1)).cast("long").alias("ts"), F.get(part, F.lit(2)).alias("author"), F.get(part, F.lit(3)).alias("subject"))
    return rows.select("ts", F.lit("git").alias("session_id"), F.col("author").alias("agent"), F.lit("commit").alias("kind"), F.concat(F.lit("git://"), "hash").alias("uri"), F.col("subject").alias("content"))


# --- journal ----------------------------------------------------------------

JOURNAL = "agent string, seq long, state string, ts long"


def checkpoint(rows: DataFrame, path: str) -> None:
    """Append states (agent, seq, state, ts) as JSON lines; files appear whole or not at all."""
    rows.select("agent", "seq", "state", "ts").write.mode("append").json(path)


def last_states(spark: SparkSession, path: str) -> DataFrame:
    """(agent, seq, state, ts): the last whole state of each agent; torn lines are left out."""
    rows = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path).filter("agent is not null and seq is not null")
    return rows.groupBy("agent").agg(F.max_by(F.struct("seq", "state", "ts"), F.struct("seq", "ts")).alias("s")).select("agent", "s.*")


# --- registry ---------------------------------------------------------------


def fresh_lookups(cache: DataFrame, now: int, *, ttl: int = 86_400, negative_ttl: int = 3_600) -> DataFrame:
    """Answers (name, latest, ts) that are still good; that a package is unknown is believed for less long."""
    age = F.lit(now) - F.col("ts")
    return cache.filter(F.when(F.col("latest").isNull(), age < negative_ttl).otherwise(age < ttl))


def resolved(deps: DataFrame, cache: DataFrame, registry: DataFrame, now: int, **ages: int) -> tuple[DataFrame, DataFrame]:
    """(name, have, latest, cached) of dependencies (name, have), and the cache after.

    Names without a good answer are asked from ``registry`` (name, latest), each once.
    """
    newest = cache.groupBy("name").agg(F.max_by(F.struct("latest", "ts"), "ts").alias("c")).select("name", "c.latest", "c.ts")
    good = fresh_lookups(newest, now, **ages)
    names = deps.select("name").distinct()
    asked = names.join(good.select("name"), "name", "left_anti").join(registry, "name", "left").select("name", "latest", F.lit(now).cast("long").alias("ts"))
    told = good.select("name", "latest", F.lit(True).alias("cached")).unionByName(asked.select("name", "latest", F.lit(False).alias("cached")))
    return deps.join(told, "name").select("name", "have", "latest", "cached"), good.unionByName(asked)
