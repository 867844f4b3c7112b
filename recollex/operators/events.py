"""Event log: ingest, sessions, decisions, costs, and the analytics over them.

Events: ts (seconds), session_id, agent, kind, uri, content, cost. Ingest keeps
the first of equal events; ``arrival`` orders rows that have no other order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["session_id", "agent", "kind", "uri", "content"]


@dataclass(frozen=True)
class EventFilter:
    """Conjunction of optional conditions; times are inclusive."""

    agent: str | None = None
    session_id: str | None = None
    kind: str | None = None
    uri: str | None = None
    since: int | None = None
    until: int | None = None
    limit: int = 1000

    def condition(self) -> Column:
        out = F.lit(True)
        for name in ("agent", "session_id", "kind", "uri"):
            if (value := getattr(self, name)) is not None:
                out = out & (F.col(name) == value)
        if self.since is not None:
            out = out & (F.col("ts") >= self.since)
        if self.until is not None:
            out = out & (F.col("ts") <= self.until)
        return out


def dedup_key() -> Column:
    """Hash of what makes two events equal; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in KEY]), 256)


def ingest(events: DataFrame, known: DataFrame | None = None, *, arrival: str = "event_id") -> DataFrame:
    """First arrival of each distinct event that ``known`` doesn't hold, with its dedup_key."""
    keyed = events.withColumn("dedup_key", dedup_key())
    others = [c for c in keyed.columns if c != "dedup_key"]
    first = keyed.groupBy("dedup_key").agg(F.min_by(F.struct(*others), arrival).alias("e")).select("dedup_key", "e.*")
    return first if known is None else first.join(known.select("dedup_key"), "dedup_key", "left_anti")


def parse_jsonl(lines: DataFrame, schema: str) -> DataFrame:
    """Events of JSON lines; blank lines and those that start with # are skipped, a bad line fails the job."""
    kept = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def sessions_of(events: DataFrame, *, arrival: str = "event_id") -> DataFrame:
    """One row a session: the agent of its first event, its start, and the time of its last arrival."""
    return events.filter("session_id is not null").groupBy("session_id").agg(
        F.min_by("agent", arrival).alias("agent"), F.min_by("ts", arrival).alias("started_at"), F.max_by("ts", arrival).alias("ended_at")
    )


def find(events: DataFrame, where: EventFilter) -> DataFrame:
    return events.filter(where.condition()).orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, where.limit))


def cost_by_day(costs: DataFrame, since: int) -> DataFrame:
    return costs.filter(F.col("ts") >= since).groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day"), "agent", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost_usd"), 4).alias("cost_usd")
    ).orderBy(F.desc("day"), "agent", "model")


def top_by_count(events: DataFrame, column: str, limit: int) -> DataFrame:
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(limit)


def top_by_cost(costs: DataFrame, limit: int) -> DataFrame:
    return costs.groupBy("agent").agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd")).orderBy(F.desc("cost_usd"), "agent").limit(limit)


def stats(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def daily_summary(events: DataFrame, costs: DataFrame, start: int, end: int) -> DataFrame:
    """One row of totals over [start, end]."""
    span = F.col("ts").between(start, end)
    left = events.filter(span).agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("agent").alias("agents"),
        F.count(F.when(F.col("kind") == "error", 1)).alias("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    right = costs.filter(span).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 4).alias("cost_usd"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"))
    return left.crossJoin(right)  # one row each


def agent_summary(events: DataFrame, costs: DataFrame, start: int, end: int, top: int = 5) -> DataFrame:
    """A row for each agent: totals, first and last time, and its ``top`` kinds and uris by count."""
    span = F.col("ts").between(start, end)
    inside = events.filter(span)
    base = inside.groupBy("agent").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("session_id").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    spent = costs.filter(span).groupBy("agent").agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    out = base.join(spent, "agent", "left").withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
    for column, name in (("kind", "kinds"), ("uri", "uris")):
        ranked = inside.groupBy("agent", column).agg(F.count(F.lit(1)).alias("n"))
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("n"), column))).filter(F.col("rank") <= top)
        lists = ranked.groupBy("agent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", column, "n"))), lambda x: F.concat(x[column], F.lit(":"), x["n"].cast("string"))), ",").alias(name))
        out = out.join(lists, "agent", "left")
    return out


def list_sessions(events: DataFrame, decisions: DataFrame, costs: DataFrame, *, agent: str | None = None, limit: int = 50) -> DataFrame:
    """Sessions with counts of events and decisions and their cost, last ended first. Sides are aggregated before they meet."""
    e = events.filter("session_id is not null")
    base = e.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("events"), F.min_by("agent", F.struct("ts", "event_id")).alias("agent"))
    d = decisions.groupBy("session_id").agg(F.count(F.lit(1)).alias("decisions"))
    c = costs.groupBy("session_id").agg(F.round(F.sum("cost_usd"), 4).alias("cost_usd"))
    out = base.join(d, "session_id", "left").join(c, "session_id", "left")
    if agent is not None:
        out = out.filter(F.col("agent") == agent)
    return out.select("session_id", "agent", "started_at", "ended_at", "events", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd")).orderBy(F.desc("ended_at"), "session_id").limit(limit)


def session_timeline(events: DataFrame, decisions: DataFrame, session_id: str, limit: int) -> DataFrame:
    """Events and decisions of a session by time; either side is limited before they meet."""
    side = lambda df, kind, text, order: df.filter(F.col("session_id") == session_id).select("ts", kind.alias("entry"), text.alias("text"), F.col(order).alias("id")).orderBy("ts", "id").limit(limit)
    both = side(events, F.col("kind"), F.substring("content", 1, 200), "event_id").unionByName(side(decisions, F.lit("decision"), F.substring("rationale", 1, 200), "decision_id"))
    return both.orderBy("ts", "entry", "id").limit(limit)


def replay(events: DataFrame, session_id: str, limit: int) -> DataFrame:
    """Events of a session in order, with the seconds since the one before."""
    order = Window.orderBy("ts", "event_id")
    rows = events.filter(F.col("session_id") == session_id).orderBy("ts", "event_id").limit(limit)
    return rows.select("event_id", "ts", "kind", F.substring("content", 1, 200).alias("preview"), (F.col("ts") - F.lag("ts").over(order)).alias("gap"))


def agent_trace(events: DataFrame, agent: str, since: int, until: int, limit: int) -> DataFrame:
    found = find(events, EventFilter(agent=agent, since=since, until=until, limit=limit))
    return found.select("event_id", "ts", "session_id", "kind", "uri", F.substring("content", 1, 200).alias("preview"))


def decisions_graph(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that decisions bring: the decision, its source and its target."""
    rows = decisions.groupBy("uri", "agent", "session_id", "rationale", "source_uri", "target_uri").agg(F.min("ts").alias("ts"), F.max("ts").alias("last"))
    whole = rows.filter("source_uri is not null and target_uri is not null")
    nodes = (
        rows.select(F.col("uri"), F.lit("decision").alias("kind"), "ts", "last")
        .unionByName(whole.select(F.col("source_uri").alias("uri"), F.lit("source").alias("kind"), "ts", "last"))
        .unionByName(whole.select(F.col("target_uri").alias("uri"), F.lit("target").alias("kind"), "ts", "last"))
    )
    nodes = nodes.groupBy("uri").agg(F.min_by("kind", F.struct("ts", "kind")).alias("kind"), F.min("ts").alias("first_seen"), F.max("last").alias("last_seen"))
    edges = whole.select(F.col("source_uri").alias("from_uri"), F.col("uri").alias("to_uri"), F.lit("caused").alias("rel"), "last").unionByName(
        whole.select(F.col("uri").alias("from_uri"), F.col("target_uri").alias("to_uri"), F.lit("caused").alias("rel"), "last")
    )
    return nodes, edges.groupBy("from_uri", "to_uri", "rel").agg(F.max("last").alias("ts"))


def archive(events: DataFrame, path: str, cutoff: int) -> DataFrame:
    """Append events before ``cutoff`` to the lake, by day; return those that stay hot."""
    cold = events.filter(F.col("ts") < cutoff).withColumn("day", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd"))
    cold.repartition("day").write.mode("append").partitionBy("day").parquet(path)
    return events.filter(F.col("ts") >= cutoff)


def prometheus(counts: DataFrame) -> DataFrame:
    """Lines of (name, n) as text metrics."""
    return counts.select(F.format_string("recollex_%s_total %d", "name", "n").alias("line"))


def health(docs: DataFrame, vectors: DataFrame, memories: DataFrame) -> DataFrame:
    """(check, n, ok): data quality of the store."""
    empty = docs.filter("text is null or trim(text) = ''").agg(F.count(F.lit(1)).alias("n")).select(F.lit("empty_text").alias("check"), "n")
    twice = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_text").alias("check"), "n")
    bare = docs.join(vectors, "id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("without_vector").alias("check"), "n")
    lost = memories.join(docs, memories["doc_id"] == docs["id"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("memory_without_document").alias("check"), "n")
    return empty.unionByName(twice).unionByName(bare).unionByName(lost).withColumn("ok", F.col("n") == 0)
