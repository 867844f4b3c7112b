"""Streams over the events table: each query runs its stream to the end of what there is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollex.session import table
from recollex.storage import new_path
from recollex.streaming import state, streams as st


def _events(s, d) -> DataFrame:
    """The events table as a stream of files."""
    folder = new_path(s, "stream-input")
    e = table(s, d, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("session_id"), F.concat(F.lit("agent"), (F.col("user_id") % 7).cast("string")).alias("agent"),
        F.col("event_type").alias("kind"), F.concat(F.lit("mem://"), F.get_json_object("props", "$.k")).alias("uri"), F.col("props").alias("content"), F.col("value"), F.col("event_type").alias("title"),
    )
    e.coalesce(1).write.parquet(folder)
    return st.read_folder(s, folder, e.schema)


def _all(stream: DataFrame, mode: str) -> DataFrame:
    return st.run_once(stream, f"q{uuid.uuid4().hex}", mode=mode, checkpoint=new_path(stream.sparkSession, "stream-state"))


QUERIES = {
    "st1_change_feed": lambda s, d: _all(st.change_feed(_events(s, d), title="VIEW", uri_prefix="mem://1"), "append").groupBy("agent").agg(F.count(F.lit(1)).alias("n")),
    "st3_distinct_events": lambda s, d: _all(st.distinct_events(_events(s, d), "400 days"), "append").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")),
    "st_tumbling": lambda s, d: _all(st.tumbling(_events(s, d), "1 day", "kind"), "complete").select(F.unix_seconds("start").alias("start"), "kind", "n", F.round("value", 4).alias("value")),
    "st_sliding": lambda s, d: _all(st.sliding(_events(s, d), "2 days", "1 day", "kind"), "complete").select(F.unix_seconds("start").alias("start"), "kind", "n"),
    "st4_session_windows": lambda s, d: _all(st.session_windows(_events(s, d), "6 hours", "session_id"), "complete").groupBy("session_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events")),
    "st4_session_state": lambda s, d: _all(state.session_state(_events(s, d)), "update").groupBy("session_id").agg(F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")),
    "st4_session_kinds": lambda s, d: _kinds(s, d),
    "st7_newest_operations": lambda s, d: _all(st.newest_operations(_events(s, d).select(F.unix_seconds("ts").alias("ts"), F.col("uri").alias("doc_id"), F.concat("session_id", "agent", "content").alias("op_id"), "kind", F.col("content").alias("payload"))), "complete").select("doc_id", "ts", "op_id"),
    "raw_cube": lambda s, d: table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")),
    "raw_pricing_summary": lambda s, d: table(s, d, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n")),
    "raw_asof": lambda s, d: _asof(s, d),
}


def _kinds(s, d):
    """(session_id, kind, n) from the newest row of each session's state."""
    rows = _all(state.session_state(_events(s, d)), "update")
    return rows.groupBy("session_id").agg(F.max_by("kinds", F.struct("n", "closed")).alias("kinds")).select("session_id", F.explode("kinds").alias("kind", "n"))


def _asof(s, d):
    """Each view with the last purchase of its user before it: one window over the union, no join."""
    from pyspark.sql import Window

    e = table(s, d, "events").filter("event_type in ('view', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "view", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)).filter("event_type = 'view'").select("event_id", "last_purchase")


_E = "e AS (SELECT ts, 's' || (user_id % 40) AS session_id, 'agent' || (user_id % 7) AS agent, event_type AS kind, 'mem://' || json_extract_string(props, '$.k') AS uri, props AS content, value FROM events)"
ORACLE_SQL = {
    "st1_change_feed": f"WITH {_E} SELECT agent, count(*) AS n FROM e WHERE kind = 'view' AND starts_with(uri, 'mem://1') GROUP BY agent",
    "st3_distinct_events": f"WITH {_E} SELECT session_id, count(*) AS n FROM (SELECT DISTINCT session_id, agent, kind, uri, content FROM e) GROUP BY session_id",
    "st_tumbling": f"WITH {_E} SELECT floor(epoch(ts) / 86400)::BIGINT * 86400 AS start, kind, count(*) AS n, round(sum(value), 4) AS value FROM e GROUP BY 1, 2",
    "st_sliding": f"WITH {_E} SELECT (floor(epoch(ts) / 86400)::BIGINT - i) * 86400 AS start, kind, count(*) AS n FROM e, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2",
    "st4_session_windows": f"WITH {_E}, g AS (SELECT session_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e) SELECT session_id, sum(new)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY session_id",
    "st4_session_state": f"WITH {_E} SELECT session_id, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS first, floor(epoch(max(ts)))::BIGINT AS last FROM e GROUP BY session_id",
    "st4_session_kinds": f"WITH {_E} SELECT session_id, kind, count(*) AS n FROM e GROUP BY 1, 2",
    "st7_newest_operations": f"WITH {_E} SELECT uri AS doc_id, floor(epoch(ts))::BIGINT AS ts, session_id || agent || content AS op_id FROM e QUALIFY row_number() OVER (PARTITION BY uri ORDER BY floor(epoch(ts)) DESC, session_id || agent || content DESC, kind DESC) = 1",
    "raw_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "raw_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "raw_asof": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'view', event_id ROWS UNBOUNDED PRECEDING) AS last_purchase, event_type FROM events WHERE event_type IN ('view', 'purchase') QUALIFY event_type = 'view'",
}
ORACLE_SQL["raw_asof"] = f"SELECT event_id, last_purchase FROM ({ORACLE_SQL['raw_asof']})"
