"""Event log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollex.operators import events as ev
from recollex.plans.models import BASE, COSTS, DECISIONS, EVENTS, costs, decisions, events

DAY0, DAY9 = BASE + 2 * 86400, BASE + 9 * 86400

QUERIES = {
    "sc28_event_ingest": lambda s, d: ev.ingest(events(s, d)).select("event_id", "session_id", "agent", "kind", "uri", "content", "dedup_key"),
    "sc28_sessions": lambda s, d: ev.sessions_of(ev.ingest(events(s, d))),
    "sc29_gr22_decision_nodes": lambda s, d: ev.decisions_graph(decisions(s, d))[0],
    "sc29_decision_edges": lambda s, d: ev.decisions_graph(decisions(s, d))[1],
    "sc30_token_cost": lambda s, d: costs(s, d),
    "pf10_event_filter": lambda s, d: ev.find(events(s, d), ev.EventFilter(agent="agent3", kind="view", since=DAY0, until=DAY9, limit=100)).select("event_id", "ts", "session_id", "uri"),
    "pf18_agent_trace": lambda s, d: ev.agent_trace(events(s, d), "agent2", DAY0, DAY9, 50),
    "ag1_cost_by_day": lambda s, d: ev.cost_by_day(costs(s, d), DAY0),
    "ag2_top_agents": lambda s, d: ev.top_by_count(events(s, d), "agent", 5),
    "ag2_top_kinds": lambda s, d: ev.top_by_count(events(s, d), "kind", 5),
    "ag3_top_agents_by_cost": lambda s, d: ev.top_by_cost(costs(s, d), 5),
    "ag4_brain_stats": lambda s, d: ev.stats(events=events(s, d), decisions=decisions(s, d), costs=costs(s, d)),
    "ag6_daily_summary": lambda s, d: ev.daily_summary(events(s, d), costs(s, d), DAY0, DAY9),
    "ag7_wn8_agent_summary": lambda s, d: ev.agent_summary(events(s, d), costs(s, d), DAY0, DAY9),
    "ag8_jn15_list_sessions": lambda s, d: ev.list_sessions(events(s, d), decisions(s, d), costs(s, d), limit=1000),
    "ag12_prometheus": lambda s, d: ev.prometheus(ev.stats(events=events(s, d), costs=costs(s, d))),
    "so3_session_timeline": lambda s, d: ev.session_timeline(events(s, d), decisions(s, d), "s5", 60),
    "wn15_replay": lambda s, d: ev.replay(events(s, d), "s7", 200),
    "dt6_day_bucket": lambda s, d: events(s, d).groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")),
    "xt30_event_kinds": lambda s, d: events(s, d).select("kind").distinct(),
    "sc32_lake_archive": lambda s, d: _lake(s, d),
}


def _lake(spark, sf_dir):
    """Hot and archived events, read together."""
    from recollex.storage import new_path

    path = new_path(spark, "lake")
    rows = events(spark, sf_dir)
    hot = ev.archive(rows, path, DAY9)
    cold = spark.read.parquet(path)
    return cold.select(F.lit("cold").alias("tier"), "event_id", "ts").unionByName(hot.select(F.lit("hot").alias("tier"), "event_id", "ts")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_KEY = "sha256(concat_ws(chr(31), coalesce(session_id, ''), coalesce(agent, ''), coalesce(kind, ''), coalesce(uri, ''), coalesce(content, '')))"
_FIRST = f"first AS (SELECT *, {_KEY} AS dedup_key FROM ev QUALIFY row_number() OVER (PARTITION BY session_id, agent, kind, uri, content ORDER BY event_id) = 1)"
_SPAN = f"ts BETWEEN {DAY0} AND {DAY9}"

ORACLE_SQL = {
    "sc28_event_ingest": f"WITH {EVENTS}, {_FIRST} SELECT event_id, session_id, agent, kind, uri, content, dedup_key FROM first",
    "sc28_sessions": f"WITH {EVENTS}, {_FIRST} SELECT session_id, arg_min(agent, event_id) AS agent, arg_min(ts, event_id) AS started_at, arg_max(ts, event_id) AS ended_at FROM first GROUP BY session_id",
    "sc30_token_cost": f"WITH {EVENTS}, {COSTS} SELECT * FROM costs",
    "pf10_event_filter": f"WITH {EVENTS} SELECT event_id, ts, session_id, uri FROM ev WHERE agent = 'agent3' AND kind = 'view' AND {_SPAN} ORDER BY ts DESC, event_id DESC LIMIT 100",
    "pf18_agent_trace": f"WITH {EVENTS} SELECT event_id, ts, session_id, kind, uri, left(content, 200) AS preview FROM ev WHERE agent = 'agent2' AND {_SPAN} ORDER BY ts DESC, event_id DESC LIMIT 50",
    "ag1_cost_by_day": f"WITH {EVENTS}, {COSTS} SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, agent, model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 4) AS cost_usd FROM costs WHERE ts >= {DAY0} GROUP BY 1, 2, 3",
    "ag2_top_agents": f"WITH {EVENTS} SELECT agent, count(*) AS n FROM ev GROUP BY agent ORDER BY n DESC, agent LIMIT 5",
    "ag2_top_kinds": f"WITH {EVENTS} SELECT kind, count(*) AS n FROM ev GROUP BY kind ORDER BY n DESC, kind LIMIT 5",
    "ag3_top_agents_by_cost": f"WITH {EVENTS}, {COSTS} SELECT agent, round(sum(cost_usd), 4) AS cost_usd FROM costs GROUP BY agent ORDER BY cost_usd DESC, agent LIMIT 5",
    "ag4_brain_stats": f"WITH {EVENTS}, {COSTS}, {DECISIONS} SELECT 'events' AS name, count(*) AS n FROM ev UNION ALL SELECT 'decisions', count(*) FROM decisions UNION ALL SELECT 'costs', count(*) FROM costs",
    "ag6_daily_summary": f"WITH {EVENTS}, {COSTS}, a AS (SELECT count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT agent) AS agents, count(*) FILTER (kind = 'error') AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM ev WHERE {_SPAN}), b AS (SELECT round(coalesce(sum(cost_usd), 0), 4) AS cost_usd, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens FROM costs WHERE {_SPAN}) SELECT * FROM a, b",
    "ag7_wn8_agent_summary": f"""WITH {EVENTS}, {COSTS}, i AS (SELECT * FROM ev WHERE {_SPAN}),
b AS (SELECT agent, count(*) AS events, count(DISTINCT session_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM i GROUP BY agent),
c AS (SELECT agent, round(sum(cost_usd), 4) AS cost_usd FROM costs WHERE {_SPAN} GROUP BY agent),
k AS (SELECT agent, string_agg(kind || ':' || n, ',' ORDER BY r) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, kind) AS r FROM (SELECT agent, kind, count(*) AS n FROM i GROUP BY 1, 2)) WHERE r <= 5 GROUP BY agent),
u AS (SELECT agent, string_agg(uri || ':' || n, ',' ORDER BY r) AS uris FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY n DESC, uri) AS r FROM (SELECT agent, uri, count(*) AS n FROM i GROUP BY 1, 2)) WHERE r <= 5 GROUP BY agent)
SELECT b.*, coalesce(cost_usd, 0) AS cost_usd, kinds, uris FROM b LEFT JOIN c USING (agent) LEFT JOIN k USING (agent) LEFT JOIN u USING (agent)""",
    "ag8_jn15_list_sessions": f"""WITH {EVENTS}, {COSTS}, {DECISIONS}, b AS (SELECT session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events, arg_min(agent, (ts, event_id)) AS agent FROM ev GROUP BY session_id),
d AS (SELECT session_id, count(*) AS decisions FROM decisions GROUP BY 1), c AS (SELECT session_id, round(sum(cost_usd), 4) AS cost_usd FROM costs GROUP BY 1)
SELECT session_id, agent, started_at, ended_at, events, coalesce(decisions, 0) AS decisions, coalesce(cost_usd, 0) AS cost_usd FROM b LEFT JOIN d USING (session_id) LEFT JOIN c USING (session_id)""",
    "so3_session_timeline": f"""WITH {EVENTS}, {DECISIONS}, a AS (SELECT ts, kind AS entry, left(content, 200) AS text, event_id AS id FROM ev WHERE session_id = 's5' ORDER BY ts, id LIMIT 60),
b AS (SELECT ts, 'decision' AS entry, left(rationale, 200) AS text, decision_id AS id FROM decisions WHERE session_id = 's5' ORDER BY ts, id LIMIT 60)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY ts, entry, id LIMIT 60""",
    "wn15_replay": f"WITH {EVENTS}, r AS (SELECT * FROM ev WHERE session_id = 's7' ORDER BY ts, event_id LIMIT 200) SELECT event_id, ts, kind, left(content, 200) AS preview, ts - lag(ts) OVER (ORDER BY ts, event_id) AS gap FROM r",
    "dt6_day_bucket": f"WITH {EVENTS} SELECT strftime(to_timestamp(ts) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1",
    "xt30_event_kinds": f"WITH {EVENTS} SELECT DISTINCT kind FROM ev",
    "ag12_prometheus": f"WITH {EVENTS}, {COSTS} SELECT 'recollex_events_total ' || count(*) AS line FROM ev UNION ALL SELECT 'recollex_costs_total ' || count(*) FROM costs",
    "sc32_lake_archive": f"WITH {EVENTS} SELECT CASE WHEN ts < {DAY9} THEN 'cold' ELSE 'hot' END AS tier, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM ev GROUP BY 1",
    "sc29_gr22_decision_nodes": f"""WITH {EVENTS}, {DECISIONS}, n AS (SELECT uri, 'decision' AS kind, ts FROM decisions UNION ALL SELECT source_uri, 'source', ts FROM decisions WHERE source_uri IS NOT NULL UNION ALL SELECT target_uri, 'target', ts FROM decisions WHERE source_uri IS NOT NULL)
SELECT uri, arg_min(kind, (ts, kind)) AS kind, min(ts) AS first_seen, max(ts) AS last_seen FROM n GROUP BY uri""",
    "sc29_decision_edges": f"""WITH {EVENTS}, {DECISIONS}, e AS (SELECT source_uri AS from_uri, uri AS to_uri, 'caused' AS rel, ts FROM decisions WHERE source_uri IS NOT NULL UNION ALL SELECT uri, target_uri, 'caused', ts FROM decisions WHERE source_uri IS NOT NULL)
SELECT from_uri, to_uri, rel, max(ts) AS ts FROM e GROUP BY 1, 2, 3""",
}
