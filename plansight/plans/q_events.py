"""Event-store and plan-vs-actual queries (dashboard read path)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, events as ev_ops
from ..sources import tables as T
from . import fixtures as fx
from .catalog import query

EV = fx.EVENTS_CTE
PLAN = fx.cte("plan_events", fx.PLAN_EVENTS_SQL)
REPOS = fx.cte("repos", fx.REPOS_SQL)

# A1 over seven days before the newest arrival (the data spans 30, so the window cuts).
COUNTS_7D = """c AS (
  SELECT repo_id, event_name, count(*) AS n_events, max(received_at) AS last_seen
  FROM ev
  WHERE received_at >= (SELECT max(received_at) FROM ev) - INTERVAL 7 DAY
  GROUP BY repo_id, event_name
)"""


@query("plan_vs_actual", oracle=fx.with_ctes(EV, PLAN, COUNTS_7D, """ck AS (
  SELECT repo_id, lower(event_name) AS k, sum(n_events) AS n_events, max(last_seen) AS last_seen
  FROM c GROUP BY 1, 2)""") + """
SELECT p.repo_id, p.ord, p.name, p.status, p.priority,
       CAST(coalesce(ck.n_events, 0) AS BIGINT) AS n_events, ck.last_seen,
       (p.status = 'implemented' AND ck.n_events IS NULL) AS missing
FROM plan_events p LEFT JOIN ck ON ck.repo_id = p.repo_id AND ck.k = lower(p.name)""")
def q_plan_vs_actual(spark, sf_dir):
    counts = ev_ops.event_counts(T.events(spark, sf_dir), days=7)
    return drift.plan_vs_actual(T.plan_events(spark), counts)


@query("event_counts", oracle=fx.with_ctes(EV) + """
SELECT repo_id, event_name, count(*) AS n_events, max(received_at) AS last_seen
FROM ev
WHERE received_at >= (SELECT max(received_at) FROM ev) - INTERVAL 7 DAY
GROUP BY repo_id, event_name""")
def q_event_counts(spark, sf_dir):
    return ev_ops.event_counts(T.events(spark, sf_dir), days=7)


@query("event_totals", oracle=fx.with_ctes(EV, COUNTS_7D) + """
SELECT repo_id, CAST(sum(n_events) AS BIGINT) AS total_events, count(*) AS distinct_names
FROM c GROUP BY repo_id""")
def q_event_totals(spark, sf_dir):
    return ev_ops.event_totals(ev_ops.event_counts(T.events(spark, sf_dir), days=7))


@query("seen_coverage", oracle=fx.with_ctes(EV, PLAN, REPOS, COUNTS_7D, """impl AS (
  SELECT repo_id, name FROM plan_events WHERE status = 'implemented'),
ni AS (SELECT repo_id, count(*) AS implemented FROM impl GROUP BY 1),
ns AS (SELECT repo_id, count(*) AS seen FROM impl i
       WHERE EXISTS (SELECT 1 FROM c WHERE c.repo_id = i.repo_id
                                      AND lower(c.event_name) = lower(i.name))
       GROUP BY 1)""") + """
SELECT r.repo_id, CAST(coalesce(ni.implemented, 0) AS BIGINT) AS implemented,
       CAST(coalesce(ns.seen, 0) AS BIGINT) AS seen,
       CASE WHEN coalesce(ni.implemented, 0) > 0
            THEN CAST(round(CAST(coalesce(ns.seen, 0) AS DOUBLE) / ni.implemented * 100) AS BIGINT)
       END AS coverage_pct
FROM repos r LEFT JOIN ni ON ni.repo_id = r.repo_id LEFT JOIN ns ON ns.repo_id = r.repo_id""")
def q_seen_coverage(spark, sf_dir):
    counts = ev_ops.event_counts(T.events(spark, sf_dir), days=7)
    return drift.seen_coverage(T.plan_events(spark), counts, T.repos(spark))


@query("unplanned_events", oracle=fx.with_ctes(EV, PLAN, COUNTS_7D) + """
SELECT c.repo_id, c.event_name, c.n_events, c.last_seen
FROM c
WHERE NOT EXISTS (SELECT 1 FROM plan_events p
                  WHERE p.repo_id = c.repo_id AND lower(p.name) = c.event_name)""")
def q_unplanned_events(spark, sf_dir):
    counts = ev_ops.event_counts(T.events(spark, sf_dir), days=7)
    return drift.unplanned_events(counts, T.plan_events(spark))


@query("recent_events", oracle=fx.with_ctes(EV) + """
SELECT * FROM (
  SELECT event_id, repo_id, event_name, received_at,
         row_number() OVER (PARTITION BY repo_id ORDER BY received_at DESC, event_id DESC) AS rank
  FROM ev) t
WHERE rank <= 50""")
def q_recent_events(spark, sf_dir):
    e = T.events(spark, sf_dir).select("event_id", "repo_id", "event_name", "received_at")
    return ev_ops.recent_events(e, n=50)


@query("retention_cleanup", oracle=fx.with_ctes(EV) + """
SELECT event_id, repo_id, received_at FROM ev
WHERE received_at >= (SELECT max(received_at) FROM ev) - INTERVAL 20 DAY""")
def q_retention_cleanup(spark, sf_dir):
    e = T.events(spark, sf_dir).select("event_id", "repo_id", "received_at")
    return ev_ops.retention_cleanup(e, "received_at", days=20)
