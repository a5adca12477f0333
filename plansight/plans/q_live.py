"""Live contract checks (ST7): the plan applied to a stream of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables as T
from ..streaming import jobs as J
from ..streaming import live_contracts as L
from . import fixtures as fx
from .catalog import query
from .q_contracts import PROPS, VIOLATIONS_DUCK

#: Every 97th event is sent with a client time three hours before its arrival.
LATE_EVERY, LATE_BY = 97, "3 HOURS"


def watched(spark, sf_dir):
    """Sink of the drained watch over the events stream."""
    sink, ck = J.new_location(spark, "contracts")
    e = T.canonical_events(J.file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", max_files=64))
    late = F.col("event_id") % LATE_EVERY == 0
    e = e.withColumn("event_ts", F.when(late, F.col("event_ts") - F.expr(f"INTERVAL {LATE_BY}")).otherwise(F.col("event_ts")))
    L.watch(e, T.plan_events(spark), T.plan_props(spark), sink, ck)
    return sink


@query("stream_violations", oracle=VIOLATIONS_DUCK)
def q_stream_violations(spark, sf_dir):
    """ST7: contract violations of a stream equal those of the batch check."""
    rows = L.read_findings(spark, watched(spark, sf_dir)).where("kind = 'violation'")
    return rows.select("event_id", "event_name", "prop", "declared_type", "actual_type", "violation")


@query("stream_contract_summary", oracle=fx.with_ctes(
    fx.EVENTS_CTE, PROPS, fx.cte("plan_events", fx.PLAN_EVENTS_SQL), f"v AS ({VIOLATIONS_DUCK})", """f AS (
  SELECT repo_id, event_name, 'unplanned' AS finding FROM ev e
  WHERE NOT EXISTS (SELECT 1 FROM plan_events p WHERE p.repo_id = e.repo_id AND lower(p.name) = e.event_name)
  UNION ALL SELECT ev.repo_id, v.event_name, v.violation FROM v JOIN ev USING (event_id))""") + f"""
SELECT *, CAST((SELECT count(*) FROM ev) AS BIGINT) AS n_arrived,
       CAST((SELECT count(*) FROM ev WHERE event_id % {LATE_EVERY} = 0) AS BIGINT) AS n_late
FROM (SELECT repo_id, event_name, finding, count(*) AS n_events FROM f GROUP BY ALL)""")
def q_stream_contract_summary(spark, sf_dir):
    """ST7: findings by repo and event, beside the arrivals and the late ones that the stream observed."""
    sink = watched(spark, sf_dir)
    seen = L.read_arrivals(spark, sink).agg(F.sum("n_events").alias("n_arrived"), F.sum("n_late").alias("n_late"))
    counts = L.read_findings(spark, sink).groupBy("repo_id", "event_name", F.coalesce("violation", "kind").alias("finding")).agg(
        F.count(F.lit(1)).alias("n_events"))
    return counts.select("*", seen.select("n_arrived").scalar().alias("n_arrived"), seen.select("n_late").scalar().alias("n_late"))
