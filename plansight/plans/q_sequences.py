"""Expected sequences, attempts, outcome rates and lifecycle transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import sequences as S
from ..sources import tables as T
from . import fixtures as fx
from .catalog import query

STEPS_DUCK = fx.with_ctes(fx.EVENTS_CTE, """s AS (SELECT user_id, event_id AS start_id, received_at AS t1
                                 FROM ev WHERE event_name = 'signup'),
s2 AS (SELECT s.*, (SELECT min(received_at) FROM ev e WHERE e.user_id = s.user_id
                    AND e.event_name = 'view' AND e.received_at > s.t1) AS n2 FROM s),
s2b AS (SELECT *, CASE WHEN n2 <= t1 + INTERVAL 7 DAY THEN n2 END AS t2 FROM s2),
s3 AS (SELECT s2b.*, (SELECT min(received_at) FROM ev e WHERE e.user_id = s2b.user_id
                      AND e.event_name = 'purchase' AND e.received_at > s2b.t2) AS n3 FROM s2b),
fun AS (SELECT user_id, start_id, t1, t2, CASE WHEN n3 <= t1 + INTERVAL 7 DAY THEN n3 END AS t3 FROM s3)""")


def steps_of(spark, name: str = "activation"):
    """Steps of a sequence from the (small) sequence dimension."""
    rows = (T.dim(spark, fx.SEQUENCES_SQL).where(F.col("name") == name)
            .orderBy("step").select("event_name", "window_seconds").collect())
    return [r.event_name for r in rows], int(rows[0].window_seconds)


def per_start(spark, sf_dir):
    steps, window = steps_of(spark)
    return S.funnel(T.events(spark, sf_dir), steps, window), steps


@query("sequence_funnel", oracle=STEPS_DUCK + """
SELECT step, n_reached, round(n_reached / (SELECT count(*) FROM fun), 6) AS conversion FROM (
  SELECT 1 AS step, count(*) AS n_reached FROM fun
  UNION ALL SELECT 2, count(t2) FROM fun
  UNION ALL SELECT 3, count(t3) FROM fun) x""")
def q_sequence_funnel(spark, sf_dir):
    ps, steps = per_start(spark, sf_dir)
    return S.funnel_summary(ps, len(steps))


@query("sequence_anomalies", oracle=STEPS_DUCK + """
SELECT user_id, start_id, t1, CASE WHEN t2 IS NULL THEN 'view' ELSE 'purchase' END AS missing_step
FROM fun WHERE t3 IS NULL""")
def q_sequence_anomalies(spark, sf_dir):
    ps, steps = per_start(spark, sf_dir)
    return S.sequence_anomalies(ps, steps).select("user_id", "start_id", "t1", "missing_step")


@query("time_to_complete", oracle=STEPS_DUCK + """
SELECT user_id, start_id, (epoch_us(t3) - epoch_us(t1)) // 1000 AS time_to_complete_ms
FROM fun WHERE t3 IS NOT NULL""")
def q_time_to_complete(spark, sf_dir):
    ps, _ = per_start(spark, sf_dir)
    return ps.where("completed").select("user_id", "start_id", "time_to_complete_ms")


@query("attempt_numbers", oracle=fx.with_ctes(fx.EVENTS_CTE, """s AS (
  SELECT user_id, event_id, event_name, received_at,
    sum(CASE WHEN event_name = 'click' THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY received_at, event_id ROWS UNBOUNDED PRECEDING) AS att,
    sum(CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY received_at, event_id ROWS UNBOUNDED PRECEDING) AS seg
  FROM ev WHERE event_name IN ('click', 'error', 'purchase')),
base AS (SELECT user_id, seg, att AS base FROM s WHERE event_name = 'purchase')""") + """
SELECT s.user_id, s.event_id, s.received_at, CAST(s.att - coalesce(b.base, 0) AS BIGINT) AS attempt_number
FROM s LEFT JOIN base b ON b.user_id = s.user_id AND b.seg = s.seg
WHERE s.event_name = 'error'""")
def q_attempt_numbers(spark, sf_dir):
    """Clicks are attempts, errors failures, purchases successes."""
    return S.attempt_numbers(T.events(spark, sf_dir), attempt="click", failure="error", success="purchase")


@query("time_since_created", oracle=fx.with_ctes(fx.EVENTS_CTE) + """
SELECT p.user_id, p.event_id, p.received_at,
  (epoch_us(p.received_at) - epoch_us((SELECT max(s.received_at) FROM ev s WHERE s.user_id = p.user_id
       AND s.event_name = 'signup' AND s.received_at <= p.received_at))) // 1000 AS time_to_complete_ms
FROM ev p WHERE p.event_name = 'purchase'""")
def q_time_since_created(spark, sf_dir):
    """A19 ``time_to_complete_ms``: purchase measured from the latest signup."""
    return S.time_since_previous(T.events(spark, sf_dir), created="signup", completed="purchase")


FLOWS_SQL = """SELECT * FROM (VALUES
 ('checkout',   'click',    'attempt'),
 ('checkout',   'purchase', 'success'),
 ('checkout',   'error',    'fail'),
 ('onboarding', 'signup',   'start'),
 ('onboarding', 'view',     'complete')
) AS flows(flow, event_name, lifecycle)"""


@query("outcome_rates", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("flows", FLOWS_SQL), """c AS (
  SELECT f.flow, count_if(f.lifecycle = 'attempt') AS attempt, count_if(f.lifecycle = 'success') AS success,
         count_if(f.lifecycle = 'fail') AS fail, count_if(f.lifecycle = 'start') AS start,
         count_if(f.lifecycle = 'complete') AS complete, count_if(f.lifecycle = 'skip') AS skip
  FROM ev JOIN flows f ON f.event_name = ev.event_name GROUP BY f.flow)""") + """
SELECT flow, attempt, success, fail, start, complete, skip,
  round(success / nullif(CASE WHEN attempt > 0 THEN attempt ELSE start END, 0), 6) AS success_rate,
  round(fail / nullif(CASE WHEN attempt > 0 THEN attempt ELSE start END, 0), 6) AS fail_rate,
  round(skip / nullif(CASE WHEN attempt > 0 THEN attempt ELSE start END, 0), 6) AS skip_rate
FROM c""")
def q_outcome_rates(spark, sf_dir):
    return S.outcome_rates(T.events(spark, sf_dir), T.dim(spark, FLOWS_SQL))


@query("lifecycle_transitions", oracle=fx.with_ctes(fx.cte("lifecycle_states", fx.LIFECYCLE_STATES_SQL), """t AS (
  SELECT o_orderstatus AS from_state,
         lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_state
  FROM orders),
k AS (SELECT state FROM lifecycle_states WHERE object = 'Order')""") + """
SELECT from_state, to_state, count(*) AS n_transitions,
       (from_state NOT IN (SELECT state FROM k) OR to_state NOT IN (SELECT state FROM k)) AS undeclared
FROM t WHERE to_state IS NOT NULL GROUP BY from_state, to_state""")
def q_lifecycle_transitions(spark, sf_dir):
    """A24 on orders: status of each customer's order -> status of their next order."""
    o = T.read_table(spark, sf_dir, "orders")
    return E.state_transitions(o, "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey",
                               declared=T.dim(spark, fx.LIFECYCLE_STATES_SQL), object_name="Order")


@query("event_transitions", oracle=fx.with_ctes(fx.EVENTS_CTE, """t AS (
  SELECT event_name AS from_state,
         lead(event_name) OVER (PARTITION BY user_id ORDER BY received_at, event_id) AS to_state
  FROM ev)""") + """
SELECT from_state, to_state, count(*) AS n_transitions FROM t WHERE to_state IS NOT NULL GROUP BY ALL""")
def q_event_transitions(spark, sf_dir):
    """A24 on events: each user's event -> their next event."""
    return E.state_transitions(T.events(spark, sf_dir), "user_id", "event_name", "received_at", "event_id")
