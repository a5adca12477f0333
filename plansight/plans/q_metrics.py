"""Metric generation, availability, evaluation and YAML export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import tables as T
from . import duck as D
from . import fixtures as fx
from .catalog import query
from .q_plan import MERGED_DUCK, merged_plan

LIFECYCLES = fx.cte("lifecycle_states", fx.LIFECYCLE_STATES_SQL)

GEN_DUCK = MERGED_DUCK.rstrip() + ",\n" + LIFECYCLES + f""",
act AS (SELECT * FROM merged WHERE status <> 'deprecated'),
cm AS (SELECT repo_id, name || '_count' AS metric, 'Count of ' || name AS description,
         'count(event = ''' || name || ''')' AS formula, [name] AS events,
         CASE priority WHEN 'critical' THEN 'activation' WHEN 'high' THEN 'engagement'
                       WHEN 'low' THEN 'retention' ELSE 'engagement' END AS category,
         'daily' AS grain, CAST(ord AS BIGINT) AS seq FROM act),
nm AS (SELECT DISTINCT repo_id, lower(name) AS lname FROM act),
objs AS (SELECT DISTINCT object, {D.snake_from_camel('object')} AS obj FROM lifecycle_states),
conv AS (SELECT c.repo_id, o.obj || '_completion_rate' AS metric,
           'Share of ' || o.object || 's created that reach completed' AS description,
           'count(event = ''' || o.obj || '_completed'') / nullif(count(event = ''' || o.obj || '_created''), 0)' AS formula,
           [o.obj || '_created', o.obj || '_completed'] AS events, 'activation' AS category, 'weekly' AS grain,
           CAST(1000000 + dense_rank() OVER (PARTITION BY c.repo_id ORDER BY o.obj) AS BIGINT) AS seq
         FROM nm c JOIN objs o ON c.lname = o.obj || '_created'
         WHERE EXISTS (SELECT 1 FROM nm d WHERE d.repo_id = c.repo_id AND d.lname = o.obj || '_completed')),
allm AS (SELECT * FROM cm UNION ALL SELECT * FROM conv),
gen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, lower(metric) ORDER BY seq DESC) AS r
                       FROM allm) WHERE r = 1)
"""


def generated(spark, sf_dir):
    return M.generate_metrics(merged_plan(spark, sf_dir), T.dim(spark, fx.LIFECYCLE_STATES_SQL))


@query("metric_definitions", oracle=GEN_DUCK + f"""
SELECT repo_id, {D.metric_id('metric')} AS id, metric, description, formula,
       array_to_string(events, ',') AS events, category, grain, 'suggested' AS status FROM gen""")
def q_metric_definitions(spark, sf_dir):
    return generated(spark, sf_dir).withColumn("events", F.array_join("events", ","))


@query("metric_availability", oracle=GEN_DUCK + """,
mx AS (SELECT repo_id, metric, unnest(events) AS ev, generate_subscripts(events, 1) AS pos FROM gen),
impl AS (SELECT DISTINCT repo_id, name AS ev FROM merged WHERE status = 'implemented')
SELECT mx.repo_id, mx.metric, bool_and(impl.ev IS NOT NULL) AS available,
       arg_min(CASE WHEN impl.ev IS NULL THEN mx.ev END, CASE WHEN impl.ev IS NULL THEN mx.pos END) AS first_missing
FROM mx LEFT JOIN impl ON impl.repo_id = mx.repo_id AND impl.ev = mx.ev
GROUP BY mx.repo_id, mx.metric""")
def q_metric_availability(spark, sf_dir):
    return M.metric_availability(generated(spark, sf_dir), merged_plan(spark, sf_dir))


@query("export_metrics", oracle=GEN_DUCK + f"""
SELECT repo_id, metric, concat_ws(chr(10),
  'id: ' || {D.metric_id('metric')}, 'name: ' || metric, 'description: ' || description,
  'formula: "' || formula || '"', 'events:',
  array_to_string(list_transform(events, lambda e: '  - ' || e), chr(10)),
  'category: ' || category, 'grain: ' || grain, 'status: suggested') AS yaml FROM gen""")
def q_export_metrics(spark, sf_dir):
    return M.metric_yaml(generated(spark, sf_dir))


EVAL_DUCK = fx.with_ctes(fx.EVENTS_CTE, fx.cte("plan_metrics", fx.PLAN_METRICS_SQL), """pre AS (
  SELECT g.grain, CASE g.grain WHEN 'hourly' THEN date_trunc('hour', received_at)
                               WHEN 'daily' THEN date_trunc('day', received_at)
                               WHEN 'weekly' THEN date_trunc('week', received_at)
                               ELSE date_trunc('month', received_at) END AS bucket,
         event_name, count(*) AS n
  FROM ev, (VALUES ('hourly'), ('daily'), ('weekly'), ('monthly')) AS g(grain)
  GROUP BY ALL),
agg AS (
  SELECT m.metric, m.kind, m.grain, p.bucket,
         sum(CASE WHEN p.event_name = m.num_event THEN p.n ELSE 0 END) AS num,
         sum(CASE WHEN p.event_name = m.den_event THEN p.n ELSE 0 END) AS den
  FROM pre p JOIN plan_metrics m ON m.grain = p.grain GROUP BY ALL)""")


@query("metric_counts", oracle=EVAL_DUCK + """
SELECT metric, kind, grain, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, CAST(num AS BIGINT) AS num,
       CAST(den AS BIGINT) AS den, round(CAST(num AS DOUBLE), 6) AS value
FROM agg WHERE kind = 'count'""")
def q_metric_counts(spark, sf_dir):
    m = T.dim(spark, fx.PLAN_METRICS_SQL)
    return M.evaluate_metrics(T.events(spark, sf_dir), m.where(F.col("kind") == "count"))


@query("metric_ratios", oracle=EVAL_DUCK + """
SELECT metric, kind, grain, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, CAST(num AS BIGINT) AS num,
       CAST(den AS BIGINT) AS den, round(num / nullif(den, 0), 6) AS value
FROM agg WHERE kind = 'ratio'""")
def q_metric_ratios(spark, sf_dir):
    m = T.dim(spark, fx.PLAN_METRICS_SQL)
    return M.evaluate_metrics(T.events(spark, sf_dir), m.where(F.col("kind") == "ratio"))


@query("expected_sequences", oracle=MERGED_DUCK.rstrip() + ",\n" + LIFECYCLES + f""",
nm AS (SELECT DISTINCT repo_id, lower(name) AS n FROM merged),
ob AS (SELECT DISTINCT object, {D.snake_from_camel('object')} AS obj FROM lifecycle_states),
h AS (SELECT nm.repo_id, ob.object, ob.obj, list(nm.n) AS ns FROM nm JOIN ob ON starts_with(nm.n, ob.obj || '_') GROUP BY ALL)
SELECT repo_id, obj || '_activation' AS name,
  array_to_string(list_concat([obj || '_created'],
    CASE WHEN list_contains(ns, obj || '_edited') THEN [obj || '_edited']
         WHEN list_contains(ns, obj || '_activated') THEN [obj || '_activated'] ELSE CAST([] AS VARCHAR[]) END,
    [obj || '_completed']), ',') AS steps,
  '7d' AS expected_window, 'Measures whether users activate after creating a ' || object AS significance
FROM h WHERE list_contains(ns, obj || '_created') AND list_contains(ns, obj || '_completed')""")
def q_expected_sequences(spark, sf_dir):
    """A18 generation: expected sequences of the merged plan's lifecycles."""
    s = M.expected_sequences(merged_plan(spark, sf_dir), T.dim(spark, fx.LIFECYCLE_STATES_SQL))
    return s.withColumn("steps", F.array_join("steps", ","))
