"""Contracts on live events, drift suggestions, routing and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import events as E
from ..sources import tables as T
from . import duck as D
from . import fixtures as fx
from .catalog import query
from .q_plan import MERGED_DUCK, merged_plan

PROPS = fx.cte("plan_props", fx.PLAN_PROPS_SQL)


def _jt(x):
    return (f"(CASE WHEN {x} IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'INTEGER') THEN 'number' "
            f"WHEN {x} = 'VARCHAR' THEN 'string' WHEN {x} = 'BOOLEAN' THEN 'boolean' WHEN {x} = 'OBJECT' THEN 'object' "
            f"WHEN {x} = 'ARRAY' THEN 'array' WHEN {x} = 'NULL' THEN 'null' ELSE lower({x}) END)")


VIOLATIONS_DUCK = fx.with_ctes(fx.EVENTS_CTE, PROPS, """j AS (
  SELECT e.event_id, e.event_name, p.prop, p.type, p.required, p.todo,
         coalesce(list_contains(json_keys(e.properties), p.prop), false) AS present,
         json_type(e.properties, '$."' || p.prop || '"') AS vt
  FROM ev e JOIN plan_props p ON lower(p.event_name) = lower(e.event_name))""") + f"""
SELECT * FROM (
  SELECT event_id, event_name, prop, type AS declared_type,
         CASE WHEN present THEN {_jt('vt')} END AS actual_type,
         CASE WHEN required AND NOT todo AND NOT present THEN 'missing'
              WHEN present AND {_jt('vt')} <> (CASE WHEN type = 'date' THEN 'string' ELSE type END) THEN 'type_mismatch'
         END AS violation
  FROM j) x
WHERE violation IS NOT NULL"""


@query("event_contract_violations", oracle=VIOLATIONS_DUCK)
def q_event_contract_violations(spark, sf_dir):
    return C.contract_violations(T.events(spark, sf_dir), T.plan_props(spark))


@query("nearest_plan_name", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("plan_events", fx.PLAN_EVENTS_SQL), """u AS (
  SELECT DISTINCT e.repo_id, e.event_name AS name FROM ev e
  WHERE NOT EXISTS (SELECT 1 FROM plan_events p WHERE p.repo_id = e.repo_id AND lower(p.name) = lower(e.event_name))),
c AS (SELECT u.repo_id, u.name, p.name AS plan_name, p.ord, levenshtein(lower(u.name), lower(p.name)) AS dist
      FROM u JOIN plan_events p ON p.repo_id = u.repo_id),
b AS (SELECT repo_id, name, arg_min(plan_name, dist * 1000 + ord) AS suggestion, min(dist) AS distance
      FROM c WHERE dist <= 4 GROUP BY repo_id, name)""") + """
SELECT u.repo_id, u.name, b.suggestion, b.distance FROM u LEFT JOIN b ON b.repo_id = u.repo_id AND b.name = u.name""")
def q_nearest_plan_name(spark, sf_dir):
    """J10 for drift: event names a repo sends that its plan lacks, with the
    closest plan name."""
    ev = T.events(spark, sf_dir)
    plan = T.plan_events(spark)
    names = ev.select("repo_id", F.col("event_name").alias("name")).distinct()
    planned = F.broadcast(plan.select(F.col("repo_id").alias("_r"), F.lower("name").alias("_k")))
    unknown = names.join(planned, (names["repo_id"] == F.col("_r")) & (F.lower(names["name"]) == F.col("_k")),
                         "left_anti")
    return C.nearest_names(unknown, plan).select("repo_id", "name", "suggestion", "distance")


#: Spellings of event names by event id: a letter lost, doubled or changed, an affix, a plural, letters in front, another name.
SPELLINGS = ("substr(n, 1, 2) || substr(n, 4)", "substr(n, 1, 3) || substr(n, 3)", "replace(n, 'c', 'k')", "n || '_x'", "upper(n) || 's'",
             "'my_' || n", "'x' || substr(n, 2) || 'q'", "'something_' || n")
MISSPELT_SQL = ("SELECT DISTINCT repo_id, CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(SPELLINGS))
                + " END AS name FROM (SELECT repo_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'workflow_' || event_name ELSE event_name END AS n FROM {ev})")


@query("misspelt_names", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("plan_events", fx.PLAN_EVENTS_SQL),
                                              "u AS (" + MISSPELT_SQL.format(ev="ev") + ")", """c AS (
  SELECT u.repo_id, u.name, p.name AS plan_name, p.ord, levenshtein(lower(u.name), lower(p.name)) AS dist
  FROM u JOIN plan_events p ON p.repo_id = u.repo_id),
b AS (SELECT repo_id, name, arg_min(plan_name, dist * 1000 + ord) AS suggestion, min(dist) AS distance
      FROM c WHERE dist <= 4 GROUP BY repo_id, name)""") + """
SELECT u.repo_id, u.name, b.suggestion, b.distance FROM u LEFT JOIN b ON b.repo_id = u.repo_id AND b.name = u.name""")
def q_misspelt_names(spark, sf_dir):
    """J10 on names that are near misses of planned ones."""
    names = spark.sql(MISSPELT_SQL.format(ev="{ev}"), ev=T.events(spark, sf_dir))
    return C.nearest_names(names, T.plan_events(spark)).select("repo_id", "name", "suggestion", "distance")


@query("signal_routing", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("plan_events", fx.PLAN_EVENTS_SQL), """r AS (
  SELECT * FROM (VALUES ('action', 'analytics'), ('operation', 'logs'), ('state_change', 'analytics'),
                        ('state_change', 'logs'), ('error', 'logs'), ('error', 'alerts')) AS r(signal_type, destination))""") + """
SELECT e.repo_id, p.name AS event_name, p.signal_type, r.destination, count(*) AS n_events
FROM ev e JOIN plan_events p ON p.repo_id = e.repo_id AND lower(p.name) = e.event_name
JOIN r ON r.signal_type = p.signal_type
GROUP BY ALL""")
def q_signal_routing(spark, sf_dir):
    """Events routed to destination classes by their plan signal type."""
    ev = T.events(spark, sf_dir).groupBy("repo_id", "event_name").agg(F.count(F.lit(1)).alias("n"))
    plan = F.broadcast(T.plan_events(spark).select("repo_id", F.col("name").alias("pname"), "signal_type"))
    j = ev.join(plan, (ev["repo_id"] == plan["repo_id"]) & (ev["event_name"] == F.lower("pname"))) \
        .select(ev["repo_id"], F.col("pname").alias("event_name"), "signal_type", "n")
    return C.signal_routes(j).groupBy("repo_id", "event_name", "signal_type", "destination") \
        .agg(F.sum("n").alias("n_events"))


@query("signal_groups", oracle=MERGED_DUCK + """, sig AS (
  SELECT m.*, coalesce(p.signal_type, 'action') AS signal_type
  FROM merged m LEFT JOIN plan_events p ON p.repo_id = m.repo_id AND p.name = m.name)
SELECT repo_id, signal_type, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, count(*) AS n_events
FROM sig GROUP BY repo_id, signal_type""")
def q_signal_groups(spark, sf_dir):
    """Plan event names grouped by signal type (new events default to action)."""
    m = merged_plan(spark, sf_dir)
    sig = T.plan_events(spark).select("repo_id", "name", "signal_type")
    x = m.join(sig, ["repo_id", "name"], "left").withColumn("signal_type", F.coalesce("signal_type", F.lit("action")))
    return x.groupBy("repo_id", "signal_type").agg(
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"),
        F.count(F.lit(1)).alias("n_events"))


@query("org_rollup", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("plan_events", fx.PLAN_EVENTS_SQL),
                                         fx.cte("repos", fx.REPOS_SQL), f"""pr AS (
  SELECT repo_id, count(*) AS plan_size, {D.cnt("status = 'implemented'")} AS implemented FROM plan_events GROUP BY 1),
er AS (SELECT repo_id, count(*) AS n_events FROM ev GROUP BY 1),
en AS (SELECT DISTINCT repo_id, event_name FROM ev),
base AS (SELECT r.owner, r.name AS repo, coalesce(er.n_events, 0) AS n_events,
                coalesce(pr.plan_size, 0) AS plan_size, coalesce(pr.implemented, 0) AS implemented, r.repo_id
         FROM repos r LEFT JOIN er ON er.repo_id = r.repo_id LEFT JOIN pr ON pr.repo_id = r.repo_id)""") + """
SELECT b.owner, b.repo, CAST(sum(b.n_events) AS BIGINT) AS n_events,
       CAST(sum(b.plan_size) AS BIGINT) AS plan_size, CAST(sum(b.implemented) AS BIGINT) AS implemented,
       CAST(CASE WHEN sum(b.plan_size) > 0 THEN round(CAST(sum(b.implemented) AS DOUBLE) / sum(b.plan_size) * 100) END AS BIGINT) AS coverage_pct,
       (SELECT count(DISTINCT en.event_name) FROM en JOIN base b2 ON b2.repo_id = en.repo_id
        WHERE (b.owner IS NULL OR b2.owner = b.owner) AND (b.repo IS NULL OR b2.repo = b.repo)) AS n_names
FROM base b GROUP BY ROLLUP (b.owner, b.repo)""")
def q_org_rollup(spark, sf_dir):
    """Events and plan coverage per repo, per owner and in total (rollup)."""
    ev = T.events(spark, sf_dir)
    repos = F.broadcast(T.repos(spark).select("repo_id", "owner", F.col("name").alias("repo")))
    per_repo = ev.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_events"))
    plan = T.plan_events(spark).groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("plan_size"), F.count_if(F.col("status") == "implemented").alias("implemented"))
    nums = (repos.join(per_repo, "repo_id", "left").join(plan, "repo_id", "left")
            .rollup("owner", "repo").agg(
                F.sum(F.coalesce("n_events", F.lit(0))).cast("bigint").alias("n_events"),
                F.sum(F.coalesce("plan_size", F.lit(0))).cast("bigint").alias("plan_size"),
                F.sum(F.coalesce("implemented", F.lit(0))).cast("bigint").alias("implemented")))
    names = (ev.select("repo_id", "event_name").distinct().join(repos, "repo_id")
             .rollup("owner", "repo").agg(F.count_distinct("event_name").alias("n_names")))
    out = nums.join(names, nums["owner"].eqNullSafe(names["owner"]) & nums["repo"].eqNullSafe(names["repo"]), "left") \
        .select(nums["owner"], nums["repo"], "n_events", "plan_size", "implemented",
                F.coalesce("n_names", F.lit(0)).alias("n_names"))
    return out.withColumn("coverage_pct", F.when(F.col("plan_size") > 0, F.round(
        F.col("implemented").cast("double") / F.col("plan_size") * 100).cast("bigint")))
