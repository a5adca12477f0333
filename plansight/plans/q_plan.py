"""Plan governance queries: merge with a scan, status changes, counts, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.util import LATER
from ..operators import plan as P
from ..sources import tables as T
from . import duck as D
from . import fixtures as fx
from .catalog import query

ISO = "%Y-%m-%dT%H:%M:%S"
PLAN_COLS = ", ".join(P.PLAN_COLS)

# Existing plan with ids, and the "new scan": the event names each repo
# actually sends, proposed as implemented events.
PLAN_IDS = fx.cte("plan_events", fx.PLAN_EVENTS_SQL) + f""",
ex AS (SELECT repo_id, {D.event_id('name')} AS id, name, description, priority, status,
              first_seen, last_seen, location, ord FROM plan_events),
nowt AS (SELECT max(received_at) AS now FROM ev),
nw AS (SELECT repo_id, {D.event_id('lower(event_name)')} AS id, lower(event_name) AS name,
              'Observed ' || lower(event_name) AS description,
              {D.priority_heuristic('lower(event_name)', "'mutation'")} AS priority,
              'implemented' AS status, strftime(min(received_at), '{ISO}') AS first_seen,
              strftime(max((SELECT now FROM nowt)), '{ISO}') AS last_seen, 'stream' AS location
       FROM ev GROUP BY repo_id, lower(event_name))"""


def existing_plan(spark):
    return P.with_ids(T.plan_events(spark))


def observed_as_new(events):
    now = events.agg(F.max("received_at")).scalar()
    return (events.groupBy("repo_id", F.lower("event_name").alias("name"))
            .agg(F.min("received_at").alias("_first"))
            .select("repo_id", N.event_id("name").alias("id"), "name",
                    F.concat(F.lit("Observed "), "name").alias("description"),
                    N.priority_heuristic("name", F.lit("mutation")).alias("priority"),
                    F.lit("implemented").alias("status"),
                    F.date_format("_first", "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen"),
                    F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("last_seen"),
                    F.lit("stream").alias("location")))


@query("plan_merge", oracle=fx.with_ctes(fx.EVENTS_CTE, PLAN_IDS) + f"""
SELECT coalesce(ex.repo_id, nw.repo_id) AS repo_id, coalesce(ex.id, nw.id) AS id,
  CASE WHEN ex.id IS NULL THEN nw.name WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.name ELSE ex.name END AS name,
  CASE WHEN ex.id IS NULL THEN nw.description WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.description ELSE ex.description END AS description,
  CASE WHEN ex.id IS NULL THEN nw.priority WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.priority ELSE ex.priority END AS priority,
  CASE WHEN ex.id IS NULL THEN nw.status ELSE ex.status END AS status,
  CASE WHEN ex.id IS NULL THEN nw.first_seen ELSE ex.first_seen END AS first_seen,
  CASE WHEN ex.id IS NULL THEN nw.last_seen
       WHEN nw.id IS NOT NULL AND ex.status IN ('suggested', 'approved', 'implemented')
       THEN strftime((SELECT now FROM nowt), '{ISO}') ELSE ex.last_seen END AS last_seen,
  CASE WHEN ex.id IS NULL THEN nw.location
       WHEN nw.id IS NOT NULL AND ex.status IN ('suggested', 'approved') THEN nw.location ELSE ex.location END AS location
FROM ex FULL OUTER JOIN nw ON ex.repo_id = nw.repo_id AND ex.id = nw.id""")
def q_plan_merge(spark, sf_dir):
    ev = T.events(spark, sf_dir)
    now = ev.agg(F.max("received_at")).scalar()
    return P.merge(existing_plan(spark), observed_as_new(ev), now)


@query("plan_merge_stats", oracle=fx.with_ctes(fx.EVENTS_CTE, PLAN_IDS) + f"""
SELECT coalesce(ex.repo_id, nw.repo_id) AS repo_id,
  {D.cnt("nw.id IS NOT NULL AND ex.id IS NULL")} AS added,
  {D.cnt("nw.id IS NOT NULL AND ex.status = 'suggested'")} AS updated,
  {D.cnt("nw.id IS NOT NULL AND ex.status = 'implemented'")} AS confirmed,
  {D.cnt("ex.id IS NOT NULL AND nw.id IS NULL")} AS unchanged
FROM ex FULL OUTER JOIN nw ON ex.repo_id = nw.repo_id AND ex.id = nw.id
GROUP BY 1""")
def q_plan_merge_stats(spark, sf_dir):
    return P.merge_stats(existing_plan(spark), observed_as_new(T.events(spark, sf_dir)))


MERGED_DUCK = fx.with_ctes(fx.EVENTS_CTE, PLAN_IDS, """merged AS (
SELECT coalesce(ex.repo_id, nw.repo_id) AS repo_id, coalesce(ex.id, nw.id) AS id,
  CASE WHEN ex.id IS NULL THEN nw.name WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.name ELSE ex.name END AS name,
  CASE WHEN ex.id IS NULL THEN nw.priority WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.priority ELSE ex.priority END AS priority,
  CASE WHEN ex.id IS NULL THEN nw.status ELSE ex.status END AS status,
  coalesce(ex.ord, """ + str(LATER) + """) AS ord
FROM ex FULL OUTER JOIN nw ON ex.repo_id = nw.repo_id AND ex.id = nw.id)""")


def merged_plan(spark, sf_dir):
    """The merged plan with a plan-order column (new events after the plan)."""
    ev = T.events(spark, sf_dir)
    now = ev.agg(F.max("received_at")).scalar()
    m = P.merge(existing_plan(spark), observed_as_new(ev), now)
    ords = existing_plan(spark).select("repo_id", "id", "ord")
    return m.join(ords, ["repo_id", "id"], "left").withColumn("ord", F.coalesce(F.col("ord").cast("long"), F.lit(LATER)))


@query("plan_approve", oracle=MERGED_DUCK + """
SELECT repo_id, id, name, CASE WHEN status = 'suggested' THEN 'approved' ELSE status END AS status FROM merged""")
def q_plan_approve(spark, sf_dir):
    return P.approve(merged_plan(spark, sf_dir)).select("repo_id", "id", "name", "status")


@query("plan_reject", oracle=MERGED_DUCK + """
SELECT repo_id, id, name,
  CASE WHEN name = 'click' AND status IN ('suggested', 'approved') THEN 'deprecated' ELSE status END AS status
FROM merged""")
def q_plan_reject(spark, sf_dir):
    return P.reject(merged_plan(spark, sf_dir), event_name="click").select("repo_id", "id", "name", "status")


@query("status_counts", oracle=MERGED_DUCK + f""", r AS ({fx.REPOS_SQL})
SELECT r.repo_id,
  {D.cnt("m.status = 'suggested'")} AS suggested,
  CAST({D.cnt("m.status = 'approved'")} AS BIGINT) AS approved,
  CAST({D.cnt("m.status = 'implemented'")} AS BIGINT) AS implemented,
  CAST({D.cnt("m.status = 'deprecated'")} AS BIGINT) AS deprecated
FROM r LEFT JOIN merged m ON m.repo_id = r.repo_id GROUP BY r.repo_id""")
def q_status_counts(spark, sf_dir):
    return P.status_counts(merged_plan(spark, sf_dir), T.repos(spark))


COVERAGE_DUCK = fx.with_ctes(fx.cte("plan_events", fx.PLAN_EVENTS_SQL), fx.cte("r", fx.REPOS_SQL), f"""sc AS (
SELECT r.repo_id,
  {D.cnt("p.status = 'suggested'")} AS s, {D.cnt("p.status = 'approved'")} AS a,
  {D.cnt("p.status = 'implemented'")} AS i, {D.cnt("p.status = 'deprecated'")} AS d
FROM r LEFT JOIN plan_events p ON p.repo_id = r.repo_id GROUP BY r.repo_id)""")


@query("coverage_plan", oracle=COVERAGE_DUCK + """
SELECT repo_id, i AS tracked, s AS suggested, a AS approved, i AS implemented,
  CAST(CASE WHEN s + a + i > 0 THEN round(CAST(i AS DOUBLE) / (s + a + i) * 100) ELSE 0 END AS BIGINT) AS percentage,
  CAST(CASE WHEN s + a + i + d > 0 THEN round(CAST(i AS DOUBLE) / (s + a + i + d) * 100) END AS BIGINT) AS org_percentage
FROM sc""")
def q_coverage_plan(spark, sf_dir):
    """A4(a) and A4(d) on the governed plan. The plan is joined to the repos
    seen in the event table, so the query reads the facts it governs."""
    repos = T.events(spark, sf_dir).select("repo_id").distinct()
    return P.plan_coverage(T.plan_events(spark), repos)


@query("status_topk", oracle=MERGED_DUCK + f"""
SELECT repo_id, status, rank, name, priority, n_status FROM (
  SELECT repo_id, status, name, priority,
    row_number() OVER (PARTITION BY repo_id, status ORDER BY {D.priority_rank('priority')}, ord, name) AS rank,
    count(*) OVER (PARTITION BY repo_id, status) AS n_status
  FROM merged WHERE status IN ('approved', 'suggested')) t
WHERE rank <= 5""")
def q_status_topk(spark, sf_dir):
    m = merged_plan(spark, sf_dir)
    return P.status_topk(m.withColumn("ord", F.struct("ord", "name")), k=5)
