"""Tracking-plan governance: merge, status changes, status counts, coverage.

The plan is a dimension (one row per governed event and repo). Merges are a
full outer join on (repo, id) with per-status column rules - the same logic a
MERGE INTO statement expresses - so they scale with the plan, not the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

STATUSES = ["suggested", "approved", "implemented", "deprecated"]
PLAN_COLS = ["repo_id", "id", "name", "description", "priority", "status",
             "first_seen", "last_seen", "location"]


def with_ids(plan: DataFrame) -> DataFrame:
    """stable ``evt_`` id from the event name."""
    return plan.withColumn("id", N.event_id("name"))


def merge(existing: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Merge a new scan into the existing plan, matched by (repo, id).

    suggested  -> the new event, still suggested, first_seen kept, last_seen=now
    approved   -> existing, with the new location and last_seen=now
    implemented-> existing, last_seen=now
    deprecated -> untouched
    unmatched existing rows are kept as they are; unmatched new rows are added.
    A merge never promotes a status.
    """
    e = existing.select(*[F.col(c).alias("e_" + c) for c in PLAN_COLS])
    n = new.select(*[F.col(c).alias("n_" + c) for c in PLAN_COLS])
    j = e.join(n, (F.col("e_repo_id") == F.col("n_repo_id")) & (F.col("e_id") == F.col("n_id")), "full_outer")
    st = F.col("e_status")
    matched = F.col("e_id").isNotNull() & F.col("n_id").isNotNull()
    only_new = F.col("e_id").isNull()

    def pick(c: str, rules: dict[str, Column]) -> Column:
        expr = F.when(only_new, F.col("n_" + c))
        for status, val in rules.items():
            expr = expr.when(matched & (st == status), val)
        return expr.otherwise(F.col("e_" + c)).alias(c)

    now_s = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    out = j.select(
        pick("repo_id", {}), pick("id", {}),
        pick("name", {"suggested": F.col("n_name")}),
        pick("description", {"suggested": F.col("n_description")}),
        pick("priority", {"suggested": F.col("n_priority")}),
        pick("status", {}),
        pick("first_seen", {}),
        pick("last_seen", {"suggested": now_s, "approved": now_s, "implemented": now_s}),
        pick("location", {"suggested": F.col("n_location"), "approved": F.col("n_location")}),
    )
    return out


def merge_stats(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Added / updated / confirmed / unchanged counts per repo."""
    e = existing.select("repo_id", "id", F.col("status").alias("e_status"), F.lit(True).alias("in_e"))
    n = new.select("repo_id", "id", F.lit(True).alias("in_n"))
    j = e.join(n, ["repo_id", "id"], "full_outer")
    in_e, in_n = F.col("in_e").isNotNull(), F.col("in_n").isNotNull()
    return j.groupBy("repo_id").agg(
        F.count_if(in_n & ~in_e).alias("added"),
        F.count_if(in_n & in_e & (F.col("e_status") == "suggested")).alias("updated"),
        F.count_if(in_n & in_e & (F.col("e_status") == "implemented")).alias("confirmed"),
        F.count_if(in_e & ~in_n).alias("unchanged"),
    )


def approve(plan: DataFrame, event_name: str | None = None) -> DataFrame:
    """Suggested -> approved, for one name or (``None``) for all."""
    cond = F.col("status") == "suggested"
    if event_name is not None:
        cond = cond & (F.col("name") == event_name)
    return plan.withColumn("status", F.when(cond, "approved").otherwise(F.col("status")))


def reject(plan: DataFrame, event_name: str | None = None) -> DataFrame:
    """suggested/approved -> deprecated, for one name or all."""
    cond = F.col("status").isin("suggested", "approved")
    if event_name is not None:
        cond = cond & (F.col("name") == event_name)
    return plan.withColumn("status", F.when(cond, "deprecated").otherwise(F.col("status")))


def mark_implemented(plan: DataFrame, implemented: DataFrame, now: Column) -> DataFrame:
    """Events named (case-insensitively) in ``implemented(repo_id, event_name)``
    become implemented, from any other status (deprecated included); their
    last_seen moves to ``now``."""
    imp = implemented.select("repo_id", F.lower("event_name").alias("_k")).distinct() \
        .withColumn("_hit", F.lit(True))
    j = plan.withColumn("_k", F.lower("name")).join(imp, ["repo_id", "_k"], "left")
    promote = F.col("_hit").isNotNull() & (F.col("status") != "implemented")
    return (j.withColumn("last_seen", F.when(promote, F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
                         .otherwise(F.col("last_seen")))
             .withColumn("status", F.when(promote, "implemented").otherwise(F.col("status")))
             .drop("_k", "_hit"))


def status_counts(plan: DataFrame, repos: DataFrame) -> DataFrame:
    """A3: the four status counts per repo, zero-filled for repos without a plan."""
    agg = plan.groupBy("repo_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    out = repos.select("repo_id").join(agg, "repo_id", "left")
    return out.select("repo_id", *[F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias(s) for s in STATUSES])


def _pct(num: Column, den: Column) -> Column:
    return F.round(num.cast("double") / den * 100).cast("bigint")


def plan_coverage(plan: DataFrame, repos: DataFrame) -> DataFrame:
    """A4(a): implemented / non-deprecated events, 0 when the plan has none.
    A4(d) (org card): implemented / all events including deprecated, null
    when the plan is empty."""
    sc = status_counts(plan, repos)
    active = F.col("suggested") + F.col("approved") + F.col("implemented")
    total = active + F.col("deprecated")
    return sc.select(
        "repo_id",
        F.col("implemented").alias("tracked"), "suggested", "approved", "implemented",
        F.when(active > 0, _pct(F.col("implemented"), active)).otherwise(F.lit(0)).cast("bigint").alias("percentage"),
        F.when(total > 0, _pct(F.col("implemented"), total)).alias("org_percentage"),
    )


def status_topk(plan: DataFrame, k: int = 5, statuses=("approved", "suggested")) -> DataFrame:
    """Per repo and status, the first ``k`` events by priority (stable in plan order)."""
    w = Window.partitionBy("repo_id", "status").orderBy(N.priority_rank("priority"), "ord")
    ranked = plan.where(F.col("status").isin(*statuses)).withColumn("rank", F.row_number().over(w))
    more = F.count(F.lit(1)).over(Window.partitionBy("repo_id", "status"))
    return (ranked.withColumn("n_status", more).where(F.col("rank") <= k)
            .select("repo_id", "status", "rank", "name", "priority", "n_status"))
