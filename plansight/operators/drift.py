"""Plan versus actual: seen / unseen plan events, coverage and drift.

The plan is a small dimension (bounded by the number of governed events) and
is broadcast; the event side only ever arrives pre-aggregated (A1), so every
join here is between an aggregate and a dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _key(col: str, strict_case: bool):
    return F.col(col) if strict_case else F.lower(F.col(col))


def keyed_counts(counts: DataFrame, strict_case: bool = False) -> DataFrame:
    """A1 counts re-keyed by the plan match key (lower-cased unless strict)."""
    return (counts.withColumn("_k", _key("event_name", strict_case))
            .groupBy("repo_id", "_k")
            .agg(F.sum("n_events").alias("n_events"), F.max("last_seen").alias("last_seen")))


def plan_vs_actual(plan: DataFrame, counts: DataFrame, strict_case: bool = False) -> DataFrame:
    """Every plan event with its recent count and last arrival.

    ``missing`` marks implemented events that were not seen in the window
    (the dashboard's warning zero). The counts are first cut to plan keys with
    a broadcast semi join, so the outer join only sees at most |plan| rows.
    """
    p = plan.select("repo_id", "ord", "name", "status", "priority").withColumn("_k", _key("name", strict_case))
    c = keyed_counts(counts, strict_case).join(
        F.broadcast(p.select("repo_id", "_k")), ["repo_id", "_k"], "left_semi")
    out = p.join(c, ["repo_id", "_k"], "left")
    return out.select(
        "repo_id", "ord", "name", "status", "priority",
        F.coalesce(F.col("n_events"), F.lit(0)).cast("bigint").alias("n_events"),
        "last_seen",
        ((F.col("status") == "implemented") & F.col("n_events").isNull()).alias("missing"),
    )


def seen_coverage(plan: DataFrame, counts: DataFrame, repos: DataFrame,
                  strict_case: bool = False) -> DataFrame:
    """J3 / A4(c): implemented plan events seen in the window / implemented.

    ``coverage_pct`` is ``round(100 * seen / implemented)`` (half up) and null
    for a repo without implemented events.
    """
    impl = plan.where(F.col("status") == "implemented").withColumn("_k", _key("name", strict_case))
    seen = impl.join(keyed_counts(counts, strict_case).select("repo_id", "_k"),
                     ["repo_id", "_k"], "left_semi")
    n_impl = impl.groupBy("repo_id").agg(F.count(F.lit(1)).alias("implemented"))
    n_seen = seen.groupBy("repo_id").agg(F.count(F.lit(1)).alias("seen"))
    out = (repos.select("repo_id").join(n_impl, "repo_id", "left").join(n_seen, "repo_id", "left")
           .select("repo_id",
                   F.coalesce("implemented", F.lit(0)).cast("bigint").alias("implemented"),
                   F.coalesce("seen", F.lit(0)).cast("bigint").alias("seen")))
    return out.withColumn(
        "coverage_pct",
        F.when(F.col("implemented") > 0,
               F.round(F.col("seen").cast("double") / F.col("implemented") * 100).cast("bigint")))


def unplanned_events(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """Received event names absent from the repo's plan (lower-cased plan names)."""
    names = F.broadcast(plan.select("repo_id", F.lower("name").alias("event_name")).distinct())
    return counts.join(names, ["repo_id", "event_name"], "left_anti")
