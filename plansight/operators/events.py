"""Event-store aggregates: counts, totals, recent events, retention, transitions.

All of them are one scan of the event table plus a partial (map-side) and a
final aggregate, so a hot repo or event name is absorbed by the partial
aggregate before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import carry, top_n


def _since(events: DataFrame, days: int, as_of: Column | None, time_col: str) -> Column:
    """``time_col >= bound`` with the bound as one scalar, so the comparison reaches the scan."""
    span = F.make_dt_interval(F.lit(days))
    bound = events.agg(F.max(time_col) - span).scalar() if as_of is None else as_of - span
    return F.col(time_col) >= bound


def event_counts(events: DataFrame, days: int = 30, as_of: Column | None = None,
                 time_col: str = "received_at",
                 keys: tuple[str, ...] = ("repo_id", "event_name")) -> DataFrame:
    """A1: count and last arrival per (repo, event name) since ``as_of - days``.

    The boundary is inclusive (``>=``). ``as_of`` defaults to the newest
    arrival in the input, evaluated lazily as a scalar subquery.
    """
    return (events.where(_since(events, days, as_of, time_col))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.max(time_col).alias("last_seen")))


def event_totals(counts: DataFrame) -> DataFrame:
    """A2: total events and distinct event names per repo, over A1."""
    return (counts.groupBy("repo_id")
            .agg(F.sum("n_events").alias("total_events"),
                 F.count(F.lit(1)).alias("distinct_names")))


#: Size of the sketches (log2 of their registers) and the standard error that goes with it.
SKETCH_K = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_K / 2)


def daily_sketches(events: DataFrame, time_col: str = "received_at") -> DataFrame:
    """A2 by sketch: per (repo, day) the events, and mergeable sketches of their names and users.

    The table has a row per repo and day whatever the traffic; any range of days is answered from it alone."""
    return events.groupBy("repo_id", F.to_date(time_col).alias("date")).agg(
        F.count(F.lit(1)).alias("n_events"), F.hll_sketch_agg("event_name", F.lit(SKETCH_K)).alias("names"),
        F.hll_sketch_agg("user_id", F.lit(SKETCH_K)).alias("users"))


def totals_of_range(daily: DataFrame, first: Column, last: Column) -> DataFrame:
    """Totals and distinct names and users per repo over some days, from ``daily_sketches``."""
    return (daily.where(F.col("date").between(first, last)).groupBy("repo_id")
            .agg(F.sum("n_events").alias("total_events"),
                 F.hll_sketch_estimate(F.hll_union_agg("names")).alias("distinct_names"),
                 F.hll_sketch_estimate(F.hll_union_agg("users")).alias("distinct_users")))


def recent_events(events: DataFrame, n: int = 50, per: str = "repo_id",
                  time_col: str = "received_at") -> DataFrame:
    """The ``n`` most recent events of every repo (ties by event id).

    Spark cuts every input partition to its own ``n`` per repo before the
    shuffle, so a hot repo is no single task.
    """
    return top_n(events, [per], [F.col(time_col).desc(), F.col("event_id").desc()], n)


def retention_cleanup(claims: DataFrame, time_col: str, days: int,
                      as_of: Column | None = None) -> DataFrame:
    """ST5 (batch): keep claim rows younger than ``days`` (rows older are expired)."""
    if as_of is None:
        as_of = claims.agg(F.max(time_col)).scalar()
    return claims.where(F.col(time_col) >= as_of - F.make_dt_interval(F.lit(days)))


def state_transitions(df: DataFrame, entity: str, state: str, time_col: str,
                      tiebreak: str, declared: DataFrame | None = None,
                      object_name: str | None = None) -> DataFrame:
    """Counts of observed state -> next state transitions per entity.

    Each state is paired with the next one of the same entity, carried back
    over time buckets so that a hot entity is no single task; transitions are
    then counted. If ``declared`` states (object, ord, state) are given, each
    side is flagged when it lies outside the declared lifecycle.
    """
    rows = df.select(entity, time_col, tiebreak, F.struct(F.col(state).alias("s")).alias("at"))
    pairs = (carry(rows, [entity], [time_col, tiebreak], "at", "then", direction="backward", inclusive=False)
             .select(F.col("at.s").alias("from_state"), F.col("then.s").alias("to_state"))
             .where(F.col("to_state").isNotNull()))
    out = (pairs.groupBy("from_state", "to_state")
           .agg(F.count(F.lit(1)).alias("n_transitions")))
    if declared is not None:
        known = F.broadcast(declared.where(F.col("object") == object_name)
                            .select(F.col("state").alias("_s")))
        out = (out.join(known.withColumnRenamed("_s", "from_state")
                        .withColumn("_from_ok", F.lit(True)), "from_state", "left")
                  .join(known.withColumnRenamed("_s", "to_state")
                        .withColumn("_to_ok", F.lit(True)), "to_state", "left")
                  .withColumn("undeclared", F.col("_from_ok").isNull() | F.col("_to_ok").isNull())
                  .drop("_from_ok", "_to_ok"))
    return out
