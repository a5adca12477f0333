"""Expected sequences (funnels), attempt numbers and lifecycle outcome rates.

Every step lookup is an as-of join done with ``ordered.next_time_after`` -
no per-entity array is ever collected and no pairs within an entity are
emitted, so a user with a third of all events still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


def millis_between(a, b):
    """Whole milliseconds from ``a`` to ``b`` (floor), null if either is null."""
    us = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return F.floor(us / 1000).cast("bigint")


def funnel(events: DataFrame, steps: list[str], window_seconds: int, entity: str = "user_id",
           time_col: str = "received_at", id_col: str = "event_id",
           bucket_seconds: int = ordered.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Greedy evaluation of an ordered sequence from every start event.

    Step 1 is each event named ``steps[0]``; step k is the first event named
    ``steps[k-1]`` strictly after step k-1, and it counts only if it lies
    within ``window_seconds`` of step 1. One row per start with ``t1..tk``,
    ``steps_reached``, ``completed`` and ``time_to_complete_ms``.
    """
    ev = events.select(entity, id_col, "event_name", time_col)
    cur = ev.where(F.col("event_name") == steps[0]).select(
        entity, F.col(id_col).alias("start_id"), F.col(time_col).alias("t1"))
    deadline = F.col("t1") + F.make_dt_interval(secs=F.lit(window_seconds))
    for k in range(2, len(steps) + 1):
        prev = f"t{k - 1}"
        cand = ev.where(F.col("event_name") == steps[k - 1]).select(entity, F.col(time_col).alias("_t"))
        probes = cur.withColumn("_t", F.col(prev))
        reached_prev = F.col(prev).isNotNull()
        live = probes.where(reached_prev)
        dead = probes.where(~reached_prev).withColumn(f"t{k}", F.lit(None).cast(cur.schema["t1"].dataType))
        nxt = ordered.next_time_after(live, cand, [entity], "_t", f"_n{k}", bucket_seconds)
        nxt = nxt.withColumn(f"t{k}", F.when(F.col(f"_n{k}") <= deadline, F.col(f"_n{k}"))).drop(f"_n{k}")
        cur = nxt.unionByName(dead).drop("_t")
    reached = sum(F.when(F.col(f"t{k}").isNotNull(), 1).otherwise(0) for k in range(1, len(steps) + 1))
    last = F.col(f"t{len(steps)}")
    return (cur.withColumn("steps_reached", reached.cast("int"))
            .withColumn("completed", last.isNotNull())
            .withColumn("time_to_complete_ms", millis_between(F.col("t1"), last)))


def funnel_summary(per_start: DataFrame, n_steps: int) -> DataFrame:
    """Starts reaching each step: one row per step (conversion from step 1)."""
    aggs = [F.count_if(F.col(f"t{k}").isNotNull()).alias(f"s{k}") for k in range(1, n_steps + 1)]
    wide = per_start.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"s{k}").alias("n_reached"))
                                for k in range(1, n_steps + 1)]))
    return wide.select(stack.alias("x"), F.col("s1")).select(
        "x.step", "x.n_reached",
        F.round(F.col("x.n_reached") / F.col("s1"), 6).alias("conversion"))


def sequence_anomalies(per_start: DataFrame, steps: list[str]) -> DataFrame:
    """Starts that did not complete, with the first missing step's name."""
    missing = F.coalesce(*[F.when(F.col(f"t{k}").isNull(), F.lit(steps[k - 1]))
                           for k in range(2, len(steps) + 1)])
    return per_start.where(~F.col("completed")).withColumn("missing_step", missing)


def attempt_numbers(events: DataFrame, attempt: str, failure: str, success: str,
                    entity: str = "user_id", time_col: str = "received_at", id_col: str = "event_id",
                    bucket_seconds: int = ordered.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """For each failure event, the number of attempts since the entity's
    last success (attempts reset at a success)."""
    ev = events.where(F.col("event_name").isin(attempt, failure, success)) \
        .select(entity, id_col, "event_name", time_col)
    order = [time_col, id_col]
    x = ordered.prefix_sum(ev, [entity], order, (F.col("event_name") == attempt).cast("long"),
                           "_att", time_col=time_col, bucket_seconds=bucket_seconds)
    x = x.withColumn("_at_success", F.when(F.col("event_name") == success, F.col("_att")))
    x = ordered.carry(x, [entity], order, "_at_success", "_base", direction="forward",
                      inclusive=True, time_col=time_col, bucket_seconds=bucket_seconds)
    return (x.where(F.col("event_name") == failure)
            .select(entity, id_col, time_col,
                    (F.col("_att") - F.coalesce(F.col("_base"), F.lit(0))).alias("attempt_number")))


def time_since_previous(events: DataFrame, created: str, completed: str, entity: str = "user_id",
                        time_col: str = "received_at", id_col: str = "event_id",
                        bucket_seconds: int = ordered.DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """``time_to_complete_ms`` of each completion event, measured from the
    entity's latest creation event at or before it (null if none)."""
    ev = events.where(F.col("event_name").isin(created, completed)).select(entity, id_col, "event_name", time_col)
    x = ev.withColumn("_c", F.when(F.col("event_name") == created, F.col(time_col)))
    x = ordered.carry(x, [entity], [time_col, id_col], "_c", "_created_at", direction="forward",
                      inclusive=True, time_col=time_col, bucket_seconds=bucket_seconds)
    ms = millis_between(F.col("_created_at"), F.col(time_col))
    return (x.where(F.col("event_name") == completed)
            .select(entity, id_col, time_col, ms.alias("time_to_complete_ms")))


def outcome_rates(events: DataFrame, flows: DataFrame) -> DataFrame:
    """Success / fail / skip rates per flow and lifecycle.

    ``flows(flow, event_name, lifecycle)`` maps concrete event names to a
    lifecycle outcome (attempt, success, fail, start, complete, skip). Counts
    are taken per flow; rates are relative to attempts (or starts when the
    flow has no attempt events)."""
    j = events.select("event_name").join(F.broadcast(flows), "event_name")
    c = j.groupBy("flow").agg(*[F.count_if(F.col("lifecycle") == lc).alias(lc)
                                for lc in ("attempt", "success", "fail", "start", "complete", "skip")])
    base = F.when(F.col("attempt") > 0, F.col("attempt")).otherwise(F.col("start"))
    return c.select(
        "flow", "attempt", "success", "fail", "start", "complete", "skip",
        F.round(F.col("success") / F.when(base > 0, base), 6).alias("success_rate"),
        F.round(F.col("fail") / F.when(base > 0, base), 6).alias("fail_rate"),
        F.round(F.col("skip") / F.when(base > 0, base), 6).alias("skip_rate"))
