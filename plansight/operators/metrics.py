"""Metric definitions (generation) and their evaluation over the event table.

Evaluation never runs one job per metric: events are pre-aggregated once per
(grain, bucket, event name) - a partial aggregate that collapses any hot name
before the shuffle - and every metric is then evaluated from that small
table through a join with the metric dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..functions.util import LATER
from ..functions.util import at as _at

from ..functions import names as N

# Metric grains and their date_trunc units.
GRAIN_UNITS = {"hourly": "HOUR", "daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}
CATEGORY_OF_PRIORITY = {"critical": "activation", "high": "engagement", "low": "retention"}


def generate_metrics(plan: DataFrame, lifecycle_objects: DataFrame) -> DataFrame:
    """A14 + A15: one ``<event>_count`` metric per non-deprecated event and one
    ``<obj>_completion_rate`` for every lifecycle object whose ``_created`` and
    ``_completed`` events are both in the plan; duplicates by lower-cased name
    keep the last definition. Per repo."""
    ev = plan.where(F.col("status") != "deprecated")
    cat = F.coalesce(_at(F.create_map(*[F.lit(x) for kv in CATEGORY_OF_PRIORITY.items() for x in kv]),
                                  F.col("priority")), F.lit("engagement"))
    counts = ev.select(
        "repo_id",
        F.concat("name", F.lit("_count")).alias("metric"),
        F.concat(F.lit("Count of "), "name").alias("description"),
        F.concat(F.lit("count(event = '"), "name", F.lit("')")).alias("formula"),
        F.array("name").alias("events"),
        cat.alias("category"), F.lit("daily").alias("grain"),
        F.col("ord").cast("bigint").alias("_seq"))
    names = ev.select("repo_id", F.lower("name").alias("lname")).distinct()
    objs = lifecycle_objects.select(F.col("object"), N.snake_from_camel("object").alias("obj")).distinct()
    created = names.where(F.col("lname").endswith("_created")) \
        .withColumn("obj", F.regexp_replace("lname", "_created$", ""))
    completed = names.where(F.col("lname").endswith("_completed")) \
        .withColumn("obj", F.regexp_replace("lname", "_completed$", "")).select("repo_id", "obj")
    conv = (created.join(F.broadcast(objs), "obj").join(completed, ["repo_id", "obj"], "left_semi")
            .select("repo_id",
                    F.concat("obj", F.lit("_completion_rate")).alias("metric"),
                    F.concat(F.lit("Share of "), "object", F.lit("s created that reach completed")).alias("description"),
                    F.concat(F.lit("count(event = '"), "obj", F.lit("_completed') / nullif(count(event = '"),
                             "obj", F.lit("_created'), 0)")).alias("formula"),
                    F.array(F.concat("obj", F.lit("_created")), F.concat("obj", F.lit("_completed"))).alias("events"),
                    F.lit("activation").alias("category"), F.lit("weekly").alias("grain"),
                    (F.lit(LATER) + F.dense_rank().over(Window.partitionBy("repo_id").orderBy("obj"))).cast("bigint").alias("_seq")))
    allm = counts.unionByName(conv)
    w = Window.partitionBy("repo_id", F.lower("metric")).orderBy(F.col("_seq").desc())
    return (allm.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select("repo_id", N.metric_id("metric").alias("id"), "metric", "description", "formula",
                    "events", "category", "grain", F.lit("suggested").alias("status")))


def metric_availability(metrics: DataFrame, plan: DataFrame) -> DataFrame:
    """A metric is available when every input event is implemented
    (exact name); otherwise the first missing event (in list order) is named."""
    impl = plan.where(F.col("status") == "implemented").select("repo_id", F.col("name").alias("ev")) \
        .distinct().withColumn("_ok", F.lit(True))
    x = metrics.select("repo_id", "metric", F.posexplode("events").alias("pos", "ev"))
    j = x.join(impl, ["repo_id", "ev"], "left")
    return j.groupBy("repo_id", "metric").agg(
        F.bool_and(F.col("_ok").isNotNull()).alias("available"),
        F.min_by(F.when(F.col("_ok").isNull(), F.col("ev")), F.when(F.col("_ok").isNull(), F.col("pos")))
        .alias("first_missing"))


def bucketed_name_counts(events: DataFrame, time_col: str = "received_at",
                         grains: tuple[str, ...] = tuple(GRAIN_UNITS)) -> DataFrame:
    """Pre-aggregate: events per (grain, bucket, event name) for every grain."""
    t = F.col(time_col)
    per_grain = F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(GRAIN_UNITS[g], t).alias("bucket"))
                          for g in grains])
    return (events.select("event_name", F.explode(per_grain).alias("g"))
            .groupBy(F.col("g.grain").alias("grain"), F.col("g.bucket").alias("bucket"), "event_name")
            .agg(F.count(F.lit(1)).alias("n")))


def evaluate_metrics(events: DataFrame, metrics: DataFrame, time_col: str = "received_at") -> DataFrame:
    """A16 + A17: value of every metric per bucket of its grain.

    count: ``count_if(event = num_event)``; ratio: ``count_if(num) /
    nullif(count_if(den), 0)``. Buckets are those with any event, so a
    bucket without the numerator event yields 0, not a missing row.
    """
    pre = bucketed_name_counts(events, time_col)
    m = F.broadcast(metrics.select("metric", "kind", "num_event", "den_event", "grain"))
    j = pre.join(m, "grain")
    agg = j.groupBy("metric", "kind", "grain", "bucket").agg(
        F.sum(F.when(F.col("event_name") == F.col("num_event"), F.col("n")).otherwise(0)).alias("num"),
        F.sum(F.when(F.col("event_name") == F.col("den_event"), F.col("n")).otherwise(0)).alias("den"))
    value = F.when(F.col("kind") == "count", F.col("num").cast("double")) \
        .otherwise(F.col("num") / F.when(F.col("den") != 0, F.col("den")))
    return agg.select("metric", "kind", "grain",
                      F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"),
                      F.col("num").cast("bigint").alias("num"), F.col("den").cast("bigint").alias("den"),
                      F.round(value, 6).alias("value"))


def metric_yaml(metrics: DataFrame) -> DataFrame:
    """One YAML text per metric (name, description, formula, events,
    category, grain, status)."""
    ev_lines = F.array_join(F.transform("events", lambda e: F.concat(F.lit("  - "), e)), "\n")
    text = F.concat_ws("\n",
                       F.concat(F.lit("id: "), "id"),
                       F.concat(F.lit("name: "), "metric"),
                       F.concat(F.lit("description: "), "description"),
                       F.concat(F.lit("formula: \""), "formula", F.lit("\"")),
                       F.lit("events:"), ev_lines,
                       F.concat(F.lit("category: "), "category"),
                       F.concat(F.lit("grain: "), "grain"),
                       F.concat(F.lit("status: "), "status"))
    return metrics.select("repo_id", "metric", text.alias("yaml"))


def unit_of(grain: Column) -> Column:
    return _at(F.create_map(*[F.lit(x) for kv in GRAIN_UNITS.items() for x in kv]), grain)


def expected_sequences(plan: DataFrame, lifecycle_objects: DataFrame) -> DataFrame:
    """A18 (generation): for every lifecycle object whose ``_created`` and
    ``_completed`` events are in the plan, the sequence created ->
    (edited, else activated, when planned) -> completed within 7 days."""
    names = plan.select("repo_id", F.lower("name").alias("n")).distinct()
    objs = lifecycle_objects.select("object", N.snake_from_camel("object").alias("obj")).distinct()
    has = (names.join(F.broadcast(objs), F.col("n").startswith(F.concat("obj", F.lit("_"))))
           .groupBy("repo_id", "object", "obj").agg(F.collect_set("n").alias("_ns")))

    def present(suffix):
        return F.array_contains("_ns", F.concat("obj", F.lit(suffix)))
    middle = F.when(present("_edited"), F.array(F.concat("obj", F.lit("_edited")))) \
        .when(present("_activated"), F.array(F.concat("obj", F.lit("_activated")))) \
        .otherwise(F.array().cast("array<string>"))
    steps = F.concat(F.array(F.concat("obj", F.lit("_created"))), middle, F.array(F.concat("obj", F.lit("_completed"))))
    return (has.where(present("_created") & present("_completed"))
            .select("repo_id", F.concat("obj", F.lit("_activation")).alias("name"), steps.alias("steps"),
                    F.lit("7d").alias("expected_window"),
                    F.concat(F.lit("Measures whether users activate after creating a "), "object").alias("significance")))
