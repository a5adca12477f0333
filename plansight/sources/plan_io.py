"""Tracking-plan documents: write (S4) and read (S3) nested JSON, one
document per repo, and flatten them back to plan rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAN_VERSION = "1.0"

EVENT = T.StructType([T.StructField(n, T.StringType()) for n in
                      ("id", "name", "description", "priority", "status", "firstSeen", "lastSeen", "location")])
PLAN_SCHEMA = T.StructType([
    T.StructField("repo_id", T.LongType()),
    T.StructField("version", T.StringType()),
    T.StructField("events", T.ArrayType(EVENT)),
])


def write_plans(plan: DataFrame, path: str) -> None:
    """One JSON document per repo (events in plan order), written as JSON
    lines partitioned by nothing; a repo's plan is one row, bounded by the
    plan size, never by the event stream."""
    ev = F.struct(F.col("id"), F.col("name"), F.col("description"), F.col("priority"), F.col("status"),
                  F.col("first_seen").alias("firstSeen"), F.col("last_seen").alias("lastSeen"), F.col("location"))
    docs = plan.groupBy("repo_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord"), F.col("id").alias("_id"), ev.alias("e")))),
                    lambda s: s["e"]).alias("events"))
    docs.select(F.col("repo_id").cast("long"), F.lit(PLAN_VERSION).alias("version"), "events") \
        .write.mode("overwrite").json(path)


def empty_plan(spark: SparkSession, repo_id: int) -> DataFrame:
    """The empty plan document of a repo."""
    return spark.createDataFrame([(repo_id, PLAN_VERSION, [])], PLAN_SCHEMA)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """S3: plan documents with an explicit schema; documents without a
    version or without an events array are treated as missing."""
    docs = spark.read.schema(PLAN_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return docs.where(F.col("version").isNotNull() & F.col("events").isNotNull())


def flatten(docs: DataFrame) -> DataFrame:
    x = docs.select("repo_id", F.posexplode("events").alias("pos", "e"))
    return x.select("repo_id", (F.col("pos") + 1).alias("ord"), "e.id", "e.name", "e.description", "e.priority",
                    "e.status", F.col("e.firstSeen").alias("first_seen"), F.col("e.lastSeen").alias("last_seen"),
                    "e.location")
