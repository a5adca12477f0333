"""Readers for the given parquet tables and the canonical fact tables.

Reads stay lazy: Catalyst prunes columns and pushes filters into the parquet
scan, so an operator that needs two columns reads two columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import fixtures as fx

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def canonical_events(raw: DataFrame) -> DataFrame:
    """Map the given `events` table onto the event-store schema.

    repo = user_id % 5; every tenth event comes from staging; the arrival
    time and the client time are both the given `ts` (timestamp_ntz).
    """
    return raw.select(
        F.col("event_id"),
        (F.col("user_id") % 5).alias("repo_id"),
        F.col("event_type").alias("event_name"),
        F.col("user_id"),
        F.col("props").alias("properties"),
        F.when(F.col("event_id") % 10 == 0, F.lit("staging"))
         .otherwise(F.lit("production")).alias("environment"),
        F.col("ts").alias("event_ts"),
        F.col("ts").alias("received_at"),
        F.col("value"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_events(read_table(spark, sf_dir, "events"))


def dim(spark: SparkSession, sql: str) -> DataFrame:
    """A small inline dimension from portable VALUES SQL (bounded by construction)."""
    return spark.sql(sql)


def plan_events(spark: SparkSession) -> DataFrame:
    return dim(spark, fx.PLAN_EVENTS_SQL)


def plan_props(spark: SparkSession) -> DataFrame:
    return dim(spark, fx.PLAN_PROPS_SQL)


def repos(spark: SparkSession) -> DataFrame:
    return dim(spark, fx.REPOS_SQL)


def max_of(df: DataFrame, col: str) -> Column:
    """Lazy scalar subquery ``(SELECT max(col) FROM df)``; no driver round trip."""
    return df.agg(F.max(col)).scalar()
