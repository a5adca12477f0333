"""Streams that deliver everything their batch forms do."""

from pyspark.sql import functions as F

from plansight.plans import REGISTRY

from .conftest import SMALL


def test_every_pending_alert_fires(spark):
    got = REGISTRY["stream_sequence_timeout"].build(spark, SMALL).select("user_id", "start_id", "t1_us", "missing_step")
    batch = REGISTRY["sequence_anomalies"].build(spark, SMALL).select(
        "user_id", "start_id", F.unix_micros(F.col("t1").cast("timestamp")), "missing_step")
    want = sorted(map(tuple, batch.collect()))
    assert want and sorted(map(tuple, got.collect())) == want
