"""ST3 / ST5: claims by key that expire.

The first delivery of a key claims it; later ones are duplicates until the
claim is older than its retention, after which the next delivery claims anew.
A claim is one ValueState. By event time, it holds the time of the claim and a
timer clears it once the watermark has passed its retention; by processing
time, the retention is the state's TTL and the store drops it. Either way the
state holds only keys claimed within the retention. A key's rows of a
micro-batch are taken in time order; only their times and ids are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Retention of the reference's two claim tables, in days.
DELIVERY_DAYS, HEAD_DAYS = 90, 365
DAY_US = 86_400_000_000
#: TTL and timers need RocksDB; a commit writes what changed, not a snapshot, and a small store does not reserve megabytes of disk.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
               "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def decide(times: np.ndarray, claimed: int | None, retention: int) -> tuple[np.ndarray, int | None]:
    """Which of the sorted times claim, given the claim that stands; the claim that stands after them."""
    won = np.zeros(len(times), bool)
    at = 0
    while at < len(times):
        if claimed is not None:  # the first time that the standing claim does not cover
            at = max(at, int(np.searchsorted(times, claimed + retention, side="left")))
            if at == len(times):
                break
        won[at] = True
        claimed = int(times[at])
        at += 1
    return won, claimed


class ClaimProcessor(StatefulProcessor):
    """Marks every delivery of a key as claiming or duplicate."""

    def __init__(self, keys: list[str], retention_us: int, event_time: bool):
        self.keys, self.retention, self.event_time = keys, retention_us, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.event_time else max(1, self.retention // 1000)
        self.claim = handle.getValueState("claim", "claimed_us long", ttlDurationMs=ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        parts = [(r["t"].to_numpy(np.int64), r["delivery_id"].to_numpy(np.int64)) for r in rows]
        times, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        before = self.claim.get()[0] if self.claim.exists() else None
        if self.event_time:
            won, after = decide(times, before, self.retention)
            if after != before:
                if before is not None:
                    self.handle.deleteTimer(self.expiry(before))
                self.claim.update((after,))
                self.handle.registerTimer(self.expiry(after))
        else:
            won = np.zeros(len(times), bool)
            if before is None:
                won[0] = True
                self.claim.update((int(times[0]),))
        yield pd.DataFrame({**{k: [v] * len(ids) for k, v in zip(self.keys, key, strict=True)}, "delivery_id": ids, "acquired": won})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        self.claim.clear()
        return iter([])

    def expiry(self, claimed: int) -> int:
        return -(-(claimed + self.retention) // 1000)

    def close(self) -> None:
        pass


def claims(deliveries: DataFrame, keys: list[str], time_col: str, retention_days: float, delay: str = "1 hour",
           event_time: bool = True) -> DataFrame:
    """Every delivery of a stream with ``acquired``: does it claim its key?

    ``deliveries`` has the key columns, ``delivery_id`` and ``time_col``. A delivery whose key is null belongs to the null
    key. Deliveries that come later than the watermark (``delay`` behind the newest) are dropped by the stream; the claim
    of a key never outlives ``retention_days`` after it was made. Without ``event_time`` the clock is that of the
    cluster, as for a live stream: nothing is late, and a claim lasts from the batch that made it."""
    x = deliveries.select(*keys, F.col("delivery_id").cast("long").alias("delivery_id"), F.col(time_col).cast("timestamp").alias("_et"))
    x = (x.withWatermark("_et", delay) if event_time else x).withColumn("t", F.unix_micros("_et"))
    out = T.StructType([*(x.schema[k] for k in keys), T.StructField("delivery_id", T.LongType()), T.StructField("acquired", T.BooleanType())])
    return x.groupBy(*keys).transformWithStateInPandas(
        ClaimProcessor(keys, round(retention_days * DAY_US), event_time), outputStructType=out, outputMode="append",
        timeMode="EventTime" if event_time else "ProcessingTime")


def drain(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str, event_time: bool = True) -> None:
    """Run a claims stream over what its source holds.

    By processing time Spark always has a next batch to expire claims in, so that one batch is run instead of a drain."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        w = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        (w.trigger(availableNow=True) if event_time else w.trigger(once=True)).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def head_deliveries(events: DataFrame) -> DataFrame:
    """Webhook deliveries of pull-request heads, derived from raw events: one per event, several per head."""
    user, event = F.col("user_id"), F.col("event_id")
    return events.select(
        F.when(user % 5 < 3, 100).otherwise(200).alias("installation_id"),
        F.concat(F.lit("acme/repo"), (user % 5).cast("string")).alias("repo_full_name"), (user % 20).cast("int").alias("pr_number"),
        F.substring(F.sha2(F.concat_ws(":", (user % 20).cast("string"), (event % 12).cast("string")), 256), 1, 12).alias("head_sha"),
        event.alias("delivery_id"), F.col("ts").alias("delivered_at"))
