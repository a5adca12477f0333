"""Structured Streaming versions of the ingest and live-monitoring paths.

Every job reads a file stream, applies the same operators as the batch path
(stream-static joins against broadcast dimensions), and writes to a sink in a
sub-folder of the session's shared checkpoint folder with its own checkpoint,
so a restarted job resumes exactly where it stopped (exactly-once to files).

``run_available_now`` drains the source with ``trigger(availableNow=True)``
and returns the sink read back as a batch DataFrame.

Aggregating jobs use update mode and an upserting sink: each micro-batch
appends its changed rows tagged with the batch id, and readers keep the last
version per key. Unlike append mode this also delivers the windows that are
still open when the source is drained, and unlike complete mode the state is
still cleaned by the watermark.
"""

from __future__ import annotations

import os
import uuid
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..session import scratch_path


def new_location(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch_path(spark, os.path.join("streams", f"{name}-{uuid.uuid4().hex[:12]}"))
    return os.path.join(base, "sink"), os.path.join(base, "checkpoint")


def file_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file stream over ``path`` (a file, folder or glob) with the schema of
    the data already there (read from the footers, not inferred per batch)."""
    schema = spark.read.format(fmt).load(path).schema
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if _is_file(spark, path):
        # a single file: watch its folder, admitting only that file name
        return r.option("pathGlobFilter", os.path.basename(path)).load(os.path.dirname(path))
    return r.load(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a plain file, asked of the cluster file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.getFileStatus(p).isFile())


def run_available_now(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet",
                      partition_by: list[str] | None = None, mode: str = "append") -> None:
    w = df.writeStream.format(fmt).option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.trigger(availableNow=True).start().awaitTermination()


def run_upsert(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Update-mode aggregation into a sink with a folder per batch; a batch that is replayed overwrites its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_no={batch_id}")
    (df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
     .foreachBatch(write).trigger(availableNow=True).start().awaitTermination())


def read_upserted(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Last version of every key in an upserting sink."""
    df = spark.read.parquet(sink)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_no").desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch_no")


def with_event_time(df: DataFrame, col: str = "ts", out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (the test data holds TIMESTAMP_NTZ)."""
    return df.withColumn(out, F.col(col).cast("timestamp"))


# --- stateful exact limiter (ST4) ----------------------------------------------------

def limiter_state_fn(limit: int, window_us: int):
    """applyInPandasWithState body: per key, accepted (time, n) pairs of the
    last window are the state (at most ``limit`` entries); requests are
    decided in time order; the state expires once the window has passed."""
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        stamps = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(pdfs)).sort_values(["t", "request_id"])
        total = sum(n for _, n in stamps)
        out_ids, out_ok = [], []
        for rid, t, n in zip(rows["request_id"], rows["t"], rows["n"]):
            while stamps and stamps[0][0] < t - window_us:
                total -= stamps.popleft()[1]
            ok = total + n <= limit
            if ok:
                stamps.append((int(t), int(n)))
                total += n
            out_ids.append(rid)
            out_ok.append(ok)
        state.update(([list(s) for s in stamps],))
        if stamps:
            state.setTimeoutTimestamp(int(stamps[-1][0] // 1000 + window_us // 1000 + 1))
        yield pd.DataFrame({"request_id": out_ids, "allowed": out_ok})
    return fn


def stream_rate_limit(requests: DataFrame, key: str, time_col: str, weight: str, limit: int,
                      window_seconds: int) -> DataFrame:
    """ST4: the exact limiter as a stateful streaming operator (state per key
    bounded by ``limit`` stamps, expired by an event-time timeout)."""
    x = (requests.withColumn("_et", F.col(time_col).cast("timestamp"))
         .withWatermark("_et", f"{window_seconds} seconds")
         .select(F.col(key).alias("key"), "_et", "request_id",
                 F.unix_micros("_et").alias("t"), F.col(weight).cast("long").alias("n")))
    return x.groupBy("key").applyInPandasWithState(
        limiter_state_fn(limit, window_seconds * 1_000_000),
        outputStructType="request_id string, allowed boolean",
        stateStructType="stamps array<array<long>>",
        outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)


def dedupe_within_watermark(df: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """ST2 / ST3: drop re-deliveries of the same key seen within ``delay``."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(df: DataFrame, time_col: str, window: str, delay: str, keys: list[Column]) -> DataFrame:
    """ST6: tumbling-window counts per key with a watermark."""
    return (df.withWatermark(time_col, delay)
            .groupBy(F.window(time_col, window).alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("n_events")))
