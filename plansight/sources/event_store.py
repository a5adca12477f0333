"""The event store (S7, S8): appended by a stream, compacted by day, scanned by range.

``live`` is the streaming file sink, partitioned by arrival date: exactly once,
but with a file per task, day and micro-batch. ``days`` holds closed days
rewritten in few files, clustered by (repo, arrival) so that the statistics of
the files prune a repo's range. Compaction overwrites whole partitions
(dynamic overwrite), so a repeated or failed run gives the same days. A
reader takes every compacted day from ``days`` and every other one from
``live``; a bound on the arrival time is turned into a bound on the date,
which prunes partitions before any file is opened.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import jobs as J

DATE = "date"
CLUSTER = ("repo_id", "received_at", "event_id")


class EventStore:
    """A store at ``root``; ``schema`` is that of the events, with the arrival in ``received_at``."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.live, self.days = spark, os.path.join(root, "live"), os.path.join(root, "days")
        self.checkpoint = os.path.join(root, "checkpoint")
        self.schema = f"{schema}, {DATE} date"

    def append(self, events: DataFrame) -> None:
        """Drain a stream of events into the store."""
        J.run_available_now(events.withColumn(DATE, F.to_date("received_at")), self.live, self.checkpoint, partition_by=[DATE])

    def _read(self, path: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(path)

    def _closed(self) -> Column:
        """Whether a day is compacted: a list of dates, one per day of the store, so that it prunes partitions."""
        return F.col(DATE).isin([r[DATE] for r in self._read(self.days).select(DATE).distinct().collect()])

    def compact(self, before: Column, rows_per_file: int = 4_000_000) -> None:
        """Rewrite the days before the date ``before`` that have live files and are not compacted yet.

        A row that arrives for a compacted day later stays in ``live``, unseen, until ``recompact`` takes the day again."""
        self._write(self._read(self.live).where((F.col(DATE) < before) & ~self._closed()), rows_per_file)

    def recompact(self, first: Column, last: Column, rows_per_file: int = 4_000_000) -> None:
        """Rewrite some days from their live files, which are never changed."""
        self._write(self._read(self.live).where(F.col(DATE).between(first, last)), rows_per_file)

    def _write(self, rows: DataFrame, rows_per_file: int) -> None:
        (rows.repartitionByRange(DATE, *CLUSTER).sortWithinPartitions(DATE, *CLUSTER)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
         .partitionBy(DATE).parquet(self.days))

    def scan(self, since: Column | None = None, repos: list[int] | None = None) -> DataFrame:
        """Events that arrived at ``since`` or later, of some repos or of all.

        ``since`` may be a scalar subquery: partitions are pruned by its date and files by their statistics."""
        parts = []
        for part in (self._read(self.days), self._read(self.live).where(~self._closed())):
            if since is not None:
                part = part.where((F.col(DATE) >= F.to_date(since)) & (F.col("received_at") >= since))
            if repos is not None:
                part = part.where(F.col("repo_id").isin(repos))
            parts.append(part)
        return parts[0].unionByName(parts[1])

    def windows(self, since: DataFrame) -> DataFrame:
        """Events of each repo since its own time, ``since(repo_id, since)``: a row per repo.

        The dates that the windows span are broadcast and prune the partitions when the scan starts (dynamic pruning)."""
        w = since.select("repo_id", F.col("since").alias("_since"))
        newest = F.greatest(*[self._read(p).agg(F.coalesce(F.max(DATE), F.lit("1970-01-01").cast("date"))).scalar()
                              for p in (self.days, self.live)])
        spans = w.where(F.to_date("_since") <= newest).select(
            F.col("repo_id").alias("_repo"), "_since", F.explode(F.sequence(F.to_date("_since"), newest)).alias("_date"))
        e = self.scan()
        return e.join(F.broadcast(spans), (e["repo_id"] == F.col("_repo")) & (e[DATE] == F.col("_date"))
                      & (e["received_at"] >= F.col("_since"))).drop("_repo", "_since", "_date")

    def files(self) -> DataFrame:
        """Per date and part of the store: its data files."""
        def count(path: str, part: str) -> DataFrame:
            rows = self._read(path)
            if not rows.inputFiles():
                return self.spark.createDataFrame([], f"part string, {DATE} date, n_files long, n_rows long")
            return rows.groupBy(F.lit(part).alias("part"), DATE).agg(
                F.count_distinct("_metadata.file_path").alias("n_files"), F.count(F.lit(1)).alias("n_rows"))
        return count(self.days, "days").unionByName(count(self.live, "live"))
