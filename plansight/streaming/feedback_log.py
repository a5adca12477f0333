"""ST11: review feedback as an append-only log with compacted versions, merged on read.

The reference rewrites one document per repo, so of two writers one can lose.
Here a writer only appends: its facts are a batch folder of its own, written
once (a batch that is run again overwrites itself). The state of a (repo,
event) is an aggregate that merges (two counts and the newest PR), so a
compacted version holds the state of the batches it names, and a reader merges
the newest version with the batches it does not name. A version is one folder,
valid when its job has committed; compaction never touches what readers read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "repo string, event_name string, verdict string, pr int, path string, seq long"
STATE = "repo string, event_name string, n_accepted long, n_rejected long, last_seq long, last_pr int, batch string"


class FeedbackLog:
    """A log under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _committed(self, part: str) -> list[str]:
        """Names of the committed folders of a part, without their ``id=``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}/id=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(str(s.getPath().getParent().getName()).split("=", 1)[1] for s in found)

    def append(self, facts: DataFrame, batch: str) -> None:
        """Add a batch of facts under a name of the writer's own (letters, digits, - and _)."""
        facts.select(*[c.split()[0] for c in FACTS.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/log/id={batch}")

    def follow(self, facts: DataFrame, checkpoint: str, writer: str) -> None:
        """Append a stream of facts; each micro-batch is a batch ``writer-N``."""
        (facts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda b, n: self.append(b, f"{writer}-{n}"))
         .trigger(availableNow=True).start().awaitTermination())

    def _facts(self, batches: list[str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], FACTS)
        return self.spark.read.schema(FACTS).parquet(*[f"{self.root}/log/id={b}" for b in batches])

    @staticmethod
    def _state_of(facts: DataFrame) -> DataFrame:
        return facts.groupBy("repo", F.lower("event_name").alias("event_name")).agg(
            F.count_if(F.col("verdict") == "accepted").alias("n_accepted"), F.count_if(F.col("verdict") == "rejected").alias("n_rejected"),
            F.max("seq").alias("last_seq"), F.max_by("pr", "seq").alias("last_pr"))

    def _version(self) -> tuple[int, DataFrame]:
        versions = [int(v) for v in self._committed("versions")]
        if not versions:
            return 0, self.spark.createDataFrame([], STATE)
        return max(versions), self.spark.read.schema(STATE).parquet(f"{self.root}/versions/id={max(versions)}")

    def _merged(self) -> tuple[int, list[str], DataFrame]:
        """The newest version, the batches of the log, and the state of all of them."""
        number, version = self._version()
        batches = self._committed("log")
        done = {r["batch"] for r in version.where("batch IS NOT NULL").select("batch").collect()}  # a name per batch
        new = self._state_of(self._facts([b for b in batches if b not in done]))
        state = version.where("batch IS NULL").drop("batch").unionByName(new)
        return number, batches, state.groupBy("repo", "event_name").agg(
            F.sum("n_accepted").alias("n_accepted"), F.sum("n_rejected").alias("n_rejected"),
            F.max("last_seq").alias("last_seq"), F.max_by("last_pr", "last_seq").alias("last_pr"))

    def compact(self) -> int:
        """Write the next version: the merged state and the names of the batches in it. Its number."""
        number, batches, state = self._merged()
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        whole = state.withColumn("batch", F.lit(None).cast("string")).unionByName(names, allowMissingColumns=True)
        # a second compactor that chose the same number fails here and changes nothing
        whole.write.mode("errorifexists").parquet(f"{self.root}/versions/id={number + 1}")
        return number + 1

    def state(self) -> DataFrame:
        """(repo, event_name, n_accepted, n_rejected, last_pr) over all committed batches."""
        return self._merged()[2].drop("last_seq")
