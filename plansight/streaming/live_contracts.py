"""ST7: unplanned and contract-violating events as they arrive.

One pass over every micro-batch gives both outputs: the plan's names and the
property rules are broadcast (they are bounded by the plan), an event carries
the list of what is wrong with it, and the exploded list is written in one
job, partitioned by kind. The folder of a batch is overwritten when the batch
is replayed, so a restart neither loses nor repeats a finding. Arrivals and
late arrivals are counted on the way (``observe``) and written beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.util import at
from ..operators import contracts as C

FINDINGS = ("event_id long, repo_id long, event_name string, prop string, declared_type string, actual_type string, "
            "violation string")
ARRIVALS = "n_events long, n_late long"


@dataclass(frozen=True)
class Contract:
    """The plan as live rules: names per repo, and the property rules of every (lower-cased) event name."""
    names: DataFrame
    rules: DataFrame
    properties: list[str]

    @staticmethod
    def of(plan: DataFrame, plan_props: DataFrame) -> Contract:
        rules = plan_props.groupBy(F.lower("event_name").alias("_k")).agg(
            F.collect_list(F.struct("prop", "type", "required", "todo")).alias("_rules"))
        names = plan.select(F.col("repo_id").alias("_repo"), F.lower("name").alias("_name")).distinct()
        return Contract(names.withColumn("_planned", F.lit(True)), rules, C.property_names(plan_props))


def findings(events: DataFrame, contract: Contract) -> DataFrame:
    """A row per event that the plan of its repo lacks (kind ``unplanned``) and per broken property rule (``violation``).

    The rules are those of J9, whichever repo sends the event."""
    e = events.select("event_id", F.col("repo_id").cast("long").alias("repo_id"), "event_name", "properties").withColumns({
        "_k": F.lower("event_name"),
        "_keys": F.coalesce(F.json_object_keys("properties"), F.array().cast("array<string>")),
        "_types": C.property_types(contract.properties)})
    e = e.join(F.broadcast(contract.names), (e["repo_id"] == F.col("_repo")) & (e["event_name"] == F.col("_name")), "left") \
        .join(F.broadcast(contract.rules), "_k", "left")

    def broken(rule):
        present = F.array_contains("_keys", rule["prop"])
        actual = C.json_type_of(at("_types", rule["prop"]))
        what = (F.when(rule["required"] & ~rule["todo"] & ~present, "missing")
                .when(present & (actual != C.declared_json_type(rule["type"])), "type_mismatch"))
        return F.struct(F.lit("violation").alias("kind"), rule["prop"].alias("prop"), rule["type"].alias("declared_type"),
                        F.when(present, actual).alias("actual_type"), what.alias("violation"))

    none = F.lit(None).cast("string")
    unplanned = F.array(F.struct(F.lit("unplanned").alias("kind"), none.alias("prop"), none.alias("declared_type"),
                                 none.alias("actual_type"), none.alias("violation")))
    broken_rules = F.filter(F.transform(F.coalesce("_rules", F.array().cast("array<struct<prop:string,type:string,required:boolean,todo:boolean>>")),
                                        broken), lambda x: x["violation"].isNotNull())
    wrong = F.when(F.col("_planned").isNull(), F.concat(unplanned, broken_rules)).otherwise(broken_rules)
    return e.select("event_id", "repo_id", "event_name", F.inline(wrong))


def write_batch(contract: Contract, sink: str, lateness: str):
    """The ``foreachBatch`` body: findings and arrival counts of one micro-batch, each in a folder of the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        seen = Observation()
        late = F.col("received_at") - F.col("event_ts") > F.expr(f"INTERVAL {lateness}")
        rows = batch.observe(seen, F.count(F.lit(1)).alias("n_events"), F.count_if(late).alias("n_late"))
        findings(rows, contract).write.mode("overwrite").partitionBy("kind").parquet(f"{sink}/findings/batch_no={batch_id}")
        counts = seen.get
        batch.sparkSession.createDataFrame([(counts["n_events"], counts["n_late"])], ARRIVALS).write.mode("overwrite").parquet(
            f"{sink}/arrivals/batch_no={batch_id}")

    return write


def watch(events: DataFrame, plan: DataFrame, plan_props: DataFrame, sink: str, checkpoint: str, lateness: str = "1 HOUR") -> None:
    """Drain a stream of canonical events (``received_at`` is the arrival, ``event_ts`` the client's time).

    ``lateness`` is the delay beyond which an arrival counts as late; late events are checked as all others."""
    (events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch(Contract.of(plan, plan_props), sink, lateness))
     .trigger(availableNow=True).start().awaitTermination())


def _folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of batches, empty if no batch was written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def read_findings(spark: SparkSession, sink: str) -> DataFrame:
    return _folder(spark, f"{sink}/findings", FINDINGS + ", batch_no long, kind string")


def read_arrivals(spark: SparkSession, sink: str) -> DataFrame:
    return _folder(spark, f"{sink}/arrivals", ARRIVALS + ", batch_no long")
