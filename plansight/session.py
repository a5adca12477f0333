"""SparkSession defaults and the shared checkpoint location.

The library never creates a session behind the caller's back in production:
operators receive DataFrames. ``get_session`` exists for tests, the bench and
the driver entry point, and only fills in settings that are still unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every plan in this package assumes. AQE re-plans joins and
# coalesces/splits shuffle partitions at runtime; skew-join splits a hot key
# across tasks.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "plansight") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator owns nothing here: the folder comes from the
    session, and a session without one is an error. Only a local master (one
    machine, as in tests) gets a scratch folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="plansight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables/state."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df):
    """Cut the lineage of an intermediate result: a reliable checkpoint in
    the shared checkpoint folder (survives lost executors; never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a batch that goes to a Python worker; both sides hold a batch whole, outside the heap.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def setting(spark, key: str, value: str):
    """A setting for the queries that run inside; the session's own comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def without_shuffles(spark):
    """Queries that run inside drop their shuffle files when they end, not when the driver's memory is cleaned up: for
    writes whose table is all that is read later."""
    return setting(spark, CLEAN_UP, "true")


def small_batches(spark, size: int):
    """Batches of at most about ``size`` bytes, however long the rows are."""
    return setting(spark, BATCH_BYTES, str(size))


def stored(df):
    """Cut the lineage like ``materialize``, as Parquet in the shared folder: later reads take only the columns they use.

    Its joins are merge joins, unless the other side is a broadcast dimension: Spark would guess its rows by the size of
    the files, and repetitive code shrinks there so far that a table of millions of rows would go through the driver."""
    path = scratch_path(df.sparkSession, f"stored-{uuid.uuid4().hex}")
    with without_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def spread(spark) -> int:
    """Partitions for work that is heavy for its bytes, where sizes alone would leave cores idle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
