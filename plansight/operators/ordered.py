"""Skew-safe ordered operators: carry a value forward/backward, prefix sums.

A window ``PARTITION BY entity ORDER BY t`` sends a whole entity to one task,
and one user or repo may hold a third of all rows. These operators partition
by (entity, time bucket) instead:

1. inside a bucket an ordinary window does the work;
2. a bucket table - one row per (entity, bucket), tiny next to the facts -
   carries each bucket's summary (last value / first value / total) to the
   later (or earlier) buckets with a second window;
3. the two are combined, which gives exactly the whole-entity answer.

A hot entity is thereby spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_SECONDS = 86400


def bucket_of(time_col: str, bucket_seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))


def _order_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def carry(df: DataFrame, entity: list[str], order: list[str], value: str, out: str,
          direction: str = "forward", inclusive: bool = True,
          time_col: str | None = None, bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Fill ``out`` with the nearest non-null ``value`` of the same entity.

    forward:  the last non-null value at or before the row (``inclusive``) or
              strictly before it.
    backward: the first non-null value at or after the row (``inclusive``) or
              strictly after it.
    ``order`` must make rows unique within an entity; its first column (or
    ``time_col``) is the time that defines buckets.
    """
    time_col = time_col or order[0]
    b = "_bkt"
    base = df.withColumn(b, bucket_of(time_col, bucket_seconds))
    fwd = direction == "forward"
    okey = [F.col(c).asc() if fwd else F.col(c).desc() for c in order]
    frame_end = Window.currentRow if inclusive else -1
    w_in = Window.partitionBy(*entity, b).orderBy(*okey).rowsBetween(Window.unboundedPreceding, frame_end)
    x = base.withColumn("_within", F.last(F.col(value), ignorenulls=True).over(w_in))

    ordk = F.when(F.col(value).isNotNull(), _order_struct(order))
    summary = F.max_by(F.col(value), ordk) if fwd else F.min_by(F.col(value), ordk)
    bt = base.groupBy(*entity, b).agg(summary.alias("_bval"))
    w_b = (Window.partitionBy(*entity).orderBy(F.col(b).asc() if fwd else F.col(b).desc())
           .rowsBetween(Window.unboundedPreceding, -1))
    bt = bt.withColumn("_across", F.last("_bval", ignorenulls=True).over(w_b)).drop("_bval")
    return (x.join(bt, [*entity, b], "left")
            .withColumn(out, F.coalesce(F.col("_within"), F.col("_across")))
            .drop("_within", "_across", b))


def next_time_after(probes: DataFrame, candidates: DataFrame, entity: list[str], time_col: str,
                    out: str, bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """As-of forward lookup: for each probe row, the smallest candidate time
    strictly greater than the probe's time within the same entity."""
    p = probes.withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast(probes.schema[time_col].dataType))
    c = (candidates.select(*entity, time_col).withColumn("_kind", F.lit(0))
         .withColumn("_v", F.col(time_col)))
    for col in p.columns:
        if col not in c.columns:
            c = c.withColumn(col, F.lit(None).cast(p.schema[col].dataType))
    u = p.unionByName(c.select(*p.columns))
    # At equal time the candidate sorts first, so "strictly after" excludes
    # it. Tied candidates carry the same value, so no further tiebreak is
    # needed for a deterministic result.
    r = carry(u, entity, [time_col, "_kind"], "_v", out, direction="backward",
              inclusive=False, time_col=time_col, bucket_seconds=bucket_seconds)
    return r.where(F.col("_kind") == 1).drop("_kind", "_v")


def prefix_sum(df: DataFrame, entity: list[str], order: list[str], value: Column, out: str,
               time_col: str | None = None, bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """Inclusive running sum of ``value`` per entity in ``order``."""
    time_col = time_col or order[0]
    b = "_bkt"
    base = df.withColumn(b, bucket_of(time_col, bucket_seconds)).withColumn("_val", value)
    w_in = Window.partitionBy(*entity, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = base.withColumn("_within", F.sum("_val").over(w_in))
    bt = base.groupBy(*entity, b).agg(F.sum("_val").alias("_tot"))
    w_b = Window.partitionBy(*entity).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("_before", F.coalesce(F.sum("_tot").over(w_b), F.lit(0))).drop("_tot")
    return (x.join(bt, [*entity, b], "left")
            .withColumn(out, F.col("_within") + F.col("_before"))
            .drop("_within", "_before", "_val", b))


def top_n(df: DataFrame, keys: list[str], order: list, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per group in ``order``. Spark cuts each input partition
    to its own first ``n`` per group before the shuffle (WindowGroupLimit), so
    a group is never sent whole to one task."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) \
        .where(F.col(out) <= n)
