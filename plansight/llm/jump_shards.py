"""Sharding by jump consistent hashing (no ring table).

A row's shard depends on its key and the number of shards only. When a shard
is appended, a key either stays or moves to the new shard; the expected share
that moves is 1 / (number of shards + 1).

Slots number the rows of a shard without gaps. One window per shard would
hold a sixteenth of all rows in one task, so a shard is cut into cells by a
hash of the row; rows are numbered inside a cell and the counts of the cells
before it are added.

Defined results: a null key hashes as the text ``null`` would (all null keys
share a shard, but not a cell); a null text has size 1 and crc 0; repeated
rows are separate rows of one shard with different slots; an empty table
gives an empty table; other columns are left alone by :func:`assign`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

ROWS_PER_CELL = 50_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into ``shards`` buckets, all keys at once."""
    key = keys.astype(np.uint64)
    shard, nxt = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        nxt[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[nxt[live] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column (any type that has a text form)."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def hashed(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy(np.int64).view(np.uint64), shards))

    return hashed(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16,
           shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Add the shard and a gapless slot inside the shard to every row."""
    cell, before, i = (free_name(docs.columns, n) for n in ("cell", "before", "i"))
    n = docs.count()
    cells = max(1, -(-n // (ROWS_PER_CELL * shards)))
    spread = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    placed = (docs.withColumn(shard_col, shard_of(F.col(key), shards))
              .withColumn(cell, F.pmod(F.xxhash64(F.col(key), spread), F.lit(cells)).cast("int")))
    totals = placed.groupBy(shard_col, cell).agg(F.count(F.lit(1)).alias(before))
    offsets = totals.withColumn(before, F.coalesce(F.sum(before).over(
        Window.partitionBy(shard_col).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn(i, F.row_number().over(Window.partitionBy(shard_col, cell).orderBy(F.col(key), spread)))
    return (numbered.join(offsets, [shard_col, cell])
            .withColumn(slot_col, (F.col(before) + F.col(i) - 1).cast("long"))
            .select(*docs.columns, shard_col, slot_col))


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: size, crc, shard, slot, and the shard it would have with one more shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    cells = assign(rows.withColumn("text", F.col("text_crc32").cast("string")), shards=shards)
    return cells.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                        shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
