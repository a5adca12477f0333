"""Mixing sources to target weights by Sainte-Lague apportionment.

1. ``targets``: weights share the budget; a source stops at ``max_epochs``
   times its size and the excess is shared again by weight.
2. ``quotas``: the budget is a house of equal-token blocks. Seats go to the
   highest quotients target / (1, 3, 5, ...). The method is house monotone,
   so the seats of the first m output shards grow with m and their
   differences are integer quotas per source and output shard.
3. ``place``: the documents of a source are laid end to end in a seeded order
   and cut in blocks of equal tokens. A source's seat number r takes block
   ``permutation(r mod blocks)``: every block once before any is repeated.

The running position inside a source is a two-level prefix sum: a source is
split in cells of about ``CELL_TOKENS`` tokens by a seeded hash, so a source
that holds a third of all rows is spread over many tasks. Only the table of
sources (one row each, at most ``MAX_SOURCES``, checked) reaches the driver.

Defined results: a null text has size 0; documents of size 0 take nothing; a
null source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives an empty table; other columns are kept by
:func:`place` and must not be named like the columns it adds.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import SPACE, run_folder, written
from .exchange import rows

CELL_TOKENS = 2_000_000
MAX_SOURCES = 100_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A Mersenne prime: the multiplier of the block permutation, prime to every number of blocks below it.
PRIME = (1 << 61) - 1
SHARES = pa.schema([("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("seats", pa.int64()),
                    ("blocks", pa.int64()), ("cells", pa.int32()), ("mult", pa.int64()), ("shift", pa.int64())])
SHARES_SQL = "source string, source_size long, target double, seats long, blocks long, cells int, mult long, shift long"


@dataclass(frozen=True)
class Share:
    """What the mix takes of one source."""
    source: str | None
    size: int
    weight: float
    target: float = 0.0
    seats: int = 0
    blocks: int = 0
    quotas: tuple[int, ...] = ()


def n_words(text: Column) -> Column:
    """Number of words; a null text has none."""
    gaps = F.regexp_replace(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+", " ")
    return F.coalesce(F.when(gaps == "", 0).otherwise(
        F.char_length(gaps) - F.char_length(F.translate(gaps, " ", "")) + 1), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, max_epochs: float) -> list[float]:
    """Share ``budget`` by weight; who would pass ``max_epochs`` times its size stops there and the rest is reshared."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while open_:
        total = sum(weights[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if left * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by the highest quotients votes / (2 a + 1); ties go to the earlier entry.

    A divisor found by bisection hands out all but the last few seats at once,
    so the work does not grow with the number of seats."""
    live = [i for i, v in enumerate(votes) if v > 0]
    if not live or seats <= 0:
        return [0] * len(votes)
    at = lambda d: [int(votes[i] / d / 2 + 0.5) for i in live]  # noqa: E731  quotients of at least d
    low, high = 0.0, 2 * max(votes) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        low, high = (mid, high) if sum(at(mid)) > seats else (low, mid)
    got = at(high)
    heap = [(-votes[i] / (2 * a + 1), k) for k, (i, a) in enumerate(zip(live, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-votes[live[k]] / (2 * got[k] + 1), k))
    out = [0] * len(votes)
    for i, a in zip(live, got, strict=True):
        out[i] = a
    return out


def quotas(sources: list[tuple[str | None, int]], weights: list[float], share: float = 1.5, max_epochs: int = 2,
           block: int = 64, shards: int = 16) -> list[Share]:
    """Integer block quotas per source and output shard. ``sources``: (name, tokens), in order; weights repeat."""
    ws = [float(weights[i % len(weights)]) for i in range(len(sources))]
    goal = targets([n for _, n in sources], ws, share * sum(n for _, n in sources), max_epochs)
    blocks = [-(-n // block) for _, n in sources]
    house = round(sum(goal) / block)
    upto = [[min(s, max_epochs * b) for s, b in zip(sainte_lague(goal, house * k // shards), blocks, strict=True)]
            for k in range(shards + 1)]
    return [Share(name, n, ws[i], goal[i], upto[shards][i], blocks[i],
                  tuple(upto[k + 1][i] - upto[k][i] for k in range(shards))) for i, (name, n) in enumerate(sources)]


def source_sizes(docs: DataFrame) -> list[tuple[str | None, int]]:
    """(source, tokens) in order of code points, null last. ``docs`` has columns source and size."""
    rows = docs.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    return sorted(((r["source"], r["size"] or 0) for r in rows), key=lambda r: (r[0] is None, r[0] or ""))


def shares_table(spark: SparkSession, numbers: list[tuple]) -> DataFrame:
    """The numbers of all sources. From Arrow, as a list of rows would start Python workers that stay beside the others."""
    return spark.createDataFrame(rows(SHARES, numbers), SHARES_SQL)


def place(docs: DataFrame, shares: list[Share], block: int = 64, seed: int = 7) -> DataFrame:
    """Add ``start`` (first token's place in its source), the share's numbers and ``taken`` to every document.

    ``docs`` has columns doc_id, source, size (tokens) and any others."""
    spark = docs.sparkSession
    plan = shares_table(spark, [
        (s.source, s.size, s.target, s.seats, s.blocks, max(1, -(-s.size // CELL_TOKENS)), PRIME % max(1, s.blocks),
         zlib.crc32(f"{seed}/{s.source}".encode()) % max(1, s.blocks)) for s in shares])
    # one row per source, at most MAX_SOURCES (checked): small enough to broadcast
    known = docs.withColumnRenamed("source", "source_").join(
        F.broadcast(plan), F.col("source_").eqNullSafe(F.col("source"))).drop("source").withColumnRenamed("source_", "source")
    celled = known.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("cells")))
    order = [F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("doc_id"), F.col("size")]
    inside = celled.withColumn("start", F.sum("size").over(
        Window.partitionBy("source", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (celled.groupBy("source", "cell").agg(F.sum("size").alias("n"))
               .select(F.col("source").alias("s_"), F.col("cell").alias("c_"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    placed = inside.join(offsets, F.col("source").eqNullSafe(F.col("s_")) & (F.col("cell") == F.col("c_")))
    return (placed.withColumn("start", F.col("start") + F.col("offset")).drop("s_", "c_", "offset", "cell", "cells")
            .withColumn("taken", F.aggregate(passes(block), F.lit(0).cast("long"), lambda a, x: a + x["n"])))


def passes(block: int) -> Column:
    """The document's pieces: array of (pass, from, n): its tokens from .. from + n - 1, taken in that pass.

    A piece is what one block holds of the document; the pass counts how often the source was used up before."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    bs = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def piece(b: Column) -> Column:
        lo = F.greatest(b * block, F.col("start"))
        hi = F.least((b + 1) * block, F.col("start") + F.col("size"))
        seat = F.pmod(b * F.col("mult") + F.col("shift"), F.col("blocks"))  # the first seat that takes this block
        times = F.when(seat < F.col("seats"), F.floor((F.col("seats") - 1 - seat) / F.col("blocks")) + 1).otherwise(0)
        return F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(times, F.lit(1).cast("long"))), lambda k: F.struct(
            (k - 1).alias("pass"), (lo - F.col("start")).alias("from"),
            F.when(times > 0, hi - lo).otherwise(F.lit(0).cast("long")).alias("n")))

    return F.flatten(F.transform(bs, piece))


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
               block: int = 64, seed: int = 7) -> DataFrame:
    """One row per document: size, its source's size and target, and the words of it that the mix takes."""
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")),
                    run_folder(spark, "mix"))  # small; the texts are read once
    shares = quotas(source_sizes(sized), list(weights), share, max_epochs, block)
    return place(sized, shares, block, seed).select(
        "doc_id", "size", F.col("source_size"), F.col("target"), F.col("taken").cast("long").alias("taken"))


@F.pandas_udf(StringType())
def _cut(text: pd.Series, froms: pd.Series, ns: pd.Series) -> pd.Series:
    """The words from .. from + n - 1 of each text, white space between neighbouring words unchanged."""
    out = []
    for t, starts, lengths in zip(text, froms, ns, strict=True):
        if t is None:
            out.append(None)
            continue
        spans = [m.span() for m in WORD.finditer(t)]
        runs: list[list[int]] = []
        for a, n in sorted(zip(starts, lengths, strict=True)):
            if runs and runs[-1][1] == a:
                runs[-1][1] = a + n
            elif n:
                runs.append([a, a + n])
        out.append("\n".join(t[spans[a][0]:spans[b - 1][1]] for a, b in runs))
    return pd.Series(out, dtype=object)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2,
                    block: int = 64, seed: int = 7) -> DataFrame:
    """The mix as documents: one row per document and pass that takes words of it, with the columns of ``docs``;
    the text is what the taken blocks hold (the whole text if all of it is taken)."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct("*").alias("row"))
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("size")), run_folder(spark, "mix"))
    shares = quotas(source_sizes(sizes), list(weights), share, max_epochs, block)
    placed = place(sized, shares, block, seed).select("row", "size", passes(block).alias("pieces"))
    each = placed.select("row", "size", "pieces", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("k"))
    own = each.select("row", "size", F.filter("pieces", lambda p: (p["pass"] == F.col("k")) & (p["n"] > 0)).alias("mine"))
    got = own.withColumn("n", F.aggregate("mine", F.lit(0).cast("long"), lambda a, p: a + p["n"])).where("n > 0")
    whole = F.col("n") == F.col("size")
    text = F.when(whole, F.col("row.text")).otherwise(
        _cut(F.when(~whole, F.col("row.text")), F.col("mine.from"), F.col("mine.n")))
    return got.withColumn("text_", text).select(
        *[(F.col("text_") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
