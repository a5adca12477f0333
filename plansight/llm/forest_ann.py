"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives a vector a hash string of ``BITS`` signs of random
projections and keeps the strings in a sorted array. A query descends each
tree to its longest prefix match by binary search; from the deepest match all
trees ascend together, one level at a time, until the prefixes hold ``budget``
entries. The candidates are then ranked by exact double-precision cosine.

Distribution: the sorted arrays are kept per slab of at most ``SLAB`` vectors
of a task's own rows (no shuffle, no hot bucket: copies of one vector lie in
whichever slabs their rows are). Entry counts per level add up over slabs, so
the stop level of a query is that of one large forest. Queries travel in
blocks of at most ``QUERIES``; a block meets all slabs, is stopped by the
summed counts, and returns ``k`` rows per slab and query.

The budget is fitted on a bounded sample (``sample`` queries of the block):
the smallest one that reaches the share ``recall`` of their true neighbours.

Defined results: vectors that are null, of zero length, empty, or hold null or
non-finite components take no part; ties go to the smaller id; with fewer
than ``k`` candidates all are returned, so a small table is searched whole;
vectors of another length than the query are no candidates; repeated rows are
separate candidates; components of any finite size give their cosine (vectors are
scaled by powers of two first); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, TREES = 24, 40
SLAB, QUERIES = 16_384, 4_096


def usable(v: Column) -> Column:
    """Not null, all components finite, not all zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(d, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Every row times a power of two, its largest component then between 1/2 and 1: squares neither overflow nor
    all vanish. Signs and cosines stay the same to the last bit where they were right before."""
    _, e = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    return np.ldexp(x, -e)


def planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, TREES * BITS))


def hash_strings(x: np.ndarray, seed: int) -> np.ndarray:
    """TREES x rows: the hash strings as integers of BITS bits, first sign highest."""
    signs = (x @ planes(x.shape[1], seed) > 0).reshape(len(x), TREES, BITS)
    return (signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).T


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of every row with one vector; equal rows give equal values wherever they stand."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


class Slab:
    """The forest over one slab: per tree the sorted strings and their rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int):
        self.ids, self.x, self.keys = ids, x, hash_strings(x, seed)
        self.order = np.argsort(self.keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.keys, self.order, axis=1)

    def spans(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Per tree and query: where the strings start and end that share the first ``level`` signs."""
        shift = BITS - level
        low = (strings >> shift) << shift
        at = [(np.searchsorted(s, q), np.searchsorted(s, q + (1 << shift))) for s, q in zip(self.sorted, low, strict=True)]
        return np.stack([a for a, _ in at]), np.stack([b for _, b in at])

    def counts(self, strings: np.ndarray) -> np.ndarray:
        """Queries x levels: entries of all trees under the query's prefix of 0 .. BITS signs."""
        out = np.empty((strings.shape[1], BITS + 1), np.int64)
        for level in range(BITS + 1):
            a, b = self.spans(strings, level)
            out[:, level] = (b - a).sum(axis=0)
        return out

    def candidates(self, strings: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Per query the rows that share at least ``stop`` signs with it in some tree."""
        for level in np.unique(stop):
            which = np.flatnonzero(stop == level)
            a, b = self.spans(strings[:, which], int(level))
            for j, q in enumerate(which):
                hit = np.zeros(len(self.ids), bool)
                for t in range(TREES):
                    hit[self.order[t, a[t, j]:b[t, j]]] = True
                yield int(q), np.flatnonzero(hit)

    def depth(self, string: np.ndarray, row: int) -> int:
        """Signs that a row shares with a query's strings in its best tree."""
        return int(BITS - min(int(d).bit_length() for d in string ^ self.keys[:, row]))


def slabs(batches: Iterator[pd.DataFrame], dim: int, seed: int) -> Iterator[Slab]:
    """Cut a task's rows in slabs; rows of another dimension are left out."""
    ids: list[int] = []
    rows: list[np.ndarray] = []
    for pdf in batches:
        for i, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
            if len(v) == dim:
                ids.append(i)
                rows.append(v)
                if len(ids) == SLAB:
                    yield Slab(np.array(ids), scaled(np.array(rows, np.float64)), seed)
                    ids, rows = [], []
    if ids:
        yield Slab(np.array(ids), scaled(np.array(rows, np.float64)), seed)


def best(slab: Slab, rows: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, float, int]]:
    """The k nearest of the given rows: (row, cosine, id)."""
    rows = rows[slab.ids[rows] != own]
    if not len(rows):
        return []
    cos = cosines(slab.x[rows], query)
    top = np.lexsort((slab.ids[rows], -cos))[:k]
    return [(int(rows[i]), float(cos[i]), int(slab.ids[rows[i]])) for i in top]


def search_block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, recall: float, sample: int,
                 seed: int) -> DataFrame:
    """Search one block of queries (same dimension) against all rows."""
    spark, dim = vectors.sparkSession, q.shape[1]
    probe = np.random.default_rng(seed).permutation(len(ids))[:sample]
    sent = spark.sparkContext.broadcast((ids, q, hash_strings(q, seed), probe))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_, q_, strings, tried = sent.value
        total = np.zeros((len(ids_), BITS + 1), np.int64)
        near: dict[int, list[dict]] = {int(i): [] for i in tried}
        for slab in slabs(batches, dim, seed):
            total += slab.counts(strings)
            for i, kept in near.items():
                kept += [{"far": -c, "vec_id": v, "depth": slab.depth(strings[:, i], row)}
                         for row, c, v in best(slab, np.arange(len(slab.ids)), q_[i], ids_[i], k)]
                kept.sort(key=lambda r: (r["far"], r["vec_id"]))
                del kept[k:]
        if total.any():
            yield pd.DataFrame({"query": np.arange(len(ids_)), "counts": list(total),
                                "near": [near.get(i, []) for i in range(len(ids_))]})

    seen = vectors.mapInPandas(
        count, "query int, counts array<long>, near array<struct<far:double,vec_id:long,depth:int>>")
    # one row per query of the block, at most QUERIES; a task adds at most k neighbours to a list
    rows = seen.groupBy("query").agg(F.array(*[F.sum(F.col("counts")[i]) for i in range(BITS + 1)]).alias("counts"),
                                     F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")).collect()
    totals = np.zeros((len(ids), BITS + 1), np.int64)
    for r in rows:
        totals[r["query"]] = r["counts"]
    # entries that a sampled query must ascend to for each of its true neighbours
    need = [totals[r["query"], x["depth"]] for r in rows for x in r["near"]]
    budget = max(k * TREES, int(np.quantile(need, recall, method="higher")) if need else 0)
    deep = totals >= budget
    stop = np.where(deep.any(axis=1), BITS - np.argmax(deep[:, ::-1], axis=1), 0)
    stops = spark.sparkContext.broadcast(stop)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_, q_, strings, _ = sent.value
        for slab in slabs(batches, dim, seed):
            rows = [(int(ids_[i]), v, c) for i, near in slab.candidates(strings, stops.value)
                    for _, c, v in best(slab, near, q_[i], ids_[i], k)]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return vectors.mapInPandas(find, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = 0.98, sample: int = 48,
           seed: int = 5) -> DataFrame:
    """The k nearest found of every query row, nearest first: query_id, rank, vec_id, score.

    ``vectors`` has columns vec_id and embedding; ``is_query`` picks the query rows."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    queries = rows.where(is_query)
    found: DataFrame | None = None
    for dim, n in sorted((r["d"], r["n"]) for r in queries.groupBy(F.size("embedding").alias("d")).agg(
            F.count(F.lit(1)).alias("n")).collect()):
        parts = -(-n * 5 // (QUERIES * 4))  # blocks by hash are a little uneven
        for b in range(parts):
            block = queries.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b)).collect()
            if not block:
                continue
            block.sort(key=lambda r: r["vec_id"])
            part = search_block(rows, np.array([r["vec_id"] for r in block]), scaled(np.array([r["embedding"] for r in block], np.float64)),
                                k, recall, sample, seed)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
