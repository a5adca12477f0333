"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, every window of a document with as many words as
the item (the whole document, if it is shorter) is a possible copy.

1. A window is fingerprinted only if at least the share t of its shingles are
   shingles of some item. With less in common with all items together, no
   single one can reach similarity t, so this bound loses nothing.
2. SimHash: the signs of the weighted sums of the shingles' hash bits, 64 bits
   per window.
3. Multi-index: fingerprints are cut in ``BLOCKS`` bytes. If two differ in at
   most ``RADIUS`` bits, some byte differs in at most RADIUS // BLOCKS bits, so
   a table from byte value to the items within that distance finds all items
   within the radius; the full distance is then tested.
4. Candidates are verified by the exact weighted Jaccard similarity of the
   shingle counts (sum of minima / sum of maxima).

The benchmark travels to the executors in parts of at most ``ITEMS`` items and
``ITEM_WORDS`` words, so what is broadcast does not grow with its size; the
documents are scanned once per part, without any shuffle of texts.

Words are runs of anything but white space, A-Z lower-cased, without ASCII
punctuation at their ends; a shingle is ``n`` words; a text with fewer words
has its whole sequence as one shingle. Defined results: null or empty texts
and items have no words and match nothing; repeated documents and items are
matched one by one; empty tables give an empty table; whole texts are read.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS, RADIUS = 8, 23
ITEMS, ITEM_WORDS = 2_000, 400_000
STRIP = string.punctuation.encode()
FOUND = "array<struct<item_id:long,start:int,words:int,similarity:double>>"
NAMES = ("item_id", "start", "words", "similarity")


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return [w for w in (x.strip(STRIP) for x in raw.lower().split()) if w]


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hash of the shingle at each place; one for the whole sequence if it has fewer than n words."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    width, out = min(n, len(words)), np.zeros(max(1, len(words) - n + 1), np.uint64)
    for i in range(width):
        out = (out ^ own[i:i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(width)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64 values -1 or 1."""
    return np.unpackbits(hashes[:, None].view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash bytes (rows x BLOCKS) of the windows of ``width`` shingles at ``starts``."""
    out = np.empty((len(starts), BLOCKS), np.uint8)
    step = max(1, (1 << 14) // width)
    for i in range(0, len(starts), step):
        sums = np.zeros((len(starts[i:i + step]), 64), np.int32)
        for lo in range(0, width, 1 << 14):
            at = starts[i:i + step, None] + np.arange(lo, min(width, lo + (1 << 14)))
            sums += bits_of(hashes[at].ravel()).reshape(*at.shape, 64).sum(axis=1)
        out[i:i + step] = np.packbits(sums > 0, axis=1)
    return out


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of shingle counts."""
    low = sum(min(c, b[x]) for x, c in a.items() if x in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if low else 0.0


@dataclass
class Index:
    """One part of the benchmark, ready to be probed."""
    ids: np.ndarray
    n_words: np.ndarray
    bags: list[Counter]
    known: np.ndarray  # sorted shingle hashes of all items
    prints: np.ndarray  # items x BLOCKS
    near: np.ndarray  # BLOCKS x 256 x items: within RADIUS // BLOCKS bits
    n: int
    threshold: float


POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def build(items: list[tuple[int, str]], n: int, threshold: float) -> Index | None:
    kept = [(i, w) for i, w in ((i, words_of(t)) for i, t in items) if w]
    if not kept:
        return None
    hashes = [shingle_hashes(w, n) for _, w in kept]
    prints = np.vstack([fingerprints(h, np.array([0]), len(h)) for h in hashes])
    values = np.arange(256, dtype=np.uint8)
    near = np.stack([POPCOUNT[values[:, None] ^ prints[:, b]] <= RADIUS // BLOCKS for b in range(BLOCKS)])
    return Index(np.array([i for i, _ in kept]), np.array([len(w) for _, w in kept]),
                 [Counter(h.tolist()) for h in hashes], np.unique(np.concatenate(hashes)), prints, near, n, threshold)


def match(index: Index, text: str | bytes | None) -> list[tuple[int, int, int, float]]:
    """(item, first word, words, similarity) of the best window per item that is similar enough."""
    words = words_of(text)
    if not words:
        return []
    n, t = index.n, index.threshold
    own = shingle_hashes(words, n)
    at = np.minimum(np.searchsorted(index.known, own), len(index.known) - 1)
    shared = np.concatenate([[0], np.cumsum(index.known[at] == own)])
    if not shared[-1] and index.n_words.min() >= n:
        return []
    out = []
    for size in np.unique(np.minimum(index.n_words, len(words))):
        size = int(size)
        which = np.flatnonzero(np.minimum(index.n_words, len(words)) == size)
        if size < n and size < len(words):  # windows of so few words are one shingle each
            hashes, width = shingle_hashes(words, size), 1
            starts = np.flatnonzero(np.isin(hashes, index.known))
        else:
            hashes, width = own, max(1, size - n + 1)
            # a window with less in common with all items together cannot reach the threshold with one
            least = np.ceil(t * width - 1e-9)
            starts = np.flatnonzero(shared[width:] - shared[:-width] >= least)
        if not len(starts):
            continue
        prints = fingerprints(hashes, starts, width)
        for lo in range(0, len(starts), 512):
            part, p = starts[lo:lo + 512], prints[lo:lo + 512]
            near = np.zeros((len(part), len(which)), bool)
            for b in range(BLOCKS):
                near |= index.near[b][p[:, b]][:, which]
            w, j = np.nonzero(near)
            far = POPCOUNT[p[w] ^ index.prints[which[j]]].sum(axis=1, dtype=np.int32)
            for a, k in zip(w[far <= RADIUS], which[j[far <= RADIUS]], strict=True):
                s = similarity(Counter(hashes[part[a]:part[a] + width].tolist()), index.bags[k])
                if s >= t - 1e-12:
                    out.append((int(index.ids[k]), int(part[a]), size, s))
    best: dict[int, tuple[int, int, int, float]] = {}
    for hit in out:
        if hit[0] not in best or (-hit[3], hit[1]) < (-best[hit[0]][3], best[hit[0]][1]):
            best[hit[0]] = hit
    return sorted(best.values())


def parts(benchmark: DataFrame, n: int, threshold: float) -> Iterator[Index]:
    """The benchmark in parts of bounded size, in order of a running number."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    k = max(1, -(-total["n"] // (ITEMS // 2)), -(-(total["b"] or 0) // (ITEM_WORDS * 4)))
    for part in range(k):  # by a hash of the item, so a part is about half as large as allowed
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == part).collect()
        index = build(sorted((r["item_id"], r["text"]) for r in rows), n, threshold)
        if index is not None:
            yield index


def probe(shared: Broadcast) -> Callable[[Column], Column]:
    """The function of a text column that finds the items of one part."""

    @F.pandas_udf(FOUND)
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(NAMES, hit, strict=True)) for hit in match(shared.value, t)] for t in text], dtype=object)

    return found


def matches(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """All columns of ``docs`` and ``found``: array of (item_id, start, words, similarity), empty for a clean text."""
    spark = docs.sparkSession
    found: list[Column] = []
    for index in parts(benchmark, n, threshold):
        shared = spark.sparkContext.broadcast(index)

        found.append(probe(shared)(F.col("text").cast("binary")))
    return docs.withColumn("found", F.concat(*found) if found else F.array().cast(FOUND))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document and item: where the copy starts (in words), its words and its similarity."""
    hits = matches(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    # an item that is listed twice is reported once
    first = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start"))
    return hits.withColumn("i", first).where("i = 1").drop("i")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item."""
    rows = docs.select("text", F.struct("*").alias("row"))
    return matches(rows, benchmark).where(F.size("found") == 0).select("row.*")
