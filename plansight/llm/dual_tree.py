"""Ranked lexical search of whole items over all documents by dual-tree search.

An item's score of a document is the sum over its terms (repeats included) of
a term weight times an integer impact, so it is an inner product of two sparse
vectors of integers. Items travel in blocks of bounded size. For a block, one
pass over the texts writes the counts of the block's terms per document
(packed; that table also yields the statistics of the corpus). A second pass
takes slabs of documents: documents and items each get a hierarchy, split at
every node along the coordinate with the largest variance, whose nodes hold
the maximum of every coordinate. The inner product of the maxima of two nodes
bounds every score between them. Pairs of nodes leave a queue highest bound
first; a pair whose bound is below the weakest kth score of its items is
dropped with all its documents and items, and pairs of leaves are scored by a
dense product. What a task has found bounds its later slabs. Nothing is
approximate, and equal bounds are followed because ties go to smaller ids.

Defined results: null and empty texts have no term and no rows; a long text is
cut between terms while it is counted, and is counted whole. Documents with a
null doc_id count in the statistics but cannot be named and are not ranked;
repeated documents are each ranked. An item listed twice with one text is one
item; two texts of one item_id (null included) are two items. An empty table
gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, run_folder, written
from .topk import Best

#: Letters of terms: digits, A-Z lower-cased, a-z and everything beyond ASCII; all else separates.
FOLD = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
SEGMENT = 1 << 20
ITEMS, ITEM_BYTES = 512, 1 << 18  # a block of items; one item may exceed it
SLAB, CELLS = 2_048, 1 << 22  # documents of a slab; numbers that the maxima of its nodes take
DOC_LEAF, ITEM_LEAF, ROUNDS = 64, 8, 4
EXACT = 1 << 53
IMPACT = 1_000_000  # no impact reaches it

PACKED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cols", pa.binary()), ("tf", pa.binary())])


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    low = (text or b"").translate(FOLD)
    at = 0
    while at < len(low):
        end = low.find(b" ", at + SEGMENT)
        end = len(low) if end < 0 else end
        yield low[at:end].split()
        at = end


@dataclass
class Sparse:
    """Rows of a sparse matrix of integers: row i holds values[starts[i]:starts[i+1]] at those cols."""
    starts: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.starts) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``rows``, place of the entry) of all entries of some rows."""
        n = self.starts[rows + 1] - self.starts[rows]
        which = np.repeat(np.arange(len(rows)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.starts[rows][which]


class Tree:
    """A balanced hierarchy over sparse rows: node 1 is the root, 2i and 2i+1 are the children of i."""

    def __init__(self, m: Sparse, leaf: int, scale: np.ndarray):
        self.m, self.scale = m, scale
        self.depth = max(0, math.ceil(math.log2(max(1, len(m)) / leaf)))
        self.order = np.arange(len(m))
        self.span = {1: (0, len(m))}
        for node in range(1, 1 << self.depth):
            a, b = self.span[node]
            self.order[a:b] = self.split(self.order[a:b])
            self.span[2 * node], self.span[2 * node + 1] = (a, (a + b) // 2), ((a + b) // 2, b)
        self.first = 1 << self.depth  # the leaves are the nodes from here on
        self.top = np.zeros((2 * self.first, m.width), np.int64)
        for node in range(self.first, 2 * self.first):
            _, at = m.entries(self.rows(node))
            np.maximum.at(self.top[node], m.cols[at], m.values[at])
        for node in range(self.first - 1, 0, -1):
            self.top[node] = np.maximum(self.top[2 * node], self.top[2 * node + 1])

    def rows(self, node: int) -> np.ndarray:
        return self.order[slice(*self.span[node])]

    def split(self, rows: np.ndarray) -> np.ndarray:
        """Rows in order along the axis on which they differ most (power iterations towards the principal one)."""
        which, at = self.m.entries(rows)
        if not len(at):
            return rows
        cols, values = self.m.cols[at], self.m.values[at] * self.scale[self.m.cols[at]]
        axis = np.bincount(cols, values * values, self.m.width)
        for _ in range(ROUNDS):
            along = np.bincount(which, values * axis[cols], len(rows))
            along -= along.mean()
            axis = np.bincount(cols, values * along[which], self.m.width)
            axis /= max(np.abs(axis).max(), 1e-300)
        return rows[np.argsort(along, kind="stable")]


class Items:
    """A block of items as a tree; per node its columns and maxima, per leaf its dense weights."""

    def __init__(self, m: Sparse, k: int):
        self.tree, self.k = Tree(m, ITEM_LEAF, np.ones(m.width)), k
        self.cols = {v: np.flatnonzero(self.tree.top[v]) for v in range(1, 2 * self.tree.first)}
        self.top = {v: self.tree.top[v][c] for v, c in self.cols.items()}
        total = np.zeros(max(1, len(m)), np.int64)
        np.add.at(total, np.repeat(np.arange(len(m)), np.diff(m.starts)), m.values)
        #: sums of integers below 2^53 are exact as doubles, and fast; larger ones stay integers
        self.number = np.float64 if len(m) and int(total.max()) * IMPACT < EXACT and int(self.top[1].sum()) * IMPACT < EXACT else np.int64
        self.weights, self.place = {}, {}
        for v in range(self.tree.first, 2 * self.tree.first):
            place = np.full(m.width, -1, np.int32)
            place[self.cols[v]] = np.arange(len(self.cols[v]))
            which, at = m.entries(self.tree.rows(v))
            dense = np.zeros((len(self.cols[v]), len(self.tree.rows(v))), self.number)
            dense[place[m.cols[at]], which] = m.values[at]
            self.weights[v], self.place[v] = dense, place
        self.scale = self.tree.top[1] / max(1, self.tree.top[1].max(initial=0))  # documents differ as items see it
        del self.tree.top

    def weakest(self, node: int, best: Best) -> int:
        rows = self.tree.rows(node)
        return max(1, int(best.kth()[rows].min())) if len(rows) else EXACT * EXACT

    def search(self, ids: np.ndarray, docs: Sparse, best: Best) -> None:
        """Offer ``best`` (a ranking per item) all documents of a slab that can still enter it."""
        tree = Tree(docs, DOC_LEAF, self.scale)
        top = tree.top.astype(self.number)

        def bound(d: list[int], v: int) -> list[int]:
            return [int(x) for x in top[d][:, self.cols[v]] @ self.top[v].astype(self.number)]

        queue = [(-bound([1], 1)[0], 1, 1)]
        while queue:
            high, d, v = heapq.heappop(queue)
            if -high < self.weakest(v, best):
                continue
            doc_leaf, item_leaf = d >= tree.first, v >= self.tree.first
            if doc_leaf and item_leaf:
                self.score(ids, docs, tree.rows(d), v, best)
                continue
            if not doc_leaf and (item_leaf or tree.first / d >= self.tree.first / v):  # split the larger side
                pairs = [(b, c, v) for c, b in zip((2 * d, 2 * d + 1), bound([2 * d, 2 * d + 1], v), strict=True)]
            else:
                pairs = [(bound([d], c)[0], d, c) for c in (2 * v, 2 * v + 1)]
            for b, x, y in pairs:
                if b >= self.weakest(y, best):
                    heapq.heappush(queue, (-b, x, y))

    def score(self, ids: np.ndarray, docs: Sparse, rows: np.ndarray, v: int, best: Best) -> None:
        which, at = docs.entries(rows)
        place = self.place[v][docs.cols[at]]
        on = place >= 0
        dense = np.zeros((len(rows), len(self.cols[v])), self.number)
        dense[which[on], place[on]] = docs.values[at[on]]
        scores = (dense @ self.weights[v]).astype(np.int64).T
        best.offer(self.tree.rows(v), scores, ids[rows], scores > 0)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size, by a hash of id and text."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL").distinct()
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(1, -(-total["n"] * 5 // (ITEMS * 4)), -(-(total["b"] or 0) * 5 // (ITEM_BYTES * 4)))
    for p in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        if block:
            yield sorted(((r["item_id"], bytes(r["text"])) for r in block), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def counted(texts: list[bytes], numbers: dict[bytes, int] | None = None) -> tuple[dict[bytes, int], list[dict[int, int]]]:
    """Terms numbered in order of appearance, and per text the count of each."""
    numbers = {} if numbers is None else numbers
    out = []
    for text in texts:
        own: dict[int, int] = {}
        for part in terms(text):
            for t in part:
                c = numbers.setdefault(t, len(numbers))
                own[c] = own.get(c, 0) + 1
        out.append(own)
    return numbers, out


def sparse(rows: list[dict[int, int]], width: int) -> Sparse:
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    cols = np.fromiter((c for r in rows for c in r), np.int64, starts[-1])
    return Sparse(starts, cols, np.fromiter((x for r in rows for x in r.values()), np.int64, starts[-1]), width)


def pack(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Per document with a term: its number of terms, and the counts of the block's terms in it."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)  # terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.get
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                n, found = 0, {}
                for part in terms(text.as_py()):
                    n += len(part)
                    cols = np.fromiter((c for c in map(known, part) if c is not None), np.int32)
                    for c, x in zip(*(a.tolist() for a in np.unique(cols, return_counts=True)), strict=True):
                        found[c] = found.get(c, 0) + x
                if n:
                    out.append((doc_id, n, np.array(list(found), np.int32).tobytes(), np.array(list(found.values()), np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(PACKED)], schema=PACKED)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, cols binary, tf binary")


def documents_with(packed: DataFrame, width: int) -> np.ndarray:
    """Per term of the block, the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            for cols in b.column("cols"):
                total[np.frombuffer(cols.as_py(), np.int32)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    out = np.zeros(width, np.int64)
    for r in packed.select("cols").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]  # a row per term of the block
    return out


def impacts(n: list[int], tf: list[np.ndarray], total: int, words: int) -> np.ndarray:
    """The contract's integers for documents of n terms; a document's norm may need more than 64 bits on the way."""
    m = [25 + 75 * x * total // words for x in n]
    return np.concatenate([10**9 * t // (1000 * t + 8 * x) for t, x in zip(tf, m, strict=True)]) if n else np.zeros(0, np.int64)


def search_block(packed: DataFrame, m: Sparse, total: int, words: int, k: int) -> DataFrame:
    """(item, score, doc_id): what can be among the k best of an item, from every task."""
    sent = packed.sparkSession.sparkContext.broadcast((m.starts, m.cols, m.values, m.width))
    size = max(DOC_LEAF, min(SLAB, CELLS // max(1, m.width) * DOC_LEAF // 2))
    schema = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(Sparse(*sent.value), k)
        best = Best(len(items.tree.m), k)
        width = items.tree.m.width
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []

        def close() -> None:
            ids, n, cols, tf = zip(*held, strict=True)
            starts = np.concatenate([[0], np.cumsum([len(c) for c in cols])]).astype(np.int64)
            docs = Sparse(starts, np.concatenate(cols).astype(np.int64), impacts(n, tf, total, words), width)
            items.search(np.array(ids, np.int64), docs, best)
            held.clear()

        for b in batches:
            for r in b.to_pylist():
                held.append((r["doc_id"], r["n"], np.frombuffer(r["cols"], np.int32), np.frombuffer(r["tf"], np.int64)))
                if len(held) == size:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], schema=schema)

    # a document without a term of the block scores 0
    return packed.where("doc_id IS NOT NULL AND octet_length(cols) > 0").mapInArrow(run, "item long, score long, doc_id long")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession, "ranked")
    docs = docs.select("doc_id", "text")
    schema = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/found")
    for i, block in enumerate(item_blocks(items)):
        numbers, counts = counted([text for _, text in block])
        if not numbers:
            continue
        packed = written(pack(docs, numbers), f"{folder}/{i}")
        size = packed.agg(F.count(F.lit(1)).alias("total"), F.sum("n").alias("words")).first()
        if not size["total"]:
            break
        df = documents_with(packed, len(numbers))
        w = [math.floor(1000 * math.log((2 * size["total"] + 2) / (2 * x + 1))) for x in df.tolist()]
        m = sparse([{c: x * w[c] for c, x in own.items()} for own in counts], len(numbers))
        found = search_block(packed, m, size["total"], size["words"], k)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        names = spark.createDataFrame([(j, item_id) for j, (item_id, _) in enumerate(block)], "item long, item_id long")
        # names of one block of items
        found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "item").select(
            "item_id", "rank", "doc_id", "score").write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(schema).parquet(f"{folder}/found")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return rank(docs, benchmark)


_TERMS = (f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
ORACLE = f"""
WITH i AS (
  SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
it AS (SELECT item, item_id, term, count(*) AS q FROM (SELECT item, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
d AS (
  SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS total, CAST(sum(len(terms)) AS BIGINT) AS words FROM d WHERE len(terms) > 0),
dt AS (
  SELECT doc, doc_id, n, term, count(*) AS tf FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * total + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM dt, st GROUP BY term, total),
s AS (
  SELECT it.item, it.item_id, dt.doc, dt.doc_id,
         CAST(sum(it.q * w.w * ((1000000000 * dt.tf) // (1000 * dt.tf + 8 * (100 - 75 + (75 * dt.n * st.total) // st.words)))) AS BIGINT) AS score
  FROM it JOIN dt USING (term) JOIN w USING (term), st GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 AND doc_id IS NOT NULL QUALIFY rank <= 10"""
