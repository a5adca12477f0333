"""Hard negatives of anchor vectors by best-first search in STR-packed R-trees.

Vectors are quantised to integers, so that scores are exact integer inner
products. They are cut along the first coordinate by a range partitioning
(the first slice of sort-tile-recursive packing; equal values are spread by a
hash of the id, so copies of one vector fill no single task). Each task packs
slabs of at most ``SLAB`` vectors: tile after tile is sorted along the next
coordinate until a tile is a leaf of ``LEAF`` vectors. The packed slabs are
written once, with the minimum bounding boxes of their leaves.

A search carries a block of anchors over all slabs. For an anchor q, a box
[lo, hi] holds only scores in [sum min(q*lo, q*hi), sum max(q*lo, q*hi)].
Nodes leave a queue highest bound first and go on with those anchors alone
whose score window the interval meets and whose kth score is not above the
bound; a node that no anchor needs is dropped with all below it. What a task
has found bounds its later slabs. Two searches answer a block: positives (the
best of the same label), then negatives (the best of another label inside the
windows that the positives' scores set).

Defined results: rows without vec_id, label or vector, or with a component
that is null or not finite, take no part; nor do vectors whose quantised
length is 2^31 or more, as their scores would leave 64 bits. Vectors of
different lengths (dimensions) have no score. Repeated rows are candidates
and anchors of their own; rows with the anchor's id are never its positives.
A negative positive score makes an empty window. An empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import run_folder, written
from .topk import NONE, Best

SCALE, RELABEL, CLASSES, EVERY = 256, 7, 10, 100  # fixed values of the contract
SLAB, LEAF, FAN = 8_192, 128, 8
BLOCK = 1 << 20  # components of a block of anchors
EXACT = float(1 << 53)
ANY = (NONE + 1, np.iinfo(np.int64).max)

PACKED = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary()),
                    ("starts", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): the rows that take part, with integer components and the label of the contract."""
    d = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.col("label").cast("long")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % CLASSES).otherwise(label).alias("label"),
        F.transform(d, lambda x: F.floor(SCALE * x)).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.where(square < 2.0 ** 62)


def tiles(x: np.ndarray, rows: np.ndarray, axis: int = 0) -> Iterator[np.ndarray]:
    """Sort-tile-recursive: slices along one coordinate, each cut along the next; at most LEAF rows in a tile."""
    leaves = -(-len(rows) // LEAF)
    left = x.shape[1] - axis
    if leaves <= 1 or left <= 0:
        yield from (rows[i:i + LEAF] for i in range(0, len(rows), LEAF))
        return
    slices = int(np.ceil(leaves ** (1 / left) - 1e-9))
    wide = -(-leaves // max(2, slices)) * LEAF
    rows = rows[np.argsort(x[rows, axis], kind="stable")]
    for i in range(0, len(rows), wide):
        yield from tiles(x, rows[i:i + wide], axis + 1)


@dataclass
class Slab:
    """One packed R-tree: vectors in order of the leaves, and the boxes of every level, the root last."""
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    starts: np.ndarray  # where each leaf starts
    lo: np.ndarray  # boxes of the leaves
    hi: np.ndarray

    @staticmethod
    def pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Slab:
        leaves = list(tiles(x, np.arange(len(ids))))
        order = np.concatenate(leaves)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in leaves])[:-1]]).astype(np.int32)
        x = x[order]
        lo, hi = (f.reduceat(x, starts, axis=0) if x.shape[1] else x[starts] for f in (np.minimum, np.maximum))
        return Slab(ids[order], labels[order], x, starts, lo, hi)

    def row(self) -> tuple:
        return (self.x.shape[1], *(a.tobytes() for a in (self.ids, self.labels, self.x, self.starts, self.lo, self.hi)))

    @staticmethod
    def read(r: dict) -> Slab:
        ids = np.frombuffer(r["ids"], np.int64)
        starts = np.frombuffer(r["starts"], np.int32)
        boxes = [np.frombuffer(r[c], np.int32).reshape(len(starts), r["dim"]) for c in ("lo", "hi")]
        return Slab(ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["x"], np.int32).reshape(len(ids), r["dim"]),
                    starts, *boxes)

    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Boxes from the leaves up: node i of a level bounds nodes FAN*i .. FAN*i+FAN-1 of the one below."""
        out = [(self.lo, self.hi)]
        while len(out[-1][0]) > 1:
            at = np.arange(0, len(out[-1][0]), FAN)
            out.append((np.minimum.reduceat(out[-1][0], at, axis=0), np.maximum.reduceat(out[-1][1], at, axis=0))
                       if self.x.shape[1] else (out[-1][0][at], out[-1][1][at]))
        return out


def pack_slabs(rows: DataFrame) -> DataFrame:
    """Packed slabs of the quantised vectors, one row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by dimension: parts of (ids, labels, x)
        sizes: dict[int, int] = {}

        def close(dim: int) -> pa.RecordBatch:
            slab = Slab.pack(*(np.concatenate(c) for c in zip(*held.pop(dim), strict=True)))
            sizes.pop(dim)
            return pa.RecordBatch.from_pylist([dict(zip(PACKED.names, slab.row(), strict=True))], schema=PACKED)

        for b in batches:
            ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            lists = b.column("x")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            dims = np.diff(ends, prepend=0)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = values[(ends[at] - dim)[:, None] + np.arange(dim)]
                done = 0
                while done < len(at):
                    part = slice(done, done + SLAB - sizes.get(dim, 0))
                    held.setdefault(dim, []).append((ids[at[part]], labels[at[part]], x[part]))
                    sizes[dim] = sizes.get(dim, 0) + len(at[part])
                    done += len(at[part])
                    if sizes[dim] == SLAB:
                        yield close(dim)
        for dim in list(held):
            yield close(dim)

    sliced = rows.repartitionByRange(F.try_element_at("x", F.lit(1)), F.xxhash64("vec_id"))
    return sliced.mapInArrow(pack, "dim int, ids binary, labels binary, x binary, starts binary, lo binary, hi binary")


@dataclass
class Anchors:
    """A block of anchors and the score windows of their rankings (anchors x windows)."""
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool  # look for the anchor's label, or for all others

    def search(self, slab: Slab, best: Best) -> None:
        """Best-first over one tree; ``best`` holds a ranking per anchor and window."""
        n, windows = self.low.shape
        reach = float(np.abs(self.q, dtype=np.float64).max(initial=0)) * max(
            float(np.abs(b).max(initial=0)) for b in (slab.lo.astype(np.float64), slab.hi.astype(np.float64))) * slab.x.shape[1]
        q = self.q.astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        boxes = slab.levels()

        def bounds(level: int, nodes: slice, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lo, hi = (b[nodes].astype(np.float64).T for b in boxes[level])
            # sums of integers below 2^53 are exact; beyond, the interval is widened by more than their rounding
            slack = 0.0 if reach < EXACT else 1e-9 * reach
            return down[who] @ hi + up[who] @ lo - slack, up[who] @ hi + down[who] @ lo + slack

        def needed(who: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            floor = np.maximum(best.kth().reshape(n, windows)[who], self.low[who])
            open_ = self.low[who] <= self.high[who]
            return (open_ & (upper[:, None] >= floor) & (lower[:, None] <= self.high[who])).any(axis=1)

        everyone = np.arange(n)
        lower, upper = bounds(len(boxes) - 1, slice(0, 1), everyone)
        queue = [(-upper.max(initial=-np.inf), len(boxes) - 1, 0, everyone, lower[:, 0], upper[:, 0])]
        while queue:
            _, level, node, who, lower, upper = heapq.heappop(queue)
            live = needed(who, lower, upper)
            who = who[live]
            if not len(who):
                continue
            if level == 0:
                self.leaf(slab, node, who, best, reach)
                continue
            children = slice(node * FAN, min(node * FAN + FAN, len(boxes[level - 1][0])))
            lower, upper = bounds(level - 1, children, who)
            for j, child in enumerate(range(children.start, children.stop)):
                heapq.heappush(queue, (-upper[:, j].max(), level - 1, child, who, lower[:, j], upper[:, j]))

    def leaf(self, slab: Slab, node: int, who: np.ndarray, best: Best, reach: float) -> None:
        end = slab.starts[node + 1] if node + 1 < len(slab.starts) else len(slab.ids)
        part = slice(slab.starts[node], end)
        if reach < EXACT:
            scores = (self.q[who].astype(np.float64) @ slab.x[part].T.astype(np.float64)).astype(np.int64)
        else:  # wraps on the way, but the sum itself fits
            scores = self.q[who].astype(np.int64) @ slab.x[part].T.astype(np.int64)
        same = self.labels[who][:, None] == slab.labels[part]
        allowed = same & (self.ids[who][:, None] != slab.ids[part]) if self.same else ~same
        windows = self.low.shape[1]
        for j in range(windows):
            inside = allowed & (scores >= self.low[who, j][:, None]) & (scores <= self.high[who, j][:, None])
            best.offer(who * windows + j, scores, slab.ids[part], inside)


def ranked(slabs: DataFrame, anchors: Anchors, k: int) -> DataFrame:
    """(ranking, place, score, id): the k best of every ranking of a block over all slabs."""
    spark, dim = slabs.sparkSession, anchors.q.shape[1]
    # at most BLOCK components; plain arrays, as executors need no copy of this package
    sent = spark.sparkContext.broadcast((anchors.ids, anchors.labels, anchors.q, anchors.low, anchors.high, anchors.same))
    schema = pa.schema([("ranking", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Anchors(*sent.value)
        best = Best(block.low.size, k)
        for b in batches:
            for r in b.to_pylist():
                block.search(Slab.read(r), best)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best.rows()], schema=schema)

    found = slabs.where(F.col("dim") == dim).mapInArrow(search, "ranking long, score long, id long")
    place = F.row_number().over(Window.partitionBy("ranking").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low*score <= 100*s <= high*score."""
    return -(-low * score // 100), high * score // 100


def blocks(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of blocks of anchors of one dimension, about BLOCK components each."""
    dims = anchors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per dimension
    for dim, n in sorted((r["d"], r["n"]) for r in dims):
        parts = -(-n * max(dim, 64) * 5 // (BLOCK * 4))  # blocks by hash are a little uneven
        for p in range(parts):
            rows = anchors.where((F.size("x") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p)).collect()
            if rows:
                rows.sort(key=lambda r: (r["vec_id"], r["label"], r["x"]))
                yield (np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64),
                       np.array([r["x"] for r in rows], np.int32).reshape(len(rows), dim))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90) -> DataFrame:
    """The hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id and both scores.

    ``vectors`` has columns vec_id, embedding and label; ``is_anchor`` picks the anchors by vec_id. A negative scores
    between ``low`` and ``high`` percent of the positive."""
    spark: SparkSession = vectors.sparkSession
    folder = run_folder(spark, "negatives")
    rows = quantised(vectors.select("vec_id", "embedding", "label"))
    slabs = written(pack_slabs(rows), f"{folder}/slabs")
    anchors = written(rows.where(is_anchor), f"{folder}/anchors")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(f"{folder}/found")
    for ids, labels, q in blocks(anchors):
        whole = (np.full((len(ids), 1), v, np.int64) for v in ANY)
        # at most ``positives`` rows for each anchor of the block
        firsts = ranked(slabs, Anchors(ids, labels, q, *whole, True), positives).collect()
        edges = np.tile(np.array([[[1]], [[0]]], np.int64), (1, len(ids), positives))  # empty windows
        owner = []
        for r in firsts:
            a, j = r["ranking"], r["place"] - 1
            edges[:, a, j] = window_of(r["score"], low, high)
            owner.append((a * positives + j, int(ids[a]), r["id"], r["score"]))
        found = ranked(slabs, Anchors(ids, labels, q, edges[0], edges[1], False), negatives)
        names = spark.createDataFrame(owner, "ranking long, anchor_id long, positive_id long, positive_score long")
        # the positives of one block: bounded by its size
        found.join(F.broadcast(names), "ranking").select(
            "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(schema).parquet(f"{folder}/found")


def report(vectors: DataFrame) -> DataFrame:
    return mine(vectors, F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r
  FROM s WHERE same AND vec_id <> anchor_id QUALIFY r <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.r ORDER BY n.score DESC, n.vec_id) AS INT) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""
