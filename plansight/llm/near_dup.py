"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document becomes a signature of ``HASHES`` min-hashes of its distinct
   word shingles. Documents with equal sets (128-bit fingerprint) are one node;
   copies are never paired.
2. Banding: nodes that agree on a band of ``ROWS`` hashes share a bucket. A pair
   of similarity 0.8 misses all ``HASHES / ROWS`` bands once in 10^7.
3. Candidates are compared batch by batch of ``BATCH`` hashes (one byte each, mixed
   so that unrelated sets of any size agree on one in 256). After each batch a pair
   whose posterior probability of reaching the threshold is below ``MISS`` is pruned.
4. Survivors are verified exactly on their full shingle sets.

Pairs within a bucket are not all formed. First every node meets the hub of each
of its buckets: the node whose buckets hold the most nodes, which in a family of
near copies is their original, so that most copies meet the same one. Only where
a bucket still holds nodes of different components, the remaining links between
those are looked for (``leftovers``). Two nodes either share a shingle that at
most ``FEW`` of the open nodes hold and meet there (a node meets fewer than
``FEW`` others at each), or have nothing but commoner ones in common, and then
their counts of those bound their similarity. An odd sketch bounds it further:
a set's shingles are dealt to ``PARTS`` parts by a hash, a bit says whether a part
holds an odd number; each bit that differs is a shingle that only one of the two
sets holds, however long they are. None of these rules loses a link.

Words are runs of anything but white space, A-Z lower-cased; a document with
fewer words than a shingle has its whole sequence as one. Defined results:
null or empty texts have no shingles and link with nothing; a row without an
id has a set size but takes no part (component null, kept); rows that repeat an id and its text
share its component; an id is expected to stand for one text (of several, one
stands for the id as a node); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..session import small_batches
from . import common
from .anchors import word_hashes
from .common import GROUP_BYTES, drop_folder, give_back, run_folder
from .components import connected
from .exchange import mix

HASHES, ROWS, BATCH = 128, 4, 32
MISS = 1e-7
_rng = np.random.default_rng(20)
MULT = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, sig binary, bands array<long>"


def written(df: DataFrame, path: str) -> DataFrame:
    """``common.written``, with texts and sets in batches of a group: by rows alone, 10,000 long ones are one batch."""
    with small_batches(df.sparkSession, GROUP_BYTES):
        return common.written(df, path)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles."""
    h, bounds = word_hashes([(t or b"").lower() for t in texts])
    n = max(0, len(h) - k + 1)
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(s[a:b - k + 1]))
        else:
            whole = np.full(1, (b - a), np.uint64)
            for x in h[a:b]:
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(whole[:int(b > a)])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """The min-hashes of a set."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, (MULT[:, None] * s[i:i + 4096] + ADD[:, None]).min(axis=1))
    return out


def signature_bytes(sig: np.ndarray) -> bytes:
    """One byte per min-hash. A minimum is small in a large set, so its own bytes are not uniform; mixed ones are."""
    return (mix(sig) >> np.uint64(56)).astype(np.uint8).tobytes()


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(HASHES // ROWS, dtype=np.uint64)
    for col in sig.reshape(-1, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (col >> np.uint64(16)))
    return key


def in_groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes | None]]]:
    """(ids, texts) of a batch in groups of about GROUP_BYTES."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1), strict=True):
        ids.append(i.as_py())
        texts.append(t.as_py())
        size += len(texts[-1] or b"")
        if size >= GROUP_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Size, fingerprint, signature bytes and band keys of every document."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in in_groups(batch):
                out: list[list] = [[] for _ in range(6)]
                for i, s in zip(ids, shingle_sets(texts, k), strict=True):
                    sig = signature(s)
                    f1, f2 = (int(x) for x in np.array([mix(s).sum(dtype=np.uint64), mix(mix(s) ^ np.uint64(77)).sum(dtype=np.uint64)]).view(np.int64))
                    for c, v in zip(out, (i, len(s), f1, f2, signature_bytes(sig),
                                          band_keys(sig).view(np.int64).tolist() if len(s) else []), strict=True):
                        c.append(v)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)],
                                      names=["doc_id", "n_shingles", "f1", "f2", "sig", "bands"])
        give_back()

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(sign, SIGNED)


def least_matches(percent: int) -> list[tuple[int, int]]:
    """(hashes compared, matches needed): fewer leave a posterior below MISS that the similarity is reached.

    With a uniform prior, m matches of n give P(J >= t) = P(Binomial(n + 1, t) <= m)."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while (below := below + comb(n + 1, m) * t**m * (1 - t)**(n + 1 - m)) < MISS:
            m += 1
        out.append((n, m))
    return out


def plausible(percent: int):
    """Sequential test of two signature columns."""
    steps = least_matches(percent)

    @F.pandas_udf(BooleanType())
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, HASHES) for s in (x, y))
        live, got, lo = np.ones(len(a), bool), np.zeros(len(a), np.int64), 0
        for n, least in steps:
            at = np.flatnonzero(live)  # pruned pairs are compared no further
            got[at] += (a[at, lo:n] == b[at, lo:n]).sum(axis=1)
            live[at] = got[at] >= least
            lo = n
        return pd.Series(live)

    return test


def odd_sketch(s: np.ndarray) -> list[int]:
    """PARTS bits, in longs: which parts hold an odd number of the set's shingles."""
    odd = np.bincount((mix(s) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def similar(percent: int):
    """Exact test of two columns of shingle sets (sorted 64-bit hashes)."""
    @F.pandas_udf(BooleanType())
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            p, q = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    return test


def fit(n: Column, m: Column, percent: int) -> Column:
    """Sets whose sizes differ more than this cannot be similar enough."""
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


class Linker:
    """Candidate pairs in, verified links and components out; all tables are written to the shared folder."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int, folder: str):
        self.nodes, self.sets, self.percent, self.folder = nodes, sets, percent, folder
        self.components: DataFrame | None = None
        self.steps = 0

    def verify(self, pairs: DataFrame) -> None:
        """``pairs`` (a, b), each once: prune, verify, and join components along the links."""
        self.steps += 1
        pairs = written(pairs, f"{self.folder}/pairs-{self.steps}")
        if self.components is not None and pairs.isEmpty():  # nothing left to join
            return
        one = lambda side: self.nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
        near = (pairs.join(one("a"), "a").join(one("b"), "b").where(fit(F.col("n_a"), F.col("n_b"), self.percent))
                .where(plausible(self.percent)("sig_a", "sig_b")).select("a", "b"))
        near = self.then(written(near, f"{self.folder}/near-{self.steps}"), "pairs")
        full = lambda side: self.sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))
        links = (near.join(full("b"), "b").join(full("a"), "a").where(similar(self.percent)("set_a", "set_b")).select("a", "b"))
        links = self.then(written(links, f"{self.folder}/links-{self.steps}"), "near")
        if self.components is not None:  # what is known stays joined through its component
            links = links.unionByName(self.components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.components = self.then(written(connected(links), f"{self.folder}/components-{self.steps}"), "links")

    def then(self, table: DataFrame, name: str) -> DataFrame:
        """``table`` is written, so that what it was made of can go."""
        drop_folder(table.sparkSession, f"{self.folder}/{name}-{self.steps}")
        return table

    def labelled(self, rows: DataFrame, node: str, label: str) -> DataFrame:
        """Add a node's component (the node itself, if it has no link yet)."""
        c = self.components.select(F.col("node").alias(node), F.col("component").alias(label))
        return rows.join(c, node, "left").withColumn(label, F.coalesce(label, node))


#: A shingle of at most this many open nodes is rare. A choice of cost alone: ``leftovers`` is exact for any value.
FEW = 8
#: Bits of the odd sketch; more bits bound tighter where sets differ by many shingles.
PARTS = 1024


def across(rows: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    """Pairs of rows with equal ``key`` and different components ``c``: columns a, b and ``cols`` with suffixes.

    Every such pair has an end outside the key's largest component, so only those rows meet all others."""
    largest = (rows.groupBy(*key, "c").agg(F.count(F.lit(1)).alias("k")).groupBy(*key)
               .agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("cs"))
               .where("cs > 1").select(*key, F.col("m.c").alias("main")))
    open_ = rows.join(largest, key)
    named = lambda side: open_.select(*key, F.col("node").alias(side), *[F.col(x).alias(f"{x}_{side}") for x in ("c", *cols)], "main")
    x, y = named("a").where("c_a <> main").drop("main"), named("b")
    return x.join(y, key).where("c_a <> c_b AND (c_b = main OR a < b)")


def leftovers(linker: Linker, buckets: DataFrame, folder: str) -> DataFrame | None:
    """Pairs (a, b) of different components that may still be similar enough; None if no bucket holds any."""
    percent = linker.percent
    # the hub of a bucket of two has met the other node
    mixed = written(linker.labelled(buckets.where("c > 2").select("band", "node", "n"), "node", "c"), f"{folder}/mixed")
    several = mixed.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("band")
    open_ = written(mixed.join(several, "band", "left_semi"), f"{folder}/open")
    drop_folder(linker.nodes.sparkSession, f"{folder}/mixed")
    if open_.isEmpty():
        return None
    nodes = written(open_.select("node", "n", "c").distinct(), f"{folder}/open-nodes")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, blob in zip(batch["node"].to_pylist(), batch["set"], strict=True):
                s = np.frombuffer(blob.as_py(), np.int64)
                yield pa.record_batch([pa.array(s), pa.array(np.full(len(s), node))], names=["s", "node"])

    held = written(linker.sets.join(nodes.select("node"), "node", "left_semi").mapInArrow(spread, "s long, node long"), f"{folder}/held")
    rare = held.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= FEW)
    kept = written(held.join(rare, "s"), f"{folder}/rare")
    drop_folder(linker.nodes.sparkSession, f"{folder}/held")
    counts = kept.groupBy("node").agg(F.count(F.lit(1)).alias("r"))
    known = written(nodes.join(counts, "node", "left").withColumn("r", F.coalesce("r", F.lit(0)))
                    .join(linker.sets.select("node", "odd"), "node"), f"{folder}/known")

    def enough(both: Column) -> Column:
        return both * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent

    common = F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b"))
    apart = reduce(add, [F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(PARTS // 64)])
    by_sketch = (F.col("n_a") + F.col("n_b") - apart) / 2
    # nothing rare in common. The size that a partner can have at most is below the bucket's least for most.
    rows = open_.select("band", "node").join(known, "node").withColumn("most", F.floor(((F.col("n") - F.col("r")) * (100 + percent)) / percent) - F.col("n"))
    least = rows.groupBy("band").agg(F.min("n").alias("least"))
    rows = rows.join(least, "band").where("most >= least")
    plain = across(rows, ["band"], ["n", "r", "odd"]).where(enough(common) & enough(by_sketch))
    meet = across(kept.where("df > 1").select("s", "node").join(known, "node"), ["s"], ["n", "r", "odd"])
    ends = [F.struct(F.col(x).alias("node"), F.col(f"n_{x}").alias("n"), F.col(f"r_{x}").alias("r")) for x in "ab"]
    pairs = (meet.where(enough(common + F.least("r_a", "r_b")) & enough(by_sketch)).groupBy(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
             .agg(F.count(F.lit(1)).alias("both")))  # the rare shingles that the two share
    shared = pairs.select(*[F.col(f"{e}.{c}").alias(f"{d}{x}") for e, x in (("x", "a"), ("y", "b"))
                            for c, d in (("node", ""), ("n", "n_"), ("r", "r_"))], "both").where(enough(common + F.col("both")))
    return plain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(shared.select("a", "b")).distinct()


#: Bits of the mask in ``thinned``; at most MASK / 64 rows are broadcast, however many ids there are.
MASK = 1 << 24


def thinned(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (doc_id, text) whose id may be a node: none that is one gets lost, so few others travel to the exact join."""
    h = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(MASK))
    slot = lambda c: F.shiftright(h(c), 6)
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (h(c) % 64).cast("int"))
    mask = nodes.groupBy(slot("node").alias("slot")).agg(F.bit_or(bit("node")).alias("bits"))
    return texts.join(F.broadcast(mask), slot("doc_id") == F.col("slot")).where(F.col("bits").bitwiseAND(bit("doc_id")) != 0).select(*texts.columns)


def components(docs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component of a row without an id is null."""
    spark = docs.sparkSession
    folder = run_folder(spark, "near")
    signed = written(signatures(docs, k), f"{folder}/signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = known.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"))
    groups = written(groups, f"{folder}/groups")
    rep = known.join(groups.withColumnRenamed("node", "doc_id"), ["f1", "f2", "n_shingles", "doc_id"], "left_semi")
    banded = rep.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sig", "bands")
    # (bucket, node): only buckets with several nodes matter from here on
    rows = banded.select("node", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    buckets = written(rows.join(shared, "band"), f"{folder}/buckets")
    members = buckets.groupBy("node").agg(F.sum("c").alias("reach"))
    nodes = written(banded.drop("bands").join(members, "node"), f"{folder}/nodes")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in in_groups(batch):
                found = shingle_sets(texts, k)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()),
                                       pa.array([odd_sketch(s) for s in found], pa.list_(pa.int64()))], names=["node", "set", "odd"])
        give_back()

    texts = thinned(docs.select("doc_id", F.col("text").cast("binary").alias("text")), nodes).join(
        nodes.select(F.col("node").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"])  # nodes are distinct; a semi join would be moved below the mask
    sets = written(texts.mapInArrow(sets_of, "node long, set binary, odd array<long>"), f"{folder}/sets")
    linker = Linker(nodes, sets, percent, folder)

    hubs = (buckets.join(nodes.select("node", "reach"), "node").groupBy("band")
            .agg(F.max(F.struct("reach", F.xxhash64("node").alias("h"), "node")).alias("hub")).select("band", F.col("hub.node").alias("hub")))
    linker.verify(buckets.join(hubs, "band").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    left = leftovers(linker, buckets, folder)
    if left is not None:
        linker.verify(left)
    for gone in ("buckets", "nodes", "sets", "open", "open-nodes", "rare", "known"):
        drop_folder(spark, f"{folder}/{gone}")

    by_doc = signed.select("doc_id", "n_shingles", "f1", "f2").join(groups, ["f1", "f2", "n_shingles"], "left")
    out = linker.labelled(by_doc, "node", "component_id")
    # a row without shingles is its own component
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def report(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """Per document: n_shingles, component_id, kept."""
    out = components(docs.select("doc_id", "text"), k, percent)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that have a smaller id in their component."""
    gone = components(docs.select("doc_id", "text"), k, percent).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 2 THEN ws[1] ELSE unnest(list_transform(range(1, greatest(len(ws), 2)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
