"""Exact substring deduplication with fixed-block anchors.

A passage of at least ``window`` words that occurs twice holds, in each of its
places, a whole aligned block of ``anchor = (window + 1) // 2`` words. So:

1. Index: the non-overlapping blocks of every document (its anchors).
   Probe: every rolling window of ``anchor`` words. A probe hits if its hash is
   that of some anchor and occurs more than once in the corpus.
2. Extend: hits are extended to all full windows that contain one; a full
   window is repeated if its own 64-bit hash, in a bucket chosen by an
   independent hash, occurs more than once. Overlapping repeated windows add
   up to maximal exact repeats. Windows are judged on the input.

Both look-ups are chunk/bucket exchanges (see ``exchange``): no pairs of
occurrences are ever formed, so thousands of copies cost what they hold. The
texts are shuffled once (three uses share the exchange); keys travel as 5 and
8 bytes.

Defined results: a null text has no words; texts shorter than a window lose
nothing; repeated rows are separate documents (copies of each other); null
ids are allowed; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE
from .exchange import CHUNK_BYTES, Keys, chunked, flags, mix, pack, rows, unflags, unpack

SEGMENT = 1 << 18
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE.encode())] = True
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)

#: kind 0: keys of a chunk for a bucket (n, keys, flags); kind 1: a note of a chunk to itself (n, flags)
ASK = pa.schema([("b", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()),
                 ("anchor", pa.binary()), ("many", pa.binary())])
ASK_SQL = "b int, g int, kind int, n int, keys binary, anchor binary, many binary"
ANSWER = pa.schema([("g", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("hits", pa.binary())])
ANSWER_SQL = "g int, b int, kind int, n int, hits binary"
KEPT_SQL = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,words:long>>, kept binary"


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined by a space; of every word its hash and where it ends there; where each text's words start
    (one more entry than texts)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    found, starts, ends, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while lo < len(data):
        hi = min(len(data), lo + SEGMENT)
        while hi < len(data) and not IS_SPACE[data[hi - 1]]:  # cut after white space
            gap = np.flatnonzero(IS_SPACE[data[hi:hi + 4096]])
            hi = hi + int(gap[0]) + 1 if len(gap) else min(len(data), hi + 4096)
        part = data[lo:hi]
        space = IS_SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODE[part] * powers(BASE, len(part)))])
        found.append(mix((sums[last] - sums[first]) * powers(INVERSE, len(part) + 1)[first] + (last - first).astype(np.uint64)))
        starts.append(first + lo)
        ends.append(last + lo)
        lo = hi
    return data, np.concatenate(found), np.concatenate(ends), np.searchsorted(np.concatenate(starts), offsets)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of all texts, and where each text's words start (one more entry than texts)."""
    _, h, _, bounds = word_spans(texts)
    return h, bounds


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from every place that has so many after it."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(INVERSE, len(h)))])
    return mix((sums[width:] - sums[:-width]) * powers(BASE, len(h) - width + 1))


class Chunk:
    """The documents of a chunk in a fixed order, and their words' hashes."""

    def __init__(self, table: pa.Table):
        docs = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
        self.ids, self.texts = [d[0] for d in docs], [d[1] or b"" for d in docs]
        self.words, self.bounds = word_hashes(self.texts)
        self.ends = np.repeat(self.bounds[1:], np.diff(self.bounds))

    def places(self, width: int) -> np.ndarray:
        """Where a window of ``width`` words starts that ends in the same document."""
        return np.flatnonzero(np.arange(len(self.words)) + width <= self.ends)

    def probes(self, anchor: int, buckets: int) -> tuple[np.ndarray, Keys, np.ndarray]:
        """Places and keys of all rolling windows, and which keys are anchors here."""
        at = self.places(anchor)
        keys = Keys.of(window_hashes(self.words, anchor)[at], buckets)
        inside = at - np.repeat(self.bounds[:-1], np.diff(self.bounds))[at]
        is_anchor = np.zeros(len(keys.values), bool)
        is_anchor[keys.place[inside % anchor == 0]] = True
        return at, keys, is_anchor


def hits_of(keys: Keys, answers: pa.Table) -> np.ndarray:
    """The answers of all buckets in the order of ``keys.values``."""
    out = np.zeros(len(keys.values), bool)
    for b, kind, n, blob in zip(*(answers[c].to_pylist() for c in ("b", "kind", "n", "hits")), strict=True):
        if kind == 0:
            out[keys.bounds[b]:keys.bounds[b + 1]] = unflags(blob, n)
    return out


def decide(width: int):
    """A bucket's answers: a key hits if it is an anchor somewhere and occurs more than once."""
    def answer(table: pa.Table) -> pa.Table:
        asked = [r for r in table.to_pylist() if r["kind"] == 0]
        out = [(r["g"], r["b"], 1, r["n"], r["many"]) for r in table.to_pylist() if r["kind"] == 1]
        if asked:
            keys = np.concatenate([unpack(r["keys"], r["n"], width) for r in asked])
            _, inverse = np.unique(keys, return_inverse=True)
            many = np.bincount(inverse) > 1
            many[inverse[np.concatenate([unflags(r["many"], r["n"]) for r in asked])]] = True
            anchor = np.zeros(len(many), bool)
            anchor[inverse[np.concatenate([unflags(r["anchor"], r["n"]) for r in asked])]] = True
            hit, lo = (many & anchor)[inverse], 0
            for r in asked:
                out.append((r["g"], r["b"], 0, r["n"], flags(hit[lo:lo + r["n"]])))
                lo += r["n"]
        return rows(ANSWER, out)
    return answer


def remove_repeats(docs: DataFrame, window: int = 35, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: n_words, n_removed, the removed spans (in words) and the kept words joined by one space."""
    anchor = (window + 1) // 2
    texts, n = chunked(docs.select("doc_id", F.col("text").cast("binary").alias("text")), chunk_bytes)

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        _, keys, is_anchor = Chunk(table).probes(anchor, n)
        return rows(ASK, [(b, key[0].as_py(), 0, s.stop - s.start, pack(keys.values[s], 5), flags(is_anchor[s]),
                           flags(keys.many[s])) for b, s in keys.slices()])

    def extend(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, g = Chunk(table), key[0].as_py()
        at, keys, _ = chunk.probes(anchor, n)
        hit = np.zeros(len(chunk.words) + 1, np.int64)
        hit[at[hits_of(keys, answers)[keys.place]] + 1] = 1
        upto, full = np.cumsum(hit), chunk.places(window)
        full = full[upto[full + window - anchor + 1] > upto[full]]  # windows that contain a hit
        if not len(full):
            return rows(ASK, [])
        mine = np.zeros(len(chunk.words), bool)
        mine[full] = True
        keys = Keys.of(window_hashes(chunk.words, window)[full], n)
        yes = np.ones(len(keys.values), bool)
        return rows(ASK, [(g, g, 1, len(mine), b"", b"", flags(mine))] + [
            (b, g, 0, s.stop - s.start, pack(keys.values[s], 8), flags(yes[s]), flags(keys.many[s])) for b, s in keys.slices()])

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        gone = np.zeros(len(chunk.words) + 1, np.int64)
        for kind, size, blob in zip(*(answers[c].to_pylist() for c in ("kind", "n", "hits")), strict=True):
            if kind == 1:
                full = np.flatnonzero(unflags(blob, size))
                keys = Keys.of(window_hashes(chunk.words, window)[full], n)
                again = full[hits_of(keys, answers)[keys.place]]
                np.add.at(gone, again, 1)
                np.add.at(gone, again + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        out: list[list] = [[], [], [], [], []]
        for i, (doc_id, text) in enumerate(zip(chunk.ids, chunk.texts, strict=True)):
            lost, words = gone[chunk.bounds[i]:chunk.bounds[i + 1]], text.split()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
            for c, v in zip(out, (doc_id, len(words), int(lost.sum()),
                                  [{"start": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)],
                                  b" ".join(compress(words, ~lost))), strict=True):
                c.append(v)
        span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True)],
                        names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    hits = texts.groupBy("g").applyInArrow(probe, ASK_SQL).groupBy("b").applyInArrow(decide(5), ANSWER_SQL)
    wide = texts.groupBy("g").cogroup(hits.groupBy("g")).applyInArrow(extend, ASK_SQL)
    again = wide.groupBy("b").applyInArrow(decide(8), ANSWER_SQL)
    return (texts.groupBy("g").cogroup(again.groupBy("g")).applyInArrow(cut, KEPT_SQL)
            .withColumn("kept", F.decode("kept", "UTF-8")))


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS s FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 34], ' ')) AS h FROM p),
d AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 34)) AS i FROM h SEMI JOIN d USING (h)),
g AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
k AS (SELECT w.doc_id, ws, coalesce(gone, []) AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id),
one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.i) AS kept FROM one ANTI JOIN gone ON one.doc_id = gone.doc_id AND one.i = gone.i GROUP BY one.doc_id)
SELECT k.doc_id, len(k.ws) AS n_words, len(k.gone) AS n_removed, sha256(coalesce(kept.kept, '')) AS kept_sha256
FROM k LEFT JOIN kept ON k.doc_id = kept.doc_id
"""
