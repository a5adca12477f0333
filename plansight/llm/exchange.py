"""Asking a distributed table about many hashed keys without a row per key.

Documents are grouped in chunks of bounded size by a hash. A chunk sends its
distinct keys to the buckets that own them, one packed row per (chunk,
bucket); a bucket sees every chunk's keys, decides per key, and answers with
one packed row per request, in the request's order. The chunk computes its
keys again and so knows what each answer is about. Copies inside a chunk
travel once, so a key that a third of all documents hold costs a bucket one
entry per chunk, not one per document.

There are as many buckets as chunks, so both sides stay bounded as the data
grows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_bytes

CHUNK_BYTES = 6_000_000


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` (with a column text) and its chunk number ``g``; the number of chunks."""
    n = max(1, -(-text_bytes(docs) // chunk_bytes))
    g = free_name(docs.columns, "g")
    key = F.xxhash64("doc_id", "text") if "doc_id" in docs.columns else F.xxhash64("text")
    return docs.withColumn(g, F.pmod(key, F.lit(n)).cast("int")), n


def mix(h: np.ndarray) -> np.ndarray:
    """A second, independent look at 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((mix(h) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Keys:
    """The distinct keys of a chunk, by bucket and then by value."""
    values: np.ndarray  # in order of (bucket, value)
    place: np.ndarray  # for every key given, where its value stands in ``values``
    many: np.ndarray  # whether a value was given more than once
    bounds: np.ndarray  # where each bucket's values start

    @staticmethod
    def of(h: np.ndarray, buckets: int) -> Keys:
        u, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        b = bucket_of(u, buckets)
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(u), np.int64)
        rank[order] = np.arange(len(u))
        return Keys(u[order], rank[inverse], count[order] > 1, np.searchsorted(b[order], np.arange(buckets + 1)))

    def slices(self):
        for b in range(len(self.bounds) - 1):
            if self.bounds[b + 1] > self.bounds[b]:
                yield b, slice(self.bounds[b], self.bounds[b + 1])


def pack(values: np.ndarray, width: int) -> bytes:
    """The high ``width`` bytes of sorted 64-bit values, plane by plane: the high planes compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width:].T).tobytes()


def unpack(blob: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - width:] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def flags(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unflags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def rows(schema: pa.Schema, out: list[tuple]) -> pa.Table:
    cols = list(zip(*out, strict=True)) if out else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
