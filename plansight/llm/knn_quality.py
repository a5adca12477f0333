"""Quality classifier: similarity-weighted votes of nearest labelled neighbours in a latent semantic space.

Fit (on the driver, from a bounded sample): at most ``sample`` labelled rows,
chosen by a hash of their id, are turned into counts of hashed byte trigrams;
log counts times inverse document frequency, scaled to length 1, and a few
repetition terms (steps of the share of words that repeat the word before
them) are reduced by a randomized truncated SVD to ``rank`` latent dimensions.

Score (on the executors): projection, labelled vectors and labels are
broadcast. Their size is fixed by ``DIMS``, ``rank`` and ``sample``, not by the
data. Each task takes its documents in blocks, computes the exact cosine of
every document with every labelled vector as one matrix product, and averages
the labels of the ``k`` nearest, weighted by similarity. Whole texts are read.

Defined results: a text without trigrams and repeated words (null, empty,
one or two bytes) gets the mean label of the sample; without any labelled rows that mean is 0.5;
a null label is not learnt from; of several labels of one id the smallest
counts; repeated rows score alike; an empty table gives an empty table; other
columns (lang, source and the labels too) are never read for a score.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from .common import give_back

TERMS = 1 << 12
#: Each step of the share of repeated words that a text passes is a term of its own.
STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9], np.float32)
DIMS = TERMS + len(STEPS)
BLOCK = 256


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray  # DIMS x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray
    prior: float
    k: int


def term_counts(text: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams, then the repetition terms (0 or 1)."""
    out = np.zeros(DIMS, np.float32)
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(a) >= 3:
        h = (a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(2246822519) + a[2:] * np.uint32(3266489917)) >> np.uint32(20)
        out[:TERMS] = np.bincount(h, minlength=TERMS)
    words = text.split()
    if len(words) > 1:
        out[TERMS:] = sum(map(operator.eq, words[1:], words)) / (len(words) - 1) > STEPS
    return out


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Trigrams as a vector of length 1; all repetition terms together have length 1 too."""
    return unit(np.hstack([unit(np.log1p(counts[:, :TERMS]) * idf), counts[:, TERMS:] / np.sqrt(len(STEPS))]))


def fit(counts: np.ndarray, labels: np.ndarray, rank: int = 64, k: int = 15, seed: int = 11) -> Model:
    """Latent space and labelled vectors of a sample. ``counts``: rows x DIMS."""
    n = len(counts)
    if n == 0:
        return Model(np.ones(TERMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32),
                     np.zeros(0, np.float32), 0.5, k)
    idf = (np.log((1 + n) / (1 + (counts[:, :TERMS] > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weigh(counts, idf)
    rank = min(rank, n)
    q = np.random.default_rng(seed).standard_normal((DIMS, min(n, rank + 16))).astype(np.float32)
    for _ in range(4):  # power iterations
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    project = (q @ vt.T)[:, :rank].astype(np.float32)
    return Model(idf, project, unit(x @ project).astype(np.float32), labels.astype(np.float32), float(labels.mean()), k)


def vote(model: Model, counts: np.ndarray) -> np.ndarray:
    """Scores of a block of documents."""
    if not len(model.vectors):
        return np.full(len(counts), model.prior)
    cos = unit(weigh(counts, model.idf) @ model.project) @ model.vectors.T
    k = min(model.k, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(cos, near, axis=1), 0).astype(np.float64) ** 4
    total = w.sum(axis=1)
    mean = (w * model.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.where(total > 0, mean, model.prior).round(6)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, rank: int = 64, k: int = 15) -> Model:
    """Fit on at most ``sample`` labelled rows that are not held out, the first by a hash of their id."""

    @F.pandas_udf(BinaryType())
    def sparse(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            c = term_counts(t or b"")
            at = np.flatnonzero(c)
            out.append(np.stack([at, c[at]]).astype(np.float32).tobytes())
        return pd.Series(out, dtype=object)

    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` ids: small enough to broadcast
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "quality", sparse("text").alias("c")).orderBy(F.xxhash64("doc_id"), "doc_id", "c").limit(sample).collect()
    counts = np.zeros((len(rows), DIMS), np.float32)
    for i, r in enumerate(rows):
        at, c = np.frombuffer(r["c"], np.float32).reshape(2, -1)
        counts[i, at.astype(int)] = c
    return fit(counts, np.array([r["quality"] for r in rows], np.float32), rank, k)


def scored(docs: DataFrame, model: Model, score_col: str = "score") -> DataFrame:
    """Add the quality score to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            for i in range(0, len(texts), BLOCK):
                block = texts.iloc[i:i + BLOCK]
                out[i:i + BLOCK] = vote(shared.value, np.stack([term_counts(t or b"") for t in block]))
            yield pd.Series(out)
        give_back()

    return docs.withColumn(score_col, score(F.col("text").cast("binary")))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per document: held_out, score, predicted."""
    model = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, source: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; the model is learnt from the texts in ``source``."""
    rows = docs.select("text", F.struct("*").alias("row"))
    return scored(rows, train(source, labels)).where(F.col("score") >= threshold).select("row.*")
