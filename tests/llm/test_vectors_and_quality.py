import numpy as np
import pytest

from plansight.llm import forest_ann as fa
from plansight.llm import knn_quality as kq
from plansight.llm.queries import QUERIES


def brute(ids, x, k=5):
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        rest = np.flatnonzero(ids != ids[i])
        cos = fa.cosines(x[rest], x[i])
        top = np.lexsort((ids[rest], -cos))[:k]
        out[int(ids[i])] = [(int(ids[rest[j]]), float(cos[j])) for j in top]
    return out


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(fa, "SLAB", 700)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24))
    x[100:160] = x[100]  # copies
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank int")
    got, true = {}, brute(ids, x)
    for r in fa.report(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert all(len(v) == 5 and v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in true[q]}) for q in true)
    assert hit >= 0.9 * 5 * len(true)
    assert [a for a, _ in got[100]] == [101, 102, 103, 104, 105] and [a for a, _ in got[150]] == [100, 101, 102, 103, 104]


def test_unusable_and_few_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (8, [1.0, 0.0, 0.0]), (50, [0.0, 0.0]), (100, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in fa.report(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert fa.report(df.where("vec_id = 3")).count() == 0
    assert fa.report(df.limit(0)).count() == 0


def test_forest_descends_to_the_longest_prefix():
    x = np.random.default_rng(2).standard_normal((400, 16))
    slab = fa.Slab(np.arange(400), x, 5)
    strings = fa.hash_strings(x[:9], 5)
    counts = slab.counts(strings)
    assert (counts[:, 0] == 400 * fa.TREES).all() and (np.diff(counts, axis=1) <= 0).all() and (counts[:, fa.BITS] >= fa.TREES).all()
    for level in (0, 3, 9):
        for q, rows in slab.candidates(strings, np.full(9, level)):
            same = ((slab.keys >> (fa.BITS - level)) == (strings[:, q, None] >> (fa.BITS - level))).any(axis=0)
            assert rows.tolist() == np.flatnonzero(same).tolist()
    assert slab.depth(strings[:, 0], 0) == fa.BITS


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op10_knn_quality"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    right = [rows[r["doc_id"]]["predicted"] == r["quality"] for r in labels]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert len(rows) == 1000


GOOD = "Some plain sentence about the weather and the sea, number %d of them."
BAD = "buy%%%% now### win$$$ %d click&&& here*** free%%%%"


def labelled(spark, docs_of):
    docs = docs_of([(i, (GOOD if i % 3 else BAD) % i) for i in range(90)] + [(900, None), (901, ""), (902, "ab"), (None, GOOD % 5),
                                                                                 (903, BAD % 7 + "x" * 200_000), (5, GOOD % 5)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(90)] + [(1, None, 0), (None, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_edges(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    rows = kq.report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] < 90:
            assert r["predicted"] == int(r["doc_id"] % 3 > 0)
    prior = {r["score"] for r in rows if r["doc_id"] in (900, 901, 902)}
    assert len(prior) == 1 and 0.5 < prior.pop() < 0.8
    kept = kq.good_documents(docs, docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(90) if i % 3}
    assert kq.report(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in kq.report(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded(spark, docs_of):
    docs, labels = labelled(spark, docs_of)
    assert len(kq.train(docs, labels, sample=10).labels) == 10
    with pytest.raises(ValueError):
        kq.vote(kq.train(docs, labels, sample=10), np.zeros((2, 3), np.float32))


def test_cosines_of_very_large_and_very_small_vectors(spark):
    rows = [(50, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e200, 0.0]), (3, [1e-200, -1e-200]), (4, [5e-324, 5e-324])]
    got = {r["vec_id"]: r["score"] for r in fa.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: pytest.approx(1), 4: pytest.approx(1), 2: pytest.approx(0.5 ** 0.5), 3: pytest.approx(0, abs=1e-12)}
    x = np.random.default_rng(2).standard_normal((50, 64))
    assert (fa.cosines(fa.scaled(x), fa.scaled(x[:1])[0]) == fa.cosines(x, x[0])).all()
