import numpy as np
import pytest

from plansight.llm import str_negatives as sn
from plansight.llm.topk import NONE, Best

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA)


def brute(rows):
    """The contract, pair by pair, in Python integers."""
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * x)) for x in v]) for i, v, lab in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, q in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, lb) for j, lb, v in ok if len(v) == len(q))
        for s, p, _ in [r for r in scored if r[2] == lab and r[1] != i][:5]:
            near = [r for r in scored if r[2] != lab and -30 * s <= -100 * r[0] <= -90 * s][:10]
            out += [(i, p, k, r[1], -s, -r[0]) for k, r in enumerate(near, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sn, "SLAB", 300)
    monkeypatch.setattr(sn, "LEAF", 8)
    monkeypatch.setattr(sn, "FAN", 3)
    monkeypatch.setattr(sn, "BLOCK", 64 * 4)  # several blocks of anchors
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 9))
    rows = [(i, (centres[i % 6] + 0.4 * rng.standard_normal(9)).tolist(), int(rng.integers(0, 4))) for i in range(1200)]
    rows[200:500] = [(i, rows[200][1], lab) for i, _, lab in rows[200:500]]  # a group of copies: ties by id
    assert got(sn.report(frame(spark, rows))) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 3), (1, [1.0, 0.5], 4), (2, [0.5, 0.5], 0), (3, None, 4), (4, [nan, 1.0], 4), (5, [inf, 1.0], 0),
            (6, [None, 1.0], 0), (8, [0.5], 4), (9, [0.5, 0.5], None), (10, [], 4), (None, [0.5, 0.5], 0), (11, [-0.001, 0.0], 4),
            (100, [0.0, 0.0], 5), (101, [1.0, 1.0], 5), (200, [-1.0, 0.0], 6), (201, [1.0, 0.0], 6), (300, [], 4), (301, [], 4),
            (302, [], 5)]
    want = brute(rows)
    assert {r[0] for r in want} == {0, 100, 300}  # 0 changes its label to 4; the one positive of 200 is negative
    assert got(sn.report(frame(spark, rows))) == want
    assert got(sn.report(frame(spark, rows).where("vec_id = 2"))) == []
    assert got(sn.report(frame(spark, rows).limit(0))) == []


def test_repeated_rows_and_large_components(spark):
    rows = [(100, [2.0, 1.0], 1), (100, [2.0, 1.0], 1), (1, [2.0, 1.0], 1), (1, [2.0, 1.0], 1), (2, [1.0, 0.0], 2), (2, [1.0, 0.0], 2),
            (3, [5e6, 1.0], 1), (4, [4e6, -3.0], 2), (5, [1e300, 0.0], 2)]
    have = got(sn.report(frame(spark, rows)))
    ok = [r for r in rows if r[0] != 5]  # its scores would leave 64 bits
    assert have == brute(ok) and len(have) > 0


def test_boxes_drop_leaves(monkeypatch):
    monkeypatch.setattr(sn, "LEAF", 16)
    rng = np.random.default_rng(4)
    x = (np.eye(8)[np.arange(2000) % 8] * 200 + rng.integers(-9, 10, (2000, 8))).astype(np.int32)
    slab = sn.Slab.pack(np.arange(2000), np.zeros(2000, np.int64), x)
    seen = []
    leaf = sn.Anchors.leaf
    monkeypatch.setattr(sn.Anchors, "leaf", lambda self, s, node, *a: (seen.append(node), leaf(self, s, node, *a)))
    low, high = (np.full((1, 1), v, np.int64) for v in sn.ANY)
    best = Best(1, 5)
    sn.Anchors(np.array([0]), np.array([0]), x[:1], low, high, True).search(slab, best)
    true = x[1:].astype(np.int64) @ x[0]
    assert best.scores[0].tolist() == sorted(true.tolist(), reverse=True)[:5]
    assert len(seen) < len(slab.starts) / 2
    none = Best(1, 5)  # a window that no box meets reads no leaf
    seen.clear()
    sn.Anchors(np.array([0]), np.array([0]), x[:1], low * 0 + 10**9, high, True).search(slab, none)
    assert not seen and (none.scores == NONE).all()


@pytest.mark.parametrize("n,d", [(1, 3), (130, 1), (1000, 64), (1000, 2), (257, 0)])
def test_leaves_hold_every_row_once(n, d):
    x = np.random.default_rng(n).integers(-50, 50, (n, d)).astype(np.int32)
    slab = sn.Slab.pack(np.arange(n), np.arange(n), x)
    assert sorted(slab.ids.tolist()) == list(range(n)) and (slab.x == x[slab.ids]).all()
    ends = np.append(slab.starts[1:], n)
    assert (ends - slab.starts <= sn.LEAF).all() and (ends > slab.starts).all()
    for lo, hi in slab.levels()[-1:]:
        assert len(lo) == 1 and (lo[0] <= x).all() and (hi[0] >= x).all()
