import math
import re
from collections import Counter

import numpy as np

from plansight.llm import dual_tree as dt
from plansight.llm.topk import NONE, Best

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(dt.UPPER, dt.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    """The contract document by document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = [sum(b.values()) for _, b in bags]
    total, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in dict.fromkeys(i for i in items if i[1] is not None):
        scored = []
        for (doc_id, bag), x in zip(bags, n, strict=True):
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    * (10**9 * bag[t] // (1000 * bag[t] + 8 * (25 + 75 * x * total // words))) for t in terms(text) if t in bag)
            if s > 0 and doc_id is not None:
                scored.append((-s, doc_id))
        out += [(item_id, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs_of, docs, items):
    df = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS doc_id", "3 AS item")
    return sorted((tuple(r) for r in dt.rank(docs_of(docs), df).collect()), key=repr)


def words(rng, n, size):
    return " ".join(f"w{x}" for x in np.minimum(rng.zipf(1.3, n), size))


def test_equals_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(dt, "SLAB", 100)
    monkeypatch.setattr(dt, "DOC_LEAF", 4)
    monkeypatch.setattr(dt, "ITEM_LEAF", 2)
    monkeypatch.setattr(dt, "ITEMS", 9)  # several blocks
    monkeypatch.setattr(dt, "SEGMENT", 40)  # texts are counted in pieces
    rng = np.random.default_rng(8)
    docs = [(i, words(rng, int(rng.integers(1, 60)), 300)) for i in range(700)]
    docs[100:300] = [(i, docs[100][1]) for i, _ in docs[100:300]]  # copies: ties by id
    items = [(i, words(rng, 12, 300)) for i in range(30)] + [(40, docs[100][1])]
    want = brute(docs, items)
    assert got(spark, docs_of, docs, items) == want
    assert sorted(r[2] for r in want if r[0] == 40) == list(range(100, 110))


def test_edges(spark, docs_of):
    docs = [(1, None), (2, ""), (3, " .,-\x00\x7f"), (4, "Ünïcode ÄB a1 A1 x"), (5, "a1"), (5, "a1"), (None, "a1 zz"), (6, "ünïcode ünÏcode"),
            (7, "the " * 400_000 + "zz")]
    items = [(1, "a1 a1 ZZ"), (1, "a1 a1 ZZ"), (1, "Ünïcode"), (2, None), (3, ""), (None, "THE zz"), (4, "nowhere to be found"), (5, "x,x;x")]
    want = brute(docs, items)
    assert got(spark, docs_of, docs, items) == want
    assert {r[0] for r in want} == {1, None, 5} and all(r[2] is not None for r in want)
    assert sum(r[2] == 5 for r in want if r[0] == 1) == 2  # a repeated document is ranked twice
    assert got(spark, docs_of, docs[:3], items) == []
    assert got(spark, docs_of, [], items) == []
    assert got(spark, docs_of, docs, []) == []


def test_bounds_drop_whole_batches(monkeypatch):
    rng = np.random.default_rng(5)
    docs = [Counter({int(c) + 100 * (i % 8): int(x) for c, x in zip(rng.integers(0, 100, 30), rng.integers(1, 900_000, 30), strict=True)})
            for i in range(2000)]  # eight languages
    own = [Counter({int(c) + 100 * (i % 8): int(x) for c, x in zip(rng.integers(0, 100, 9), rng.integers(1, 9000, 9), strict=True)})
           for i in range(64)]
    m, d = dt.sparse(own, 800), dt.sparse(docs, 800)
    scored = []
    score = dt.Items.score
    monkeypatch.setattr(dt.Items, "score", lambda self, ids, docs_, rows, v, best: (
        scored.append(len(rows) * len(self.tree.rows(v))), score(self, ids, docs_, rows, v, best)))
    items, best = dt.Items(m, 10), Best(64, 10)
    items.search(np.arange(2000), d, best)
    for i, own_ in enumerate(own):  # every ranking is exact
        want = sorted((-sum(x * doc[c] for c, x in own_.items() if c in doc), j) for j, doc in enumerate(docs))[:10]
        kept = [(int(-s), int(j)) for s, j in zip(best.scores[i], best.ids[i], strict=True) if s != NONE]
        assert kept == [w for w in want if w[0] < 0]
    assert sum(scored) < 0.7 * 64 * 2000


def test_maxima_bound_their_rows():
    rng = np.random.default_rng(6)
    m = dt.sparse([{int(c): int(c) + i for c in rng.integers(0, 50, i % 9)} for i in range(333)], 50)
    tree = dt.Tree(m, 16, np.ones(50))
    assert sorted(tree.order.tolist()) == list(range(333))
    for node in range(1, 2 * tree.first):
        _, at = m.entries(tree.rows(node))
        true = np.zeros(50, np.int64)
        np.maximum.at(true, m.cols[at], m.values[at])
        assert (tree.top[node] == true).all()


def test_large_weights_stay_exact():
    m = dt.sparse([{0: 2**40, 1: 1}, {1: 3}], 2)
    items, best = dt.Items(m, 1), Best(2, 1)
    assert items.number is np.int64
    items.search(np.array([7, 8]), dt.sparse([{0: 99_999, 1: 5}, {0: 99_999, 1: 6}], 2), best)
    assert best.scores.tolist() == [[2**40 * 99_999 + 6], [18]] and best.ids.tolist() == [[8], [8]]
