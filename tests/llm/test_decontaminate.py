from collections import Counter

import numpy as np
import pytest

from plansight.llm import decontaminate as dc

ITEM = " ".join(f"item{i}" for i in range(40))
SHORT = "only three words"


def brute(docs, items, n=5, t=0.8):
    def bag(w):
        return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or Counter([tuple(w)] if w else [])
    out = {}
    for d, text in docs:
        w = dc.words_of(text)
        for i, item in items:
            v = dc.words_of(item)
            size = min(len(v), len(w))
            best = 0.0
            for a in range(len(w) - size + 1) if v and w else ():
                x, y = bag(w[a:a + size]), bag(v)
                low = sum((x & y).values())
                best = max(best, low / (sum(x.values()) + sum(y.values()) - low))
            if best >= t:
                out[d, i] = round(best, 9)
    return out


def edited(k):
    w = ITEM.split()
    for j in range(k):
        w[j * 7 % 40] = f"edit{j}"
    return " ".join(w)


DOCS = [(1, "intro " * 30 + ITEM + " outro" * 9), (2, ITEM.upper().replace(" ", ", ")), (3, "x " + edited(1) + " y"), (4, edited(2)), (5, edited(5)),
        (6, "he said " + SHORT + "!"), (7, SHORT), (8, None), (9, ""), (10, "a b"), (11, " ".join(ITEM.split()[:36])), (12, " ".join(ITEM.split()[:20])),
        (13, "the the the the the the the the the the"), (14, "long " * 60_000 + ITEM), (15, "only three"), (1, "intro " * 30 + ITEM)]
ITEMS = [(0, ITEM), (1, SHORT), (2, "the " * 12), (3, ""), (4, None), (5, "unrelated " + " ".join(f"u{i}" for i in range(25)))]


def tables(spark, docs_of):
    return docs_of(DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_windows_by_brute_force(spark, docs_of):
    docs, items = tables(spark, docs_of)
    got = dc.report(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in got} == brute([d for d in DOCS if d[0] != 14] + [(14, "long " * 60 + ITEM)], ITEMS)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert next(r for r in got if r["doc_id"] == 14)["start"] == 60_000


def test_benchmark_in_parts(spark, docs_of, monkeypatch):
    docs, items = tables(spark, docs_of)
    whole = {tuple(r) for r in dc.report(docs, items).collect()}
    monkeypatch.setattr(dc, "ITEMS", 4)
    assert {tuple(r) for r in dc.report(docs, items).collect()} == whole


def test_clean_documents_stay_whole(spark, docs_of):
    docs, items = tables(spark, docs_of)
    out = dc.clean_documents(docs, items)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {4, 5, 8, 9, 10, 12, 13, 15}
    assert dc.clean_documents(docs, items.limit(0)).count() == len(DOCS)
    assert dc.report(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("flips", [0, 5, 16, 23])
def test_multi_index_finds_all_within_the_radius(flips):
    rng = np.random.default_rng(flips)
    index = dc.build([(i, " ".join(f"w{i}_{j}" for j in range(30))) for i in range(50)], 5, 0.8)
    for k in range(50):
        bits = np.unpackbits(index.prints[k])
        bits[rng.permutation(64)[:flips]] ^= 1
        p = np.packbits(bits)
        near = np.zeros(50, bool)
        for b in range(dc.BLOCKS):
            near |= index.near[b][p[b]]
        assert near[k]
