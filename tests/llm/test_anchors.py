import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plansight.llm import anchors, exchange


def brute(rows, window):
    docs = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, docs, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "é", "x y", "Z"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(100, None), (101, ""), (102, "a " * 500), (103, "b " * 35), (104, "c " * 36), (None, "d " * 80), (105, rows[3][1]),
             (105, rows[3][1]), (106, " ".join(f"w{j}" for j in range(30_000)) + " " + " ".join(passages[3]))]
    return rows


@pytest.mark.parametrize("seed,chunk", [(1, 10_000_000), (2, 4_000)])
def test_repeats_by_brute_force(spark, docs_of, seed, chunk):
    rows = corpus(seed)
    out = anchors.remove_repeats(docs_of(rows), chunk_bytes=chunk).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out), key=str)
    assert got == brute(rows, 35)
    for r in out:
        assert sum(s["words"] for s in r["removed"]) == r["n_removed"] and all(s["words"] >= 35 for s in r["removed"])


def test_other_window(spark, docs_of):
    rows = [(1, "a b c d e f"), (2, "x b c d y"), (3, "q r")]
    got = anchors.remove_repeats(docs_of(rows), window=3).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {1: "a e f", 2: "x y", 3: "q r"}


def test_empty_table(spark, docs_of):
    assert anchors.report(docs_of([])).count() == 0


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(anchors, "SEGMENT", 16)
    texts = [b"one two  three", b"", b" \t", b"three two one " + b"y" * 5000 + b" one", b"oneone\x00 \x00"]
    h, bounds = anchors.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert [int(b) for b in np.diff(bounds)] == [len(t.split()) for t in texts]
    assert {(a == b) == (x == y) for a, x in zip(words, h, strict=True) for b, y in zip(words, h, strict=True)} == {True}


def test_packed_keys_round_trip():
    h = np.random.default_rng(3).integers(0, 2**64, 1000, dtype=np.uint64)
    keys = exchange.Keys.of(np.concatenate([h, h[:10]]), 7)
    assert (keys.values[keys.place] == np.concatenate([h, h[:10]])).all() and keys.many.sum() == 10
    for _, s in keys.slices():
        v = keys.values[s]
        assert (exchange.unpack(exchange.pack(v, 8), len(v), 8) == v).all()
        assert (exchange.unpack(exchange.pack(v, 5), len(v), 5) == v >> np.uint64(24) << np.uint64(24)).all()
    assert exchange.unflags(exchange.flags(keys.many), len(keys.many)).tolist() == keys.many.tolist()
