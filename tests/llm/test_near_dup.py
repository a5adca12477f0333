import random

import numpy as np
import pandas as pd
import pytest

from plansight.llm import near_dup as nd
from plansight.llm.components import connected


def sets(rows, k):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(rows, k, percent):
    s, ids = sets(rows, k), [r[0] for r in rows]
    comp = {i: i for i in ids}
    root = lambda i: i if comp[i] == i else root(comp[i])
    for x in range(len(rows)):
        for y in range(x):
            both = len(s[x] & s[y])
            if s[x] and s[y] and 100 * both >= percent * (len(s[x]) + len(s[y]) - both):
                a, b = sorted((root(ids[x]), root(ids[y])))
                comp[b] = a
    return {(i, len(s[x]), root(i), root(i) == i) for x, i in enumerate(ids)}


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows, base = [], [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 90))] for _ in range(6)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i * 7 % n, rng.choice([" ", "\n"]).join(x.upper() if rng.random() < 0.3 else x for x in w)))
    chain = [f"c{j}" for j in range(60)]  # each link holds, the ends do not
    rows += [(500 + j, " ".join(chain[j * 3:j * 3 + 40])) for j in range(7)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "single"), (904, "SINGLE"), (905, "other"),
                   (906, "long " + " ".join(f"z{j}" for j in range(20_000)))]


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 5)])
def test_links_by_brute_force(spark, docs_of, seed, k):
    rows = corpus(seed)
    got = nd.report(docs_of(rows), k=k).collect()
    assert {tuple(r) for r in got} == brute(rows, k, 80) and len(got) == len(rows)


def test_large_group_of_near_copies_and_copies(spark, docs_of):
    base = [f"w{j}" for j in range(120)]
    rows = [(i, " ".join([*base[:i % 60], f"edit{i}", *base[i % 60:]])) for i in range(150)] + [(1000 + i, " ".join(base)) for i in range(150)]
    got = nd.report(docs_of(rows)).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_one_of_each_keeps_columns_null_ids_and_empty_texts(spark, docs_of):
    rows = [(3, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (8, ""), (9, ""), (10, None), (4, "h i j k l m")]
    docs = docs_of(rows)
    out = nd.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [10, 2, 4, 8, 9, None]
    null = [r for r in nd.report(docs).collect() if r["doc_id"] is None]
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in null] == [(6, None, True)]


def test_repeated_rows_and_empty_table(spark, docs_of):
    got = nd.report(docs_of([(1, "a b c"), (1, "a b c"), (2, "d e f")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 2)]
    assert nd.report(docs_of([])).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 100)] + [(200, 300), (300, 250), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 250: 200, 300: 200}


def test_posterior_bounds_prune_far_pairs_only():
    steps = nd.least_matches(80)
    assert [n for n, _ in steps] == [32, 64, 96, 128]
    assert all(0 < m < 0.8 * n for n, m in steps)


@pytest.mark.parametrize("n", [100, 1000, 5000])
def test_unrelated_sets_of_any_size_are_pruned_and_near_ones_are_not(n):
    rng = np.random.default_rng(n)
    some = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    left, far, near = [], [], []
    for _ in range(40):
        x = some(n)
        left.append(nd.signature_bytes(nd.signature(x)))
        far.append(nd.signature_bytes(nd.signature(some(n))))
        near.append(nd.signature_bytes(nd.signature(np.concatenate([x[n // 10:], some(n // 10)]))))  # similarity 0.82
    test = nd.plausible(80).func
    assert not test(pd.Series(left), pd.Series(far)).any()
    assert test(pd.Series(left), pd.Series(near)).all()


def test_odd_sketch_never_overstates_the_difference():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (1, 0), (40, 5), (300, 60), (6000, 900)):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[m // 2:], rng.integers(0, 1 << 63, m // 2, dtype=np.uint64)])
        bits = sum((a ^ b).bit_count() if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count()
                   for a, b in zip(nd.odd_sketch(x), nd.odd_sketch(y), strict=True))
        assert bits <= len(np.setxor1d(x, y))
        assert m > 60 or bits >= 0.8 * len(np.setxor1d(x, y))


def test_hub_of_a_family_is_its_original(spark, docs_of):
    """Copies that are close to the original and not to each other are linked through it: no pair is left over."""
    base = [f"w{j}" for j in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for j in range(8):
            w[(i * 3 + j * 23) % 200] = f"u{i}-{j}"
        rows.append((i, " ".join(w)))
    calls = []
    real = nd.leftovers
    nd.leftovers = lambda *a: calls.append(real(*a))
    try:
        got = {tuple(r) for r in nd.report(docs_of(rows)).collect()}
    finally:
        nd.leftovers = real
    assert got == brute(rows, 2, 80) and calls == [None]


def test_family_with_many_unlinked_members(spark, docs_of):
    """Variants of one original: most are linked, some only with each other, some with nobody."""
    rng = random.Random(9)
    base, rows = [f"w{j}" for j in range(100)], []
    for i in range(220):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 8, 11, 14])):
            w[rng.randrange(100)] = rng.choice([f"u{rng.randrange(10**6)}", f"e{rng.randrange(30)}"])
        rows.append((i, " ".join(w)))
        if rng.random() < 0.15:
            w[rng.randrange(100)] = "twin"
            rows.append((1000 + i, " ".join(w)))
    expected = brute(rows, 2, 80)
    assert 5 < len({r[2] for r in expected}) < 150
    assert {tuple(r) for r in nd.report(docs_of(rows)).collect()} == expected


def test_long_texts_reach_workers_in_small_batches(spark, tmp_path):
    """30 texts of 1 MB are several batches, not one; the session's own setting comes back."""
    import pyarrow as pa

    from plansight.session import BATCH_BYTES
    before = spark.conf.get(BATCH_BYTES)
    docs = spark.range(0, 30, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id % 10 AS string), 1000000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], names=["n"])

    got = nd.written(docs.mapInArrow(sizes, "n long"), str(tmp_path / "sizes")).agg({"n": "max"}).first()[0]
    assert got < 2 * nd.GROUP_BYTES
    assert spark.conf.get(BATCH_BYTES) == before
