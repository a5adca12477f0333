from collections import defaultdict
from fractions import Fraction

import pytest

from plansight.llm import apportion as ap


def brute(votes, seats):
    got = [0] * len(votes)
    for _ in range(seats):
        best = max((i for i in range(len(votes)) if votes[i] > 0), key=lambda i: (Fraction(votes[i]) / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("votes,seats", [([53, 24, 23], 7), ([1, 1, 1], 2), ([0, 5], 3), ([10, 7, 7, 3, 1], 40), ([5], 0),
                                         ([1000, 1, 1], 9), ([3, 3, 3, 3], 6)])
def test_highest_quotients(votes, seats):
    assert ap.sainte_lague([float(v) for v in votes], seats) == brute(votes, seats)


def test_targets_stop_and_reshare():
    assert ap.targets([10, 10, 80], [5, 2, 1], 150, 2) == [20, 20, 110]
    assert ap.targets([100, 100], [1, 1], 300, 2) == [150, 150]
    assert ap.targets([], [], 0, 2) == []
    assert ap.targets([0, 10], [5, 1], 15, 2) == [0, 15]


def test_quotas_add_up_per_shard():
    for s in ap.quotas([("a", 6400), ("b", 640), (None, 64)], [5, 2, 1], shards=4):
        assert sum(s.quotas) == s.seats and min(s.quotas) >= 0


ROWS = [(1, "a b c " * 50, "x"), (2, "", "x"), (3, None, "y"), (4, "one", None), (5, "w " * 3000, "y"), (5, "w " * 3000, "y"),
        (None, "q r", "z"), (6, "\x0b \t", "z"), (7, "é è ok", "é")]


def test_mix_contract(spark, docs_of):
    docs = docs_of(ROWS)
    rows = ap.mix_report(docs, block=4).collect()
    again = ap.mix_report(docs.repartition(5), block=4).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert len(rows) == len(ROWS)
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    by_id = {r[0]: (r[2], len((r[1] or "").encode().split())) for r in ROWS}
    for r in rows:
        source, size = by_id[r["doc_id"]]
        assert r["size"] == size and 0 <= r["taken"] <= 2 * size
        sizes[source] += size
        taken[source] += r["taken"]
        goal[source] = r["target"], r["source_size"]
    want = ap.targets([sizes[s] for s in ("x", "y", "z", "é", None)], [5, 2, 1, 5, 2], 1.5 * sum(sizes.values()), 2)
    for s, t in zip(("x", "y", "z", "é", None), want, strict=True):
        assert goal[s] == (pytest.approx(t), sizes[s])
        assert abs(taken[s] - t) <= 8


def test_mixed_documents_hold_what_is_taken(spark, docs_of):
    docs = docs_of(ROWS)
    rows = ap.mixed_documents(docs, block=4)
    assert rows.columns == docs.columns
    words = defaultdict(int)
    for r in rows.collect():
        assert r["start"] == "x"
        words[r["doc_id"]] += len(r["text"].encode().split())
    taken = defaultdict(int)
    for r in ap.mix_report(docs, block=4).collect():
        taken[r["doc_id"]] += r["taken"]
    assert dict(words) == {k: v for k, v in taken.items() if v}


def test_empty_table(spark, docs_of):
    assert ap.mix_report(docs_of([])).count() == 0
    assert ap.mixed_documents(docs_of([])).count() == 0


def test_table_of_sources_starts_no_python_workers(spark):
    """Workers that a list of rows needs would stay beside those of the next stages."""
    numbers = [(None, 1 << 40, 2.5, 3, 4, 5, 6, 7), ("é", 0, 0.0, 0, 0, 1, 0, 0)]
    table = ap.shares_table(spark, numbers)
    lineage = table._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" not in lineage and [tuple(r) for r in table.collect()] == numbers
    assert ap.shares_table(spark, []).count() == 0
