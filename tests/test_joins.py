"""J10 and J18 without theta joins or fixed depths, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from plansight.operators import contracts as C
from plansight.operators import graph as G


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_names_equal_brute_force(spark, k):
    rng = random.Random(k)
    word = lambda: "".join(rng.choices("abC_", k=rng.choice([0, 1, 2, 4, 5, 7, 9, 12])))
    plan = [(r, word(), o) for r in (0, 1) for o in range(60)]
    names = sorted({(r, word()) for r in (0, 1, 2) for _ in range(150)} | {(r, n[:3] + "b" + n[3:]) for r, n, _ in plan})
    p = spark.createDataFrame(plan, "repo_id int, name string, ord int")
    u = spark.createDataFrame(names, "repo_id int, name string")
    out = C.nearest_names(u, p, k)
    got = {(r["repo_id"], r["name"]): (r["suggestion"], r["distance"]) for r in out.collect()}
    for r, n in names:
        near = sorted((levenshtein(n.lower(), q.lower()), o, q) for rr, q, o in plan if rr == r)
        want = (near[0][2], near[0][0]) if near and near[0][0] <= k else (None, None)
        assert got[(r, n)] == want, (r, n)
    text = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_join_paths_are_shortest_and_first(spark):
    rng = random.Random(5)
    edges = list({(f"N{rng.randint(0, 11)}", f"N{rng.randint(0, 11)}") for _ in range(26)})
    rel = spark.createDataFrame([("r", a, b, i) for i, (a, b) in enumerate(edges)], "repo string, child string, parent string, ord int")
    for hops in (1, 3, None):
        best = {}
        paths = [((a, b), (i,)) for i, (a, b) in enumerate(edges)]
        for _ in range(hops or 12):
            for (a, b), o in paths:
                if (a, b) not in best or len(o) == len(best[(a, b)]) and o < best[(a, b)]:
                    best[(a, b)] = o
            paths = [((a, y), (*o, i)) for (a, b), o in paths if best[(a, b)] == o for i, (x, y) in enumerate(edges) if x == b]
        got = {(r["from"], r["to"]): tuple(r["ords"]) for r in G.join_paths(rel, ["repo"], hops).collect()}
        assert got == best


def test_cyclic_graph_ends(spark):
    """10^5 edges in rings of five, walked to the end."""
    n = 100_000
    rel = spark.range(n).select(F.concat(F.lit("N"), "id").alias("child"), F.concat(
        F.lit("N"), F.col("id") - F.col("id") % 5 + (F.col("id") + 1) % 5).alias("parent"), F.col("id").alias("ord"))
    out = G.join_paths(rel, max_hops=None)
    assert [tuple(r) for r in out.groupBy("hops").count().orderBy("hops").collect()] == [(h, n) for h in range(1, 6)]


def test_schema_match_equals_brute_force(spark):
    from plansight.operators import synthesis as Y
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abA_", k=rng.choice([0, 1, 2, 3, 4, 6])))
    ents, objs = [(r, word()) for r in ("r", "s") for _ in range(70)] + [("r", None)], [(r, word(), i) for r in ("r", "t") for i in range(70)]
    out = Y.schema_candidates(spark.createDataFrame(ents, "repo string, entity string"), spark.createDataFrame(objs, "repo string, name string, ord int"))
    got = {(r["repo"], r["entity"], r["_oo"]) for r in out.collect()}
    flat = lambda x: x.replace("_", "").lower()
    want = {(r, e, i) for r, e in ents for rr, o, i in objs if r == rr and e is not None and (
        flat(e) == flat(o) or min(len(flat(e)), len(flat(o))) >= 3 and (flat(e) in flat(o) or flat(o) in flat(e)))}
    assert got == want
    text = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
