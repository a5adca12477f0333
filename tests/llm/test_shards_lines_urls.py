import hashlib

import numpy as np
import pytest

from plansight.llm import bloom_cascade as bc
from plansight.llm import jump_shards as js
from plansight.llm import line_runs as lr


def jump_one(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64)
    for shards in (1, 2, 16, 17, 1000):
        assert js.jump(keys, shards).tolist() == [jump_one(int(k), shards) for k in keys]
    assert len(js.jump(keys[:0], 4)) == 0
    a, b = js.jump(keys, 16), js.jump(keys, 17)
    assert set(b[a != b]) <= {16}


def test_slots_with_nulls_ties_and_small_cells(spark, docs_of, monkeypatch):
    monkeypatch.setattr(js, "ROWS_PER_CELL", 3)
    rows = [(i % 40, "t" * (i % 3)) for i in range(200)] + [(None, None)] * 30 + [(7, "x" * 100_000)]
    docs = docs_of(rows)
    out = js.assign(docs, shards=4)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert js.report(docs_of([])).count() == 0
    none = js.report(docs_of([(None, None)])).first()
    assert (none["size"], none["text_crc32"], none["slot"]) == (1, 0, 0)


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), [])) >= min_docs and d != max((h for h in held[key(x)] if h is not None), default=None))]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_by_brute_force(spark, docs_of):
    common, short = "This line is in many Documents.", "short line"
    rows = [(i, f"{common}\nown line number {i} of this text\n{short}\n  \t{common.upper()}\x0b") for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, common), (23, common), (None, common + "\nleft over " + "z" * 50_000),
             (24, "É" * 20), (25, "é" * 20), (26, "É" * 20), (27, "É" * 20 + " "), (28, "É" * 20)]
    got = lr.report(docs_of(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_lines(rows)
    assert lr.report(docs_of([])).count() == 0


def test_runs_are_compacted(spark, docs_of, tmp_path):
    rows = [(i, "\n".join(f"line {j:03d} with enough characters" for j in range(i % 5, 12))) for i in range(40)]
    hashed = docs_of(rows).select("doc_id", lr.line_hashes(lr.F.col("text"), 20).alias("lines"))
    index = lr.index_lines(hashed, str(tmp_path / "runs"), batches=5, fanout=2)
    assert all(len(level) < 2 for level in index.levels)
    lines = index.lines().collect()
    assert len(lines) == 12 and sum(r["docs"] for r in lines) == sum(12 - i % 5 for i in range(40))
    assert all(r["new"] for r in lines)


URLS = [(1, "http://a.example.net/en/x?y"), (2, "https://EXAMPLE.net/de/"), (3, "ftp://example.net"), (4, None), (5, "no scheme/net/"),
        (6, "http://x.org/fr/1#z"), (7, "http://x.org/frz"), (8, "http://notexample.com/de/"), (9, "http://www.example.com/de/a"),
        (10, "http://net/"), (11, "://net/a"), (12, "http://net?/x"), (13, "http:///path"), (14, "http://a.net/" + "x/" * 20_000),
        (15, ".".join(["http://a"] + ["b"] * 500) + ".net/q"), (16, ""), (16, ""), (17, "http://h.net/en/#http://example.net/en/")]


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = rest.split("#")[0].split("?")[0]
    host = rest.split("/")[0].translate({c: c + 32 for c in range(65, 91)})
    path = rest[len(host):]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else default


@pytest.mark.parametrize("rules", [bc.RULES, (), tuple(bc.Rule("block" if i % 2 else "allow", f"h{i}.net", "/" + "p" * (i % 4)) for i in range(60)) + bc.RULES])
def test_cascade_is_exact(spark, rules):
    urls = URLS + [(100 + i, f"http://s{i % 3}.h{i % 90}.net/{'p' * (i % 6)}") for i in range(400)]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "'x' AS key", "'y' AS host")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in bc.judge(pages, rules).collect()}
    assert got == {(i, *brute_url(u, rules)) for i, u in urls}


def test_cascade_levels_alternate(spark, monkeypatch):
    monkeypatch.setattr(bc, "BITS_PER_KEY", 2)  # many false positives, so several levels
    universe = spark.range(3000).selectExpr("concat('k', id) AS key")
    listed = universe.limit(300).unionByName(spark.sql("SELECT 'never asked' AS key"))
    levels = bc.build_cascade(listed, universe, 1)
    assert len(levels) > 2
    yes = {r["key"] for r in universe.where(bc.contains(levels, bc.F.col("key"))).collect()}
    assert yes == {r["key"] for r in listed.collect()} - {"never asked"}


def test_no_pages(spark):
    assert bc.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
