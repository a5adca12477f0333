"""Registered queries against their DuckDB SQL, and the contracts of those without SQL."""

import zlib

import pytest

from plansight.llm.queries import ORACLES, QUERIES
from tools.oracle_check import duck, rows_of

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    res = duck(SMALL).execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_shards_follow_the_jump_law(spark):
    rows = QUERIES["op4_jump_shards"](spark, SMALL).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in rows:
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        assert r["size"] == len(text[r["doc_id"]].encode()) + 1
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
