"""Every registered query with oracle SQL equals DuckDB on the same parquet."""

import pytest

from plansight.plans import REGISTRY
from tools.oracle_check import duck, rows_of

from .conftest import SMALL

WITH_ORACLE = sorted(n for n, s in REGISTRY.items() if s.oracle)


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", WITH_ORACLE)
def test_query_matches_oracle(spark, con, name):
    spec = REGISTRY[name]
    sdf = spec.build(spark, SMALL)
    srows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(spec.oracle)
    dcols = [d[0] for d in res.description]
    drows = rows_of(dcols, res.fetchall())
    assert sorted(sdf.columns) == sorted(dcols)
    assert srows == drows


#: Queries without SQL: their columns, and whether the derived inputs reach them (their rules have unit tests).
ROWS_ONLY = {
    "context_lifecycles": (["repo", "object", "states"], False),
    "event_properties_from_code": (None, False),
    "export_agent_context": (None, True),
    "inferred_properties": (None, True),
    "pr_gap_report": (["repo", "pr", "rank", "n_more", "name", "path", "line_no", "priority"], True),
    "status_transition_locations": (["repo", "path", "line_no", "status", "pattern", "context"], False),
    "stream_sequence_timeout": (None, True),
}


def test_rows_only_queries_are_listed():
    assert sorted(ROWS_ONLY) == sorted(n for n, s in REGISTRY.items() if not s.oracle)


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries(spark, name):
    columns, reached = ROWS_ONLY[name]
    df = REGISTRY[name].build(spark, SMALL)
    rows = df.collect()
    assert columns is None or df.columns == columns
    assert bool(rows) == reached
    if name == "pr_gap_report":
        groups = {}
        for r in rows:
            groups.setdefault((r["repo"], r["pr"]), []).append(r["rank"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())
