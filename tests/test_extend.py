"""2.11: a detector of one's own; A2 by sketches."""

import pytest
from pyspark.sql import functions as F

from plansight.operators import corpus as K
from plansight.operators import events as E
from plansight.sources.corpus import to_lines


def call(m):
    return m.select("repo", "path", "match_no", "line_no", F.lit("mutation").alias("type"),
                    F.when(F.col("g1") != "skip", F.col("g1")).alias("function_name"), F.array("g1").alias("entities"),
                    F.col("match").alias("trigger"), F.lit(0.9).alias("confidence"))


def test_registered_detector_joins_the_interactions(spark):
    content = "emit(first);\n// emit(second);\nconst s = 'emit(third)';\nemit(skip);\nemit(first);\nconst handleSave = () => {\n"
    files = spark.createDataFrame([("r", "src/a.ts", content), ("r", "src/b.md", "emit(first);")], "repo string, path string, content string")
    lines = to_lines(files)
    before = K.interactions(files, lines).collect()
    K.register_detector(K.Detector("emit", r"\bemit\((\w+)\)", call, (1,)))
    try:
        with pytest.raises(ValueError, match="already"):
            K.register_detector(K.Detector("emit", "x", call))
        with pytest.raises(ValueError, match="already"):
            K.register_detector(K.Detector("crud", "x", call))
        rows = K.interactions(files, lines).collect()
    finally:
        K.unregister_detector("emit")
    own = [(r["path"], r["line_no"], r["function_name"], r["confidence"]) for r in rows if r["type"] == "mutation"]
    assert own == [("src/a.ts", 1, "first", 0.9)]
    assert len(rows) == len(before) + 1 and len(K.interactions(files, lines).collect()) == len(before)


def test_sketches_merge_within_their_error(spark):
    e = spark.range(60_000).select((F.col("id") % 2).alias("repo_id"), F.concat(F.lit("n"), F.col("id") % 300).alias("event_name"),
                                   (F.col("id") % 20_000).alias("user_id"),
                                   F.timestamp_add("DAY", (F.col("id") % 10).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("received_at"))
    daily = E.daily_sketches(e)
    assert daily.count() == 10  # odd ids fall on odd days
    day = lambda n: F.lit(f"2024-01-{n:02d}").cast("date")
    for first, last in ((1, 10), (3, 3), (2, 6)):
        got = {r["repo_id"]: r for r in E.totals_of_range(daily, day(first), day(last)).collect()}
        exact = e.where(F.to_date("received_at").between(day(first), day(last))).groupBy("repo_id").agg(
            F.count("*").alias("n"), F.count_distinct("event_name").alias("names"), F.count_distinct("user_id").alias("users")).collect()
        assert len(got) == len(exact)
        for x in exact:
            r = got[x["repo_id"]]
            assert r["total_events"] == x["n"]
            assert abs(r["distinct_names"] - x["names"]) <= 3 * E.SKETCH_ERROR * x["names"] + 1
            assert abs(r["distinct_users"] - x["users"]) <= 3 * E.SKETCH_ERROR * x["users"] + 1
