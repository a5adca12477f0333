"""ST7: the live contract check over restarts, replays and odd rows."""

import datetime as dt

from plansight.operators import contracts as C
from plansight.streaming import jobs as J
from plansight.streaming import live_contracts as L

EVENT = "event_id long, repo_id long, event_name string, properties string, received_at timestamp_ntz, event_ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def dims(spark):
    plan = spark.createDataFrame([(0, "View"), (0, "buy"), (1, "view")], "repo_id int, name string")
    props = spark.createDataFrame([("view", "k", "number", True, False), ("VIEW", "day", "date", False, False), ("buy", "id", "string", True, True),
                                   ("buy", "it's", "string", True, False)],
                                  "event_name string, prop string, type string, required boolean, todo boolean")
    return plan, props


def events(spark, rows):
    return spark.createDataFrame([(i, r, n, p, T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i - late)) for i, r, n, p, late in rows], EVENT)


FIRST = [(1, 0, "view", '{"k": 1}', 0), (2, 0, "view", '{"k": "1"}', 0), (3, 0, "View", "{}", 2), (4, 2, "view", '{"k": 1, "day": 3}', 0)]
SECOND = [(5, 0, "buy", '{"id": 3}', 0), (6, 1, "buy", None, 5), (7, None, "nothing", "not json", 0), (8, 1, "view", '{"k": 2, "day": "x"}', 0)]
UNPLANNED = {3, 4, 6, 7}  # 3: event names are matched as sent, plan names in lower case


def found(spark, sink):
    rows = L.read_findings(spark, sink).collect()
    return ({r["event_id"] for r in rows if r["kind"] == "unplanned"},
            sorted((r["event_id"], r["prop"], r["declared_type"], r["actual_type"] or "", r["violation"]) for r in rows if r["kind"] == "violation"))


def batch_rules(spark, rows, props):
    return sorted((r["event_id"], r["prop"], r["declared_type"], r["actual_type"] or "", r["violation"])
                  for r in C.contract_violations(events(spark, rows), props).collect())


def test_restarted_stream_equals_the_batch_check(spark, tmp_path):
    plan, props = dims(spark)
    land, (sink, ck) = str(tmp_path / "land"), J.new_location(spark, "live-test")
    for rows in (FIRST, SECOND):
        events(spark, rows).write.mode("append").parquet(land)
        L.watch(J.file_stream(spark, land, max_files=1), plan, props, sink, ck)
    L.watch(J.file_stream(spark, land), plan, props, sink, ck)  # nothing new
    unplanned, broken = found(spark, sink)
    assert unplanned == UNPLANNED
    assert broken == batch_rules(spark, FIRST + SECOND, props)
    assert {b[4] for b in broken} == {"missing", "type_mismatch"} and {b[1] for b in broken} == {"k", "day", "id", "it's"}
    seen = L.read_arrivals(spark, sink).groupBy().sum("n_events", "n_late").first()
    assert tuple(seen) == (8, 2)
    assert L.read_arrivals(spark, sink).select("batch_no").distinct().count() > 1


def test_replayed_batch_writes_the_same_rows(spark):
    plan, props = dims(spark)
    sink, _ = J.new_location(spark, "replay-test")
    write = L.write_batch(L.Contract.of(plan, props), sink, "1 HOUR")
    write(events(spark, FIRST), 0)
    write(events(spark, SECOND), 1)
    once = found(spark, sink)
    write(events(spark, SECOND), 1)
    assert found(spark, sink) == once
    assert L.read_arrivals(spark, sink).count() == 2


def test_no_events_and_no_rules(spark):
    plan, props = dims(spark)
    sink, _ = J.new_location(spark, "empty-test")
    L.write_batch(L.Contract.of(plan, props), sink, "1 HOUR")(events(spark, []), 0)
    assert L.read_findings(spark, sink).count() == 0 and L.read_arrivals(spark, sink).count() == 0
    sink, _ = J.new_location(spark, "bare-test")
    L.write_batch(L.Contract.of(plan.limit(0), props.limit(0)), sink, "1 HOUR")(events(spark, FIRST), 0)
    assert found(spark, sink) == ({1, 2, 3, 4}, [])
