"""Appends over restarts, compaction, and scans that open only what they need."""

import datetime as dt

from pyspark.sql import functions as F

from plansight.sources import event_store as S
from plansight.streaming import jobs as J

SCHEMA = "event_id long, repo_id long, received_at timestamp_ntz"
T0 = dt.datetime(2024, 3, 1)


def land(spark, path, days, n=40):
    rows = [(1000 * d + i, i % 4, T0 + dt.timedelta(days=d, minutes=30 * i)) for d in days for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.mode("append").parquet(path)
    return rows


def day(n):
    return F.lit((T0 + dt.timedelta(days=n)).date())


def scans(plan):
    """The file scans of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from scans(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from scans(plan.plan())
    elif name == "FileSourceScanExec":
        yield plan
    else:
        for i in range(plan.children().size()):
            yield from scans(plan.children().apply(i))


def opened(df):
    """Files that the scans of rows open (those of the list of compacted days read no column)."""
    df.collect()
    return sum(s.metrics().apply("numFiles").value() for s in scans(df._jdf.queryExecution().executedPlan())
               if "event_id" in s.schema().simpleString())


def got(df):
    return sorted((r["event_id"], r["repo_id"], r["received_at"]) for r in df.collect())


def test_store(spark, tmp_path):
    path, store = str(tmp_path / "land"), S.EventStore(spark, str(tmp_path / "store"), SCHEMA)
    assert store.scan().count() == 0 and store.files().count() == 0
    store.compact(day(9))  # nothing to compact
    rows = land(spark, path, range(6))
    store.append(J.file_stream(spark, path))
    rows += land(spark, path, range(5, 8), 30)  # day 5 again: more small files, restarted stream
    store.append(J.file_stream(spark, path))
    assert got(store.scan()) == sorted(rows)
    before = {r["date"]: r["n_files"] for r in store.files().collect()}

    store.compact(day(6))
    assert got(store.scan()) == sorted(rows)
    files = store.files().collect()
    closed = {r["date"]: r["n_files"] for r in files if r["part"] == "days"}
    assert sorted(closed) == [(T0 + dt.timedelta(days=d)).date() for d in range(6)]
    assert all(closed[d] < before[d] for d in closed)
    assert opened(store.scan()) < sum(before.values())
    once = sorted(store._read(store.days).inputFiles())
    store.compact(day(6))  # a day is compacted once
    assert sorted(store._read(store.days).inputFiles()) == once
    store.recompact(day(2), day(2))
    assert got(store.scan()) == sorted(rows) and len(set(once) & set(store._read(store.days).inputFiles())) >= len(once) - closed[day_of(2)]

    since = T0 + dt.timedelta(days=4, hours=3)
    cut = store.scan(since=F.lit(since), repos=[1, 3])
    assert got(cut) == sorted(r for r in rows if r[2] >= since and r[1] in (1, 3))
    assert opened(cut) <= opened(store.scan().where(F.col("date") >= day(4)))
    plan = cut._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(received_at" in plan

    newest = store.scan().agg(F.max("received_at")).scalar()  # the bound as a subquery prunes partitions too
    lazy = store.scan(since=newest - F.make_dt_interval(F.lit(1)))
    last = max(r[2] for r in rows)
    assert got(lazy) == sorted(r for r in rows if r[2] >= last - dt.timedelta(days=1))
    assert opened(lazy) <= before[day_of(6)] + before[day_of(7)]


def day_of(n):
    return (T0 + dt.timedelta(days=n)).date()


def test_windows_prune_dates_dynamically(spark, tmp_path):
    path, store = str(tmp_path / "land"), S.EventStore(spark, str(tmp_path / "store"), SCHEMA)
    rows = land(spark, path, range(8))
    store.append(J.file_stream(spark, path))
    store.compact(day(7))
    since = {0: T0 + dt.timedelta(days=6, hours=2), 2: T0 + dt.timedelta(days=7), 3: T0 + dt.timedelta(days=90), 9: T0}
    w = spark.createDataFrame(list(since.items()), "repo_id long, since timestamp_ntz").where("repo_id <> 9")
    out = store.windows(w)
    assert got(out) == sorted(r for r in rows if r[1] in (0, 2) and r[2] >= since[r[1]])
    plan = out._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan
    assert store.windows(w.limit(0)).count() == 0
