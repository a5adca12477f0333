"""ST11: concurrent writers lose nothing, compaction changes no result."""

import threading

import pytest

from plansight.operators import feedback as FB
from plansight.streaming import feedback_log as FL


def facts(spark, rows):
    return spark.createDataFrame([("r", n, v, pr, "p", s) for n, v, pr, s in rows], FL.FACTS)


def got(df):
    return sorted(tuple(r) for r in df.select("repo", "event_name", "n_accepted", "n_rejected", "last_pr").collect())


def test_concurrent_writers_and_compaction(spark, tmp_path):
    log = FL.FeedbackLog(spark, str(tmp_path / "log"))
    assert got(log.state()) == []
    parts = [[(n, v, w * 10 + i, 100 * i + w) for i, (n, v) in enumerate([("Buy", "accepted"), ("buy", "rejected"), ("view", "accepted")])] for w in range(4)]
    threads = [threading.Thread(target=lambda w=w, p=p: log.append(facts(spark, p), f"w{w}")) for w, p in enumerate(parts)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    whole = got(FB.feedback_state(facts(spark, [r for p in parts for r in p])))
    assert got(log.state()) == whole and len(whole) == 2
    assert log.compact() == 1 and got(log.state()) == whole
    log.append(facts(spark, [("view", "rejected", 99, 10_000)]), "late")
    log.append(facts(spark, parts[0]), "w0")  # a batch that is run again, already compacted
    more = got(FB.feedback_state(facts(spark, [r for p in parts for r in p] + [("view", "rejected", 99, 10_000)])))
    assert got(log.state()) == more
    assert log.compact() == 2 and got(log.state()) == more
    assert log.compact() == 3 and got(log.state()) == more


def test_two_compactors_of_one_version(spark, tmp_path):
    log = FL.FeedbackLog(spark, str(tmp_path / "log"))
    log.append(facts(spark, [("a", "accepted", 1, 1)]), "x")
    assert log.compact() == 1
    number, _, state = log._merged()
    assert number == 1
    spark.createDataFrame([("r", "a", 1, 0, 1, 1, None)], FL.STATE).write.parquet(f"{log.root}/versions/id=2")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        state.write.mode("errorifexists").parquet(f"{log.root}/versions/id=2")
