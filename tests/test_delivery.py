"""ST9: a failing destination leaves the others complete, and replay delivers exactly once."""

from plansight.streaming import delivery as DL
from plansight.streaming import jobs as J

SCHEMA = "request_id string, pos int, repo_id long, event_name string, message_id string, payload string, destination string"


def payloads(spark, ids, destinations=("a", "b", "c")):
    return spark.createDataFrame([(f"r{i}", 0, 1, "e", f"{d}{i}", "{}", d) for i in ids for d in destinations], SCHEMA)


def got(df):
    return sorted((r["destination"], r["message_id"]) for r in df.collect())


def test_one_failure_is_isolated_and_replayed_once(spark, tmp_path):
    down, calls = {"b"}, []

    def sender(name):
        def send(rows, path):
            calls.append(name)
            if name in down:
                rows.limit(1).write.mode("overwrite").parquet(path + "/part")  # leaves something behind, then fails
                raise ConnectionError("refused")
            DL.to_folder(rows, path)
        return send

    land, root = str(tmp_path / "land"), str(tmp_path / "out")
    d = DL.Delivery(spark, root, {n: sender(n) for n in "ab"})  # nobody serves c
    for ids in ([1, 2], [3]):
        payloads(spark, ids).write.mode("append").parquet(land)
        d.run(J.file_stream(spark, land), str(tmp_path / "ck"))
    assert got(d.delivered()) == [("a", "a1"), ("a", "a2"), ("a", "a3")]
    dead = d.dead_letters().collect()
    assert sorted((r["destination"], r["message_id"]) for r in dead) == [(x, f"{x}{i}") for x in "bc" for i in (1, 2, 3)]
    assert {r["error"].split(":")[0] for r in dead} == {"ConnectionError", "KeyError"}

    assert d.replay() == 4  # still down: two batches of b and c
    assert got(d.dead_letters()) == [(x, f"{x}{i}") for x in "bc" for i in (1, 2, 3)]
    down.clear()
    assert d.replay() == 2 and d.replay() == 2
    d.senders["c"] = DL.to_folder
    assert d.replay() == 0 and d.replay() == 0
    assert got(d.delivered()) == [(x, f"{x}{i}") for x in "abc" for i in (1, 2, 3)] and d.dead_letters().count() == 0

    before = len(calls)
    d.write_batch(payloads(spark, [3]), 1)  # the batch is run again after a crash: nothing is sent twice
    assert len(calls) == before and len(got(d.delivered())) == 9


def test_nothing_to_deliver(spark, tmp_path):
    d = DL.Delivery(spark, str(tmp_path / "out"), {"a": DL.to_folder})
    assert d.delivered().count() == 0 and d.dead_letters().count() == 0 and d.replay() == 0
    d.write_batch(payloads(spark, []), 0)
    assert d.delivered().count() == 0
