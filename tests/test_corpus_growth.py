"""The corpus step grows with its input: long files, calls and windows."""

import time

from pyspark.sql import functions as F

from plansight.operators import corpus as K
from plansight.operators import locations as L
from plansight.operators import patches as PT
from plansight.operators import scope as SC
from plansight.operators import synthesis as Y
from plansight.session import stored
from plansight.sources import patches as SP
from plansight.sources.corpus import to_lines

FILE = "repo string, path string, content string"


def test_calls_of_one_long_file(spark):
    """20,000 calls in one file; reading the rest of the file for each of them would be ten billion characters."""
    content = "\n".join(f"track('name_{i % 7}', {{ a_{i % 3}: x, b: y }});" for i in range(20_000)) + "\ntrack('last')"
    t0 = time.time()
    got = K.track_calls(spark.createDataFrame([("r", "a.ts", content)], FILE)).groupBy(F.array_join("prop_keys", ",").alias("k")).count().collect()
    assert {r["k"]: r["count"] for r in got} == {"a_0,b": 6667, "a_1,b": 6667, "a_2,b": 6666, "": 1}
    assert time.time() - t0 < 60


def test_calls_far_from_their_object(spark):
    """A comma or closing brace further below than the lines at hand is still found."""
    gap = "\n" * 200
    content = f"track('a'{gap}, {{ k: 1, {gap} l: 2 }})\ntrack('b', {{ m: 1 {gap}"
    got = {r["event_name"]: r["prop_keys"] for r in K.track_calls(spark.createDataFrame([("r", "a.ts", content)], FILE)).collect()}
    assert got == {"a": ["k", "l"], "b": ["m"]}


def test_matches_shuffle_no_text(spark):
    """The text between matches stays where it is; only numbers and matches are exchanged."""
    files = spark.createDataFrame([("r", "a.ts", "x.save(1)\n" * 3)], FILE)
    plan = K.regex_matches(files, K.CRUD_CALL, (1,))._jdf.queryExecution().executedPlan().toString()
    exchange = plan[plan.index("Exchange"):].split("\n")[1]
    assert "content" not in exchange and "z#" not in exchange


def test_surroundings_equal_the_file(spark):
    """Characters around a match, from lines at hand or, with many short lines, from the file."""
    content = "a\n" * 700 + "const x = 1;" * 9 + "\nawait db.save(row)\n" + "b\n" * 400 + "x" * 90 + ".create(" + "\n" * 30
    files = spark.createDataFrame([("r", "a.ts", content)], FILE)
    m = K.many_matches(files, [(K.PID["crud"], K.CRUD_CALL, (1,), None)])
    rows = K._around(m, "crud", files, to_lines(files)).collect()
    assert len(rows) == 2
    for r in rows:
        end = r["offset"] + len(r["match"])
        assert (r["_back"], r["_ahead"]) == (content[max(0, r["offset"] - 300):r["offset"]], content[end:end + 80])


def test_enclosing_function_of_wanted_lines(spark, monkeypatch):
    content = "\n".join(["x", "function a() {", "y", "function if(", "z", "const b = (", "w", "v"])
    lines = to_lines(spark.createDataFrame([("r", "a.ts", content)], FILE))
    want = {(r["line_no"], r["enclosing_function"]) for r in K.enclosing_function(lines).collect()}
    monkeypatch.setattr(K.LX, "BLOCK", 2)
    assert {(r["line_no"], r["enclosing_function"]) for r in K.enclosing_function(lines, lines).collect()} == want


def test_calls_whose_next_comma_is_far_read_no_file(spark, monkeypatch):
    """Long runs of calls without a comma go on at the next one; the rest of the file is read for none of them."""
    kept, stored = [], K.stored
    monkeypatch.setattr(K, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    content = "track('a');\n" * 300 + "x, { k: 1 }\n" + "y\n" * 40 + "track('b')\n" * 60
    calls = K.track_calls(spark.createDataFrame([("r", "a.ts", content)], FILE))
    got = {(r["event_name"], tuple(r["prop_keys"])): r["count"] for r in calls.groupBy("event_name", "prop_keys").count().collect()}
    assert got == {("a", ("k",)): 300, ("b", ()): 60}
    assert kept[-1].count() == 0


def test_next_line_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(K.LX, "BLOCK", 4)
    marked, asked = [3, 9, 10, 30], list(range(1, 33))
    rows = lambda xs: spark.createDataFrame([("r", "a.ts", x) for x in xs], "repo string, path string, line_no int")
    got = {r["line_no"]: r["next"] for r in K.next_line(rows(asked), rows(marked)).collect()}
    assert got == {a: next((m for m in marked if m > a), None) for a in asked}


def test_numbering_lines_exchanges_no_text(spark):
    """The text of a line is made of its event after the events are dealt and numbered."""
    from plansight.sources.corpus import derived_code_lines
    events = spark.createDataFrame([(1, 5, "view", 1)], "event_id long, user_id long, event_type string, ts int")
    plan = derived_code_lines(events)._jdf.queryExecution().executedPlan().toString()
    assert "legacy_" in plan and "legacy_" not in plan[plan.index("Window"):]


def test_surroundings_are_read_once(spark, monkeypatch):
    """The entity of a CRUD call is written in place of the text that it was read from."""
    kept, stored = [], K.stored
    monkeypatch.setattr(K, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    files = spark.createDataFrame([("r", "a.ts", "db.from('teams').insert(row)\nx.save(1)\n")], FILE)
    m = K.guarded_matches(files, ["crud"])
    got = K.crud_candidates(m, files, to_lines(files)).select("function_name").collect()
    assert "team.insert" in {r["function_name"] for r in got}
    assert not any({"_back", "_ahead"} & set(df.columns) for df in kept)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    """The files of repetitive rows are far smaller than the rows: their size must not make a join send them through the driver."""
    lines = stored(spark.range(100_000).select(F.lit("r").alias("repo"), F.lit("src/lib/U1.tsx").alias("path"), (F.col("id") + 1).cast("int").alias("line_no"),
                                               F.lit("<button onClick={handleCreate}>").alias("text")))
    m = stored(lines.select("repo", "path", "line_no", F.lit(0).alias("col"), F.col("text").alias("match")))
    added = PT.added_lines(stored(SP.derived_patches(lines)))
    for df in (lines.join(m, ["repo", "path", "line_no"]), K.guard(m, None, lines), K.with_context(m, lines, 4, 15), K.next_line(m, lines), SC.scope_variables(lines, m),
               K.enclosing_function(lines, m), PT.new_interactions(m, added)):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)


def test_event_name_is_worked_out_once(spark):
    """The expression that names an interaction stands once in the plan, however often the name is used."""
    inter = spark.createDataFrame([("r", "src/a.tsx", 1, "click_handler", "handleCreateMember", "x", None, ["member"], "onClick={handleCreateMember}", 0.85, 1, 0, 1, 0)],
                                  "repo string, path string, line_no int, type string, function_name string, context string, ui_hint string, entities array<string>, "
                                  "trigger string, confidence double, detector int, match_no long, first_detector int, first_match_no long")
    name = inter.select(Y.guess_event_name(F.col("type"), F.col("function_name"), F.col("ui_hint"), F.col("entities")).alias("name"))
    assert len(_plan(Y.synthesize(inter))) < 5 * len(_plan(name))
    assert [r["name"] for r in Y.synthesize(inter).collect()] == ["member_created"]


def test_status_patterns_share_an_exchange(spark):
    """Fifteen patterns, one exchange of their matches; the right status and pattern for each."""
    text = "a.status = 'failed'\nreturn { status: 'completed' }\ndb.x.update({ status: 'started' })"
    files = spark.createDataFrame([("r", "a.ts", text)], FILE)
    lines = to_lines(files)
    got = L.status_transitions(files, lines)
    assert _plan(got.select("pattern_no")).count("REPARTITION_BY_NUM") <= 3
    assert {(r["status"], r["pattern"], r["line_no"]) for r in got.collect()} == {
        ("failed", "assignment", 1), ("completed", "return-status", 2), ("started", "return-status", 2), ("started", "update-status", 3)}


def test_plan_of_hooks_stays_small(spark):
    """Bodies of hooks are written once, not carried through every step of their guard; the entity is still found."""
    text = "export function useSave() {\n  return useMutation({ mutationFn: async (x) => db.users.create(x) })\n}\n// useMutation({ mutationFn: db.users.remove(x) })"
    files = spark.createDataFrame([("r", "src/a.tsx", text)], FILE)
    lines = to_lines(files)
    got = K.hook_candidates(K.guarded_matches(files, ["hook"], lines), files, lines)
    assert len(got._jdf.queryExecution().analyzed().toString()) < 80_000
    assert [(r["line_no"], r["function_name"], r["entities"], r["confidence"]) for r in got.collect()] == [(2, "useSave", ["user"], 0.85)]
