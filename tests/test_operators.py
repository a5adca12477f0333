"""Operator tests on small inline inputs, checked against brute force or
against results worked out by hand from the reference's rules."""

import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plansight.operators import corpus as K
from plansight.operators import graph as G
from plansight.operators import ingest as I
from plansight.operators import ordered as O
from plansight.operators import plan as P
from plansight.operators import sequences as S


def _ts(sec):
    return pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=sec)


@pytest.fixture(scope="module")
def rand_events(spark):
    rng = random.Random(7)
    rows = []
    eid = 0
    for user in range(3):
        # user 0 is hot: most rows, spread over several day buckets
        n = 400 if user == 0 else 40
        t = 0
        for _ in range(n):
            t += rng.randint(1, 20000)
            rows.append((eid, user, rng.choice(["a", "b", "c"]), _ts(t)))
            eid += 1
    return spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "user_id", "event_name", "received_at"]))


def test_next_time_after_matches_brute_force(spark, rand_events):
    pdf = rand_events.toPandas()
    probes = rand_events.where("event_name = 'a'")
    cands = rand_events.where("event_name = 'b'").select("user_id", "received_at")
    got = O.next_time_after(probes, cands, ["user_id"], "received_at", "nxt", bucket_seconds=3600).toPandas()
    got = dict(zip(got.event_id, got.nxt))
    for r in pdf[pdf.event_name == "a"].itertuples():
        later = pdf[(pdf.user_id == r.user_id) & (pdf.event_name == "b") & (pdf.received_at > r.received_at)]
        exp = later.received_at.min() if len(later) else None
        assert (got[r.event_id] is None or pd.isna(got[r.event_id])) if exp is None else got[r.event_id] == exp


def test_prefix_sum_and_forward_carry(spark, rand_events):
    pdf = rand_events.toPandas().sort_values(["user_id", "received_at", "event_id"])
    x = O.prefix_sum(rand_events, ["user_id"], ["received_at", "event_id"],
                     (F.col("event_name") == "a").cast("long"), "n_a", bucket_seconds=3600)
    x = x.withColumn("_v", F.when(F.col("event_name") == "c", F.col("event_id")))
    x = O.carry(x, ["user_id"], ["received_at", "event_id"], "_v", "last_c", bucket_seconds=3600).toPandas()
    x = x.set_index("event_id")
    for user, g in pdf.groupby("user_id"):
        n, last = 0, None
        for r in g.itertuples():
            n += r.event_name == "a"
            last = r.event_id if r.event_name == "c" else last
            assert x.loc[r.event_id, "n_a"] == n
            v = x.loc[r.event_id, "last_c"]
            assert (pd.isna(v) and last is None) or v == last


def test_funnel_greedy(spark):
    rows = [(1, 1, "signup", _ts(0)), (2, 1, "view", _ts(10)), (3, 1, "purchase", _ts(20)),
            (4, 1, "signup", _ts(30)), (5, 1, "purchase", _ts(40)),
            (6, 2, "signup", _ts(0)), (7, 2, "view", _ts(8 * 86400))]
    ev = spark.createDataFrame(pd.DataFrame(rows, columns=["event_id", "user_id", "event_name", "received_at"]))
    out = {r.start_id: r.steps_reached for r in
           S.funnel(ev, ["signup", "view", "purchase"], 7 * 86400).collect()}
    assert out == {1: 3, 4: 1, 6: 1}


def _limiter_brute(rows, limit, window_us):
    stamps, out = {}, {}
    for rid, key, t, n in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        st = stamps.setdefault(key, deque())
        while st and st[0][0] < t - window_us:
            st.popleft()
        ok = sum(x[1] for x in st) + n <= limit
        if ok:
            st.append((t, n))
        out[rid] = ok
    return out


def test_rate_limit_matches_sequential_fold(spark):
    rng = random.Random(3)
    rows, t = [], 0
    for i in range(300):
        t += rng.randint(0, 30)
        rows.append((f"r{i:04d}", rng.choice([1, 2]), t, rng.randint(1, 5)))
    pdf = pd.DataFrame(rows, columns=["request_id", "repo_id", "sec", "n_events"])
    pdf["received_at"] = pdf.sec.map(_ts)
    df = spark.createDataFrame(pdf.drop(columns=["sec"]))
    got = {r.request_id: r.allowed for r in I.rate_limit(df, limit=12, window_seconds=60).collect()}
    exp = _limiter_brute([(r[0], r[1], r[2] * 1_000_000, r[3]) for r in rows], 12, 60 * 1_000_000)
    assert got == exp
    assert not all(got.values())


def test_sliding_sum_inclusive_window(spark):
    pdf = pd.DataFrame({"k": [1, 1, 1, 1], "event_id": [1, 2, 3, 4],
                        "t": [_ts(3590), _ts(3600), _ts(3650), _ts(3660)]})
    out = I.sliding_sum(spark.createDataFrame(pdf), "k", "t", F.lit(1), "n", 60, 3600).toPandas()
    assert dict(zip(out.event_id, out.n)) == {1: 1, 2: 2, 3: 3, 4: 3}


def test_merge_rules_per_status(spark):
    cols = P.PLAN_COLS
    ex = spark.createDataFrame([
        (1, "e1", "a", "old", "low", "suggested", "f", "l", "locA"),
        (1, "e2", "b", "old", "low", "approved", "f", "l", "locA"),
        (1, "e3", "c", "old", "low", "implemented", "f", "l", "locA"),
        (1, "e4", "d", "old", "low", "deprecated", "f", "l", "locA"),
        (1, "e5", "e", "old", "low", "suggested", "f", "l", "locA")], cols)
    nw = spark.createDataFrame([
        (1, f"e{i}", n, "new", "high", "implemented", "F", "L", "locB")
        for i, n in [(1, "a2"), (2, "b2"), (3, "c2"), (4, "d2"), (6, "f")]], cols)
    m = {r.id: r for r in P.merge(ex, nw, F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()}
    now = "2024-02-01T00:00:00"
    assert (m["e1"].name, m["e1"].status, m["e1"].first_seen, m["e1"].last_seen, m["e1"].location) == ("a2", "suggested", "f", now, "locB")
    assert (m["e2"].name, m["e2"].status, m["e2"].last_seen, m["e2"].location) == ("b", "approved", now, "locB")
    assert (m["e3"].name, m["e3"].last_seen, m["e3"].location) == ("c", now, "locA")
    assert (m["e4"].name, m["e4"].last_seen) == ("d", "l")
    assert (m["e5"].last_seen, m["e6"].status) == ("l", "implemented")
    stats = P.merge_stats(ex, nw).collect()[0]
    assert (stats.added, stats.updated, stats.confirmed, stats.unchanged) == (1, 1, 1, 1)


def test_join_paths_cut_at_three_hops(spark):
    edges = [("Nation", "Region", 1), ("Customer", "Nation", 2), ("Supplier", "Nation", 3),
             ("Order", "Customer", 4), ("LineItem", "Order", 5), ("LineItem", "Part", 6),
             ("LineItem", "Supplier", 7)]
    rel = spark.createDataFrame(edges, ["child", "parent", "ord"])
    p = {(r["from"], r["to"]): r for r in G.join_paths(rel).collect()}
    assert p[("LineItem", "Nation")].hops == 2  # LineItem -> Supplier -> Nation
    assert p[("LineItem", "Nation")].via.startswith("LineItem.supplier_id")
    assert p[("LineItem", "Customer")].hops == 2
    assert ("LineItem", "Region") in p and p[("LineItem", "Region")].hops == 3
    assert ("Order", "Region") in p and p[("Order", "Region")].hops == 3
    assert all(r.hops <= 3 for r in p.values())


def test_lifecycles_from_code(spark):
    files = spark.createDataFrame([
        ("r", "src/models.ts", "enum WorkflowStatus { DRAFT, ACTIVE, COMPLETED }\nprisma.workflow.create({})"),
        ("r", "src/types.ts", "type TaskStatus = 'todo' | 'in_progress' | 'done';\nawait prisma.task.update()")],
        ["repo", "path", "content"])
    objs = G.context_objects(files)
    lc = {r.object: list(r.states) for r in G.lifecycles_from_code(files, objs).collect()}
    assert lc == {"Workflow": ["draft", "active", "completed"], "Task": ["todo", "in_progress", "done"]}


def test_track_calls_multiline_object_and_shorthand(spark):
    content = "track('a_done', {\n  x_id: 1,\n  ...rest,\n  y: 2,\n});\ntrack(\"b_done\", { workflow_id });"
    files = spark.createDataFrame([("r", "f.ts", content)], ["repo", "path", "content"])
    calls = {r.event_name: (r.line_no, list(r.prop_keys)) for r in K.track_calls(files).collect()}
    assert calls["a_done"] == (1, ["x_id", "y"])
    assert calls["b_done"] == (6, [])  # shorthand has no "key:" so it does not count


def test_guard_offsets():
    text = "const a = 'onClick={x}';\n// onClick={y}\nx = 1 // onClick={z}\n/* onClick={w} */ onClick={v}"
    offs = [text.index(s) for s in ("onClick={x}", "onClick={y}", "onClick={z}", "onClick={w}", "onClick={v}")]
    assert K.guard_offsets(text, offs) == [True, True, True, True, False]


def test_regex_matches_positions(spark):
    content = "ab\nxx track('a')\n\ntrack(\n'b')"
    files = spark.createDataFrame([("r", "f.ts", content)], ["repo", "path", "content"])
    got = [(r.offset, r.line_no, r.g1) for r in
           K.regex_matches(files, r"\btrack\s*\(\s*'([^']+)'", (1,)).orderBy("match_no").collect()]
    assert got == [(content.index("track('a')"), 2, "a"), (content.rindex("track("), 4, "b")]


def test_mutation_hook_detector(spark):
    content = ("export function useDeleteIssue() {\n"
               "  return useMutation({\n"
               "    mutationFn: async (id) => {\n"
               "      // db.note.create() is a comment\n"
               "      await supabase.from('issues').delete().eq('id', id);\n"
               "    },\n"
               "  });\n"
               "}\n"
               "const useOther = () => useMutation({ onSuccess: () => {} });\n")
    files = spark.createDataFrame([("r", "src/hooks/IssueHooks.ts", content)], ["repo", "path", "content"])
    from plansight.sources.corpus import to_lines
    lines = to_lines(files)
    got = {r.line_no: (r.function_name, list(r.entities), r.confidence)
           for r in K.detect_mutation_hooks(files, lines).collect()}
    assert got[2] == ("useDeleteIssue", ["issue"], 0.85)
    assert got[9][0] == "useOther" and got[9][2] == 0.75


def test_scope_variables_and_inferred_properties(spark):
    from plansight.operators import scope as SC
    from plansight.sources.corpus import to_lines
    content = ("export function WorkflowEditor({ workflow, onSave }: Props) {\n"
               "  const [step, setStep] = useState<Step>(null);\n"
               "  const { user } = useContext(AuthContext);\n"
               "  if (x) {\n"
               "    const hidden = 1;\n"
               "  }\n"
               "  const handleSave = async (data: Input, opts = {}) => {\n"
               "    save(workflow);\n"
               "  };\n"
               "}\n")
    files = spark.createDataFrame([("r", "src/components/WorkflowEditor.tsx", content)], ["repo", "path", "content"])
    lines = to_lines(files)
    targets = spark.createDataFrame([("r", "src/components/WorkflowEditor.tsx", 8)], ["repo", "path", "line_no"])
    got = {r.name: (r.type, r.source) for r in SC.scope_variables(lines, targets).collect()}
    # line 8 is inside the arrow function opened on line 7: its parameters and the
    # line-7 declaration are in scope, the outer function's lines are not
    assert got == {"data": ("Input", "parameter"), "opts": (None, "parameter"), "handleSave": (None, "const")}
    targets2 = spark.createDataFrame([("r", "src/components/WorkflowEditor.tsx", 7)], ["repo", "path", "line_no"])
    got2 = {r.name: (r.type, r.source) for r in SC.scope_variables(lines, targets2).collect()}
    # on the start line itself only the parameters are in scope
    assert got2 == {"data": ("Input", "parameter"), "opts": (None, "parameter")}
    t3 = spark.createDataFrame([("r", "src/components/WorkflowEditor.tsx", 6)], ["repo", "path", "line_no"])
    got3 = {r.name: (r.type, r.source) for r in SC.scope_variables(lines, t3).collect()}
    # line 6 is still inside the if-block (depth 2), so `hidden` counts, as in the reference
    assert got3 == {"workflow": (None, "parameter"), "onSave": (None, "parameter"), "step": ("Step", "useState"),
                    "user": (None, "useContext"), "hidden": (None, "const")}
    ev = spark.createDataFrame([("r", "workflow_saved", "src/components/WorkflowEditor.tsx", 6)],
                               ["repo", "name", "path", "line_no"])
    rel = spark.createDataFrame([("r", "Workflow", "Project", 1)], ["repo", "child", "parent", "ord"])
    paths = spark.createDataFrame([("r", "Workflow", "Organization", 2, [1, 2])], ["repo", "from", "to", "hops", "ords"])
    props = {r.prop: (r.required, r.access_path, r.verified) for r in
             SC.infer_properties(ev, SC.scope_variables(lines, t3), rel, paths).collect()}
    assert props == {"workflow_id": (True, "workflow.id", True), "project_id": (True, "project?.id", False),
                     "organization_id": (False, "organization?.id", False), "user_id": (True, "user?.id", True)}


def test_status_transitions_and_best_location(spark):
    from plansight.operators import locations as L
    from plansight.sources.corpus import to_lines
    files = spark.createDataFrame([
        ("r", "src/services/run.ts",
         "export async function finish(run) {\n  await db.runs.update({ status: 'completed' });\n"
         "  run.status = 'completed';\n  return run;\n}\n"),
        ("r", "src/types.ts", "type RunStatus = 'started' | 'completed';\nx.status = 'completed';\n"),
        ("r", "src/workflows/editor.ts", "export const a = 1;\n")], ["repo", "path", "content"])
    lines = to_lines(files)
    tr = {(r.path, r.line_no, r.pattern) for r in L.status_transitions(files, lines).collect() if r.status == "completed"}
    # the type file is not runtime code
    assert tr == {("src/services/run.ts", 2, "update-status"), ("src/services/run.ts", 3, "assignment")}
    gaps = spark.createDataFrame([("r", "run_completed", None, 0, 0.5), ("r", "workflow_opened", None, 0, 0.5),
                                  ("r", "thing_done", "src/a.ts", 4, 0.85)],
                                 "repo string, name string, path string, line_no int, confidence double")
    best = {r.name: (r.file, r.line, r.confidence, r.hint) for r in L.best_locations(gaps, files, lines).collect()}
    assert best["run_completed"] == ("src/services/run.ts", 2, 0.8, "status_transition")
    assert best["workflow_opened"] == ("src/workflows/editor.ts", 1, 0.25, "inferred")
    assert best["thing_done"] == ("src/a.ts", 4, 0.85, "detected")


def test_code_properties(spark):
    from plansight.operators import scope as SC
    f1 = ("const m = useMutation({\n  mutationFn: async (input: { email: string; role?: 'admin' | 'member'; seats: number }) => {\n"
          "    const { data } = await supabase.from('invites').insert(input);\n  },\n});\n")
    f2 = "export const save = async (draft) => {\n  api.put(draft.title, draft.body, draft.id);\n};\n"
    files = spark.createDataFrame([("r", "a.ts", f1), ("r", "b.ts", f2)], ["repo", "path", "content"])
    inter = spark.createDataFrame([("r", "a.ts", "useInvite", 1, ["invite"]), ("r", "b.ts", "save", 1, ["draft"])],
                                  "repo string, path string, function_name string, line_no int, entities array<string>")
    got = {(r.path, r.prop): (r.type, r.required, r.access_path) for r in SC.code_properties(inter, files).collect()}
    assert got == {("a.ts", "email"): ("string", True, "variables.email"),
                   ("a.ts", "role"): ("string", False, "variables.role"),
                   ("a.ts", "seats"): ("number", True, "variables.seats"),
                   ("a.ts", "invite_id"): ("string", False, "data?.id"),
                   ("b.ts", "title"): ("string", True, "draft.title"),
                   ("b.ts", "body"): ("string", True, "draft.body")}


def test_merge_proposals(spark):
    from plansight.operators import synthesis as Y
    inter = spark.createDataFrame([
        ("r", 0, "click_handler", "handleCreateTeam", "a.tsx", 3, "", 0.85, "onClick={handleCreateTeam}", ["team"], None),
        ("r", 1, "mutation", "team.create", "a.tsx", 9, "", 0.9, ".create(", ["team"], None),
        ("r", 2, "click_handler", "handleDeleteTeam", "a.tsx", 12, "", 0.85, "onClick={handleDeleteTeam}", ["team"], None),
        ("r", 3, "route_handler", "POST /api/invites", "b.ts", 1, "", 0.9, "post('/api/invites')", ["invite"], None)],
        "repo string, index long, type string, function_name string, path string, line_no int, context string, "
        "confidence double, trigger string, entities array<string>, ui_hint string")
    props = spark.createDataFrame([
        ("r", 0, 1, "team_formed", "", "critical", None, [0, 1, 1, 99], [3]),
        ("r", 0, 2, "Bad Name", "x", "high", None, [2], [3])],
        "repo string, batch long, ord int, name string, description string, priority string, includes array<string>, "
        "source_ids array<long>, skipped array<long>")
    got = {r.name: (r.path, r.line_no, r.priority, r.signal_type, r.description, r.n_sources)
           for r in Y.merge_proposals(inter, props, granular=True).collect()}
    # 99 is outside the batch, 1 is repeated; index 2 stays uncovered (invalid
    # proposal) and gets its rule-based name; index 3 was skipped
    assert got == {"team_formed": ("a.tsx", 9, "critical", "action", "Business interaction: team_formed", 2),
                   "team_deleted": ("a.tsx", 12, "medium", "action", "click_handler: handleDeleteTeam", 1)}


def test_lifecycles_merge_per_object_and_state_variant(spark):
    code = ("enum OrderStatus { Draft, Open = 2 }\ntype OrderStatus = 'paid' | 'open' | \"closed\";\n"
            "type orderStatus = 'late_one';\nenum TicketSTATE { NEW, new, done }\ntype TicketState = 'gone';\nenum Colour { RED }\n")
    files = spark.createDataFrame([("r", "b.ts", code), ("r", "a.ts", "enum OrderStatus { First }"), ("q", "a.ts", "type TaskStatus = 'todo';")],
                                  "repo string, path string, content string")
    objects = spark.createDataFrame([("r", "order"), ("q", "order")], "repo string, key string")
    known = {(r.repo, r.object): list(r.states) for r in G.lifecycles_from_code(files, objects).collect()}
    assert known == {("r", "Order"): ["first", "draft", "open", "paid", "closed", "late_one"]}
    every = {(r.repo, r.object): list(r.states) for r in G.lifecycles_from_code(files).collect()}
    assert every == known | {("r", "Ticket"): ["new", "done", "gone"], ("q", "Task"): ["todo"]}


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from plansight.session import ensure_checkpoint_dir
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(far)


def test_ranked_reports_what_a_cap_leaves_out(spark):
    from plansight.operators import patches as PT
    df = spark.createDataFrame([("r", 1, i) for i in range(25)] + [("r", 2, 0)], "repo string, pr int, pos int")
    every = PT.ranked(df, ["repo", "pr"], ["pos"])
    assert every.count() == 26 and {r["n_more"] for r in every.collect()} == {0}
    cut = PT.ranked(df, ["repo", "pr"], ["pos"], 20).collect()
    assert len(cut) == 21 and {(r["pr"], r["n_more"]) for r in cut} == {(1, 5), (2, 0)}
