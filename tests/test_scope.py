"""Which declaration a name comes from, and which rule a property comes from."""

from plansight.operators import scope as SC
from plansight.sources.corpus import to_lines


def test_hierarchy_comes_before_the_actor(spark):
    """A parent object User gives user_id by its own variable; the actor's rule comes later, then sequence properties."""
    content = "const handleCreate = (currentUser: User) => {\n  const workflow = 1;\n  save(workflow);\n};\n"
    lines = to_lines(spark.createDataFrame([("r", "a.tsx", content)], "repo string, path string, content string"))
    target = spark.createDataFrame([("r", "a.tsx", 3)], "repo string, path string, line_no int")
    ev = spark.createDataFrame([("r", "workflow_created", "a.tsx", 3), ("r", "invoice_created", "a.tsx", 3)],
                               "repo string, name string, path string, line_no int")
    rel = spark.createDataFrame([("r", "Workflow", "Project", 1), ("r", "Workflow", "User", 2)], "repo string, child string, parent string, ord int")
    paths = spark.createDataFrame([], "repo string, from string, to string, hops int, ords array<int>")
    rows = SC.infer_properties(ev, SC.scope_variables(lines, target), rel, paths).collect()
    got = {(r["event_name"], r["prop"]): (r["access_path"], r["verified"]) for r in rows}
    assert got[("workflow_created", "user_id")] == ("currentUser.id", True)
    assert got[("invoice_created", "user_id")] == ("currentUser?.id", True)
    order = [r["prop"] for r in sorted((r for r in rows if r["event_name"] == "workflow_created"), key=lambda r: r["ord"])]
    assert order == ["workflow_id", "project_id", "user_id"]


def test_targets_see_the_lines_of_their_own_function(spark):
    body = ["const top = 1;", "log(top);", "function first(a) {"] + [f"  const x{i} = {i};" for i in range(40)] + ["}", "function second(b) {"]
    body += ["  if (b) {", "    const inner = 1;", "    use(inner);", "  }", "  const late = 2;", "}"]
    lines = to_lines(spark.createDataFrame([("r", "a.ts", "\n".join(body))], "repo string, path string, content string"))
    where = {"log(top);": {"top"}, "  const x3 = 3;": {"a", "x0", "x1", "x2"}, "    use(inner);": {"b", "inner"},
             "  const late = 2;": {"b"}, "const top = 1;": set()}
    targets = spark.createDataFrame([("r", "a.ts", body.index(t) + 1) for t in where], "repo string, path string, line_no int")
    out = SC.scope_variables(lines, targets)
    got = {t: set() for t in where}
    for r in out.collect():
        got[body[r["line_no"] - 1]].add(r["name"])
    assert got == where
    assert "explode(sequence" not in out._jdf.queryExecution().toString()
