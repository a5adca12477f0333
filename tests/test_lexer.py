"""C6 over split files: the block scan gives what the whole-file guard gives."""

import random

from pyspark.sql import functions as F

from plansight.operators import corpus as K
from plansight.operators import lexer as LX
from plansight.sources.corpus import to_lines

PIECES = ["'", '"', "`", "\\", "//", "/*", "*/", "*", " ", "x", "track(", "\n", "\n", "\n  ", "/*/", "\\'", '\\"', "\\\\", "é", "\r\n"]


def compare(spark, contents, blocks=None):
    files = spark.createDataFrame([("r", f"f{i}.ts", c) for i, c in enumerate(contents)], "repo string, path string, content string")
    probes, want = [], {}
    for i, c in enumerate(contents):
        flags = K.guard_offsets(c, list(range(len(c))))
        for at, flag in enumerate(flags):
            start = c.rfind("\n", 0, at) + 1
            probes.append(("r", f"f{i}.ts", c.count("\n", 0, at) + 1, at - start))
            want[(f"f{i}.ts", c.count("\n", 0, at) + 1, at - start)] = flag
    p = spark.createDataFrame(probes, "repo string, path string, line_no int, col int")
    got = {(r["path"], r["line_no"], r["col"]): r["in_string_or_comment"] for r in LX.guard_lines(p, to_lines(files)).collect()}
    wrong = [(k, want[k], contents[int(k[0][1:-3])]) for k in want if got.get(k) != want[k]]
    assert not wrong, wrong[:3]
    assert len(got) == len(want)


def test_equals_the_whole_file_guard(spark, monkeypatch):
    monkeypatch.setattr(LX, "BLOCK", 3)  # several blocks in every file
    rng = random.Random(7)
    compare(spark, ["".join(rng.choices(PIECES, k=rng.randint(1, 60))) for _ in range(120)] + ["", "\n", "'", "/*\n", "a\\"])


def test_states_of_every_line(spark):
    content = "const a = 'x\n  y';\n/* z\n w */ `t\n\\` u` + \"v\\\n\"\nend"
    rows = LX.line_states(to_lines(spark.createDataFrame([("r", "a.ts", content)], "repo string, path string, content string")))
    got = [(r["line_no"], r["state"], r["open"]) for r in rows.orderBy("line_no").collect()]
    assert got == [(1, 0, False), (2, 1, False), (3, 0, False), (4, 0, True), (5, 3, False), (6, 2, False), (7, 0, False)]


def test_one_large_file_is_many_tasks(spark):
    """300,000 lines of one file: the literal opened in line 2 closes 250,000 lines later."""
    n = 300_000
    text = (F.when(F.col("id") == 1, "const s = `").when(F.col("id") == 250_000, "`; track('a')").when(F.col("id") % 3 == 0, "say(\"it's\")")
            .otherwise("track('x')"))
    lines = spark.range(n).select(F.lit("r").alias("repo"), F.lit("big.ts").alias("path"), (F.col("id") + 1).cast("int").alias("line_no"), text.alias("text"))
    probes = lines.where(F.col("text").contains("track(")).select("repo", "path", "line_no", (F.instr("text", "track(") - 1).alias("col"))
    out = LX.guard_lines(probes, lines)
    free = out.where("NOT in_string_or_comment").agg(F.min("line_no"), F.max("line_no"), F.count("*")).first()
    # lines 3 .. 250,000 are in the literal, the closing line's call and all later ones are free
    want = 1 + sum(1 for i in range(250_001, n) if i % 3)
    assert (free[0], free[1], free[2]) == (250_001, n, want)
    blocks = LX.line_states(lines, probes)
    assert blocks.count() == probes.count()


def test_depth_and_function_carry_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(LX, "BLOCK", 4)
    rng = random.Random(3)
    texts = [rng.choice(["{", "}", "}}", "{{ {", "function f%d() {" % i, "const g%d = async (x) => {" % i, "x", ""]) for i in range(90)]
    lines = to_lines(spark.createDataFrame([("r", "a.ts", "\n".join(texts)), ("r", "b.ts", "}\n{")], "repo string, path string, content string"))
    depth, want = 0, []
    for t in texts:
        want.append(depth)
        depth = max(0, depth + t.count("{") - t.count("}"))
    got = K.brace_depth(lines).where("path = 'a.ts'").orderBy("line_no").collect()
    assert [r["depth"] for r in got] == want and got[0].asDict().keys() == {"repo", "path", "line_no", "text", "depth"}
    names, last = [], None
    for t in texts:
        last = t.split("(")[0].split()[1] if t.startswith(("function", "const")) else last
        names.append(last)
    got = K.enclosing_function(lines).where("path = 'a.ts'").orderBy("line_no").collect()
    assert [r["enclosing_function"] for r in got] == names


def test_plain_texts_leave_every_state(spark):
    """What is taken for plain changes no state; lines with pairs of one quote are."""
    rng = random.Random(4)
    texts = ["".join(rng.choice(["'", '"', "`", "\\", "x", " "]) for _ in range(rng.randint(0, 7))) for _ in range(400)] + ["track('a', 'b')"]
    tokens = F.regexp_extract_all("t", F.lit(LX.TOKEN), 0).alias("tokens")
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", LX.plain(F.col("t")).alias("p"), LX.map_of(F.col("t")).alias("m"), tokens).collect():
        want = 0
        for s in range(4):
            now = s
            for token in r["tokens"]:
                q = "'\"`".find(token[-1]) + 1
                now = now if not q else q if now == 0 else 0 if now == q and len(token) == 1 else now
            want |= now << 2 * s
        assert r["m"] == want, r["t"]
        assert not r["p"] or want == LX.IDENTITY, r["t"]
    assert r["p"]
