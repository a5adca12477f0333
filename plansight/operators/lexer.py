"""Lexer state of lines and string / comment guard (C6) over files of any length.

A file is never held whole. What a line does to the lexer is a map from the
state before it to the state after it: four states (code, and inside a ', ",
or ` literal), so a map is a byte. Maps compose associatively. Blocks of
``BLOCK`` lines are folded to one map each, the blocks of a file (a few
thousand for millions of lines) give the state at every block start, and the
lines of a block follow from that: a prefix scan in two levels, both levels
grouped by keys that no file outgrows. A line without quotes, escapes or
comment marks is the identity and takes no part in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

BLOCK = 1024
FILE = ["repo", "path"]
IDENTITY = 0b11_10_01_00  # two bits per state, state 0 (code) lowest
TOKEN = r"""(?s)\\.|['"`]"""
LAST_MARK = r"(?s)^.*(/\*|\*/)"
LINE_COMMENT = r"^[\s\x0b\x1c-\x1f\x85\p{Z}]*(//|\*)"


def after(m: Column, state: Column) -> Column:
    """The state after a map, for the state before it."""
    return (F.when(state == 0, m).when(state == 1, F.shiftright(m, 2)).when(state == 2, F.shiftright(m, 4))
            .otherwise(F.shiftright(m, 6))).bitwiseAND(3)


def packed(states: list[Column]) -> Column:
    """A map from the states after the four states."""
    out = states[0]
    for i, s in enumerate(states[1:], 1):
        out = out + F.shiftleft(s, 2 * i)
    return out


def then(first: Column, second: Column) -> Column:
    """The map that does ``first`` and then ``second``."""
    return packed([after(second, F.shiftright(first, 2 * i).bitwiseAND(3)) for i in range(4)])


def plain(text: Column) -> Column:
    """Whether a text surely leaves every state as it is: no backslash, and quotes of at most one kind, an even number."""
    n = [F.length(text) - F.length(F.replace(text, F.lit(q), F.lit(""))) for q in "'\"`"]
    kinds = sum((F.when(x > 0, 1).otherwise(0) for x in n), F.lit(0))
    return ~text.contains("\\") & (kinds <= 1) & ((n[0] + n[1] + n[2]) % 2 == 0)


def map_of(text: Column) -> Column:
    """What a piece of text does to the state. A quote opens a literal in code and closes its own; a backslash takes the
    next character out of a literal, but means nothing in code, where a quote after it opens a literal."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), 0)

    def step(m: Column, token: Column) -> Column:
        quote = F.substring(token, -1, 1)
        q = F.when(quote == "'", 1).when(quote == '"', 2).when(quote == "`", 3).otherwise(0)
        escaped = F.length(token) > 1

        def one(s: Column) -> Column:
            return F.when(q == 0, s).when(s == 0, q).when((s == q) & ~escaped, 0).otherwise(s)

        return packed([one(F.shiftright(m, 2 * i).bitwiseAND(3)) for i in range(4)])

    return F.when(plain(text), F.lit(IDENTITY)).otherwise(F.aggregate(tokens, F.lit(IDENTITY), step))


def last_mark(text: Column) -> Column:
    """True if the last block comment mark of a text opens a comment, false if it closes one, null without a mark."""
    m = F.regexp_extract(text, LAST_MARK, 1)
    return F.when(text.contains("/*") | text.contains("*/"), m == "/*")


def _running(rows: Column, state: Column, opened: Column, key: str) -> Column:
    """Array of (key, state, open before the entry) along ordered (key, map, mark) entries."""
    start = F.struct(state.cast("int").alias("state"), opened.alias("open"),
                     F.array().cast(f"array<struct<{key}:bigint,state:int,open:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = F.struct(x[key].cast("bigint").alias(key), acc["state"].alias("state"), acc["open"].alias("open"))
        return F.struct(after(x["map"], acc["state"]).cast("int").alias("state"), F.coalesce(x["mark"], acc["open"]).alias("open"),
                        F.concat(acc["out"], F.array(now)).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def line_states(lines: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(repo, path, line_no, state, open): the literal (0: none) and whether a block comment is open at a line's start.

    ``wanted(repo, path, line_no)`` limits the result to some lines; the scan then carries those and the lines that
    change the lexer, nothing else."""
    if wanted is not None:  # only what may move the lexer is looked at
        lines = lines.where(~plain(F.concat("text", F.lit("\n"))) | F.col("text").contains("/*") | F.col("text").contains("*/"))
    x = lines.select(*FILE, F.col("line_no").cast("bigint").alias("line_no"), map_of(F.concat("text", F.lit("\n"))).cast("int").alias("map"),
                     last_mark(F.col("text")).alias("mark"))
    if wanted is not None:
        w = wanted.select(*FILE, F.col("line_no").cast("bigint").alias("line_no")).distinct().withColumn("_wanted", F.lit(True))
        moves = (F.col("map") != IDENTITY) | F.col("mark").isNotNull()
        x = x.where(moves).unionByName(w.select(*FILE, "line_no", F.lit(IDENTITY).alias("map"), F.lit(None).cast("boolean").alias("mark")))
        x = x.groupBy(*FILE, "line_no").agg(F.max_by("map", F.when(F.col("map") != IDENTITY, 1).otherwise(0)).alias("map"),
                                            F.max("mark").alias("mark"))
    x = x.withColumn("block", F.floor(F.col("line_no") / BLOCK).cast("bigint"))
    # read twice, for the state at the block starts and for the lines
    blocks = stored(x.groupBy(*FILE, "block").agg(F.sort_array(F.collect_list(F.struct("line_no", "map", "mark"))).alias("rows")))
    whole = blocks.select(*FILE, "block", F.aggregate("rows", F.lit(IDENTITY), lambda m, r: then(m, r["map"])).alias("map"),
                          F.aggregate("rows", F.lit(None).cast("boolean"), lambda m, r: F.coalesce(r["mark"], m)).alias("mark"))
    # a row per block: a file of ten million lines has ten thousand
    starts = whole.groupBy(*FILE).agg(F.sort_array(F.collect_list(F.struct("block", "map", "mark"))).alias("rows")).select(
        *FILE, F.inline(_running(F.col("rows"), F.lit(0), F.lit(False), "block")))
    out = blocks.join(starts, [*FILE, "block"]).select(*FILE, F.inline(_running(F.col("rows"), F.col("state"), F.col("open"), "line_no")))
    if wanted is not None:
        out = out.join(w.drop("_wanted"), [*FILE, "line_no"], "left_semi")
    return out.withColumn("line_no", F.col("line_no").cast("int"))


def guarded(prefix: Column, state: Column, opened: Column) -> Column:
    """Whether what follows ``prefix`` (its line up to it) lies in a literal or comment, given the line's start."""
    code = F.substring_index(prefix, "//", 1)
    odd = [F.length(F.regexp_replace(code, f"[^{q}]", "")) % 2 == 1 for q in ("'", '"')]
    return ((after(map_of(prefix), state) != 0) | F.coalesce(last_mark(prefix), opened) | prefix.rlike(LINE_COMMENT)
            | (prefix.contains("//") & ~odd[0] & ~odd[1]))


def guard_lines(probes: DataFrame, lines: DataFrame, out: str = "in_string_or_comment") -> DataFrame:
    """Add ``out`` to probes (repo, path, line_no, col, ...): is the place ``col`` (from 0) of the line in a string or comment?"""
    at = line_states(lines, probes).withColumnsRenamed({"state": "_state", "open": "_open"})
    text = lines.select(*FILE, "line_no", F.col("text").alias("_text"))
    x = probes.join(text, [*FILE, "line_no"]).join(at, [*FILE, "line_no"])
    prefix = F.substring("_text", F.lit(1), F.col("col").cast("int"))
    return x.withColumn(out, guarded(prefix, F.col("_state"), F.col("_open"))).drop("_text", "_state", "_open")
