"""Lexer state of lines (C6): literals and block comments that stay open over many lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lexer as LX
from ..sources import tables as T
from .catalog import query

#: Lines that open, close and escape literals and comments, one per event by its id.
LINES = ["const a = 'it';", "say(\"it's\")", "const t = `open", "` + x", "/* note", "end */ track('y')", "// don't", "s = '\\\\' + \"\\\"\" + `\\``",
         "plain();", "left = 'open", "/*/ odd", "done '"]


def literal_lines(events):
    """Lines of one file per user, in time order."""
    pick = F.lit("")
    for i, text in enumerate(LINES):
        pick = F.when((F.col("event_id") + F.col("user_id")) % len(LINES) == i, F.lit(text)).otherwise(pick)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string")).alias("repo"),
                         F.concat(F.lit("src/L"), F.col("user_id").cast("string"), F.lit(".ts")).alias("path"),
                         F.row_number().over(w).cast("int").alias("line_no"), pick.alias("text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TEXT = "CASE (event_id + user_id) % " + str(len(LINES)) + "".join(f" WHEN {i} THEN {_q(t)}" for i, t in enumerate(LINES)) + " END"
_STEP = ("CASE WHEN right(tk, 1) NOT IN (chr(39), chr(34), chr(96)) THEN st "
         "WHEN st = 0 THEN CASE right(tk, 1) WHEN chr(39) THEN 1 WHEN chr(34) THEN 2 ELSE 3 END "
         "WHEN length(tk) = 1 AND st = (CASE tk WHEN chr(39) THEN 1 WHEN chr(34) THEN 2 ELSE 3 END) THEN 0 ELSE st END")


@query("lexer_states", oracle=f"""
WITH RECURSIVE l AS (
  SELECT 'repo' || CAST(user_id % 5 AS VARCHAR) AS repo, 'src/L' || CAST(user_id AS VARCHAR) || '.ts' AS path,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, {_TEXT} AS text FROM events),
t AS (SELECT *, regexp_extract_all(text || chr(10), '(?s)\\\\.|[' || chr(39) || chr(34) || chr(96) || ']') AS tokens,
             regexp_extract(text, '(?s)^.*(/\\*|\\*/)', 1) AS mark FROM l),
s AS (
  SELECT repo, path, 1 AS line_no, 0 AS state, false AS open
  FROM t WHERE line_no = 1
  UNION ALL
  SELECT t.repo, t.path, t.line_no + 1, CAST(list_reduce(t.tokens, lambda st, tk: {_STEP}, s.state) AS INT),
         CASE WHEN t.mark = '' THEN s.open ELSE t.mark = '/*' END
  FROM s JOIN t ON t.repo = s.repo AND t.path = s.path AND t.line_no = s.line_no)
SELECT s.* FROM s JOIN l USING (repo, path, line_no)""")
def q_lexer_states(spark, sf_dir):
    """The literal and comment state at the start of every line, by a prefix scan over blocks of lines."""
    return LX.line_states(literal_lines(T.read_table(spark, sf_dir, "events")))
