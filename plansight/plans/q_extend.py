"""A detector of a user's own (2.11), and distinct counts by mergeable sketches (A2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import events as E
from ..sources import corpus as S
from ..sources import tables as T
from . import fixtures as fx
from .catalog import query
from .q_events import EV

VIEW_CALL = K.Detector(
    "view_call", r"\btrack\s*\(\s*'(\w+)_viewed'",
    lambda m: m.select("repo", "path", "match_no", "line_no", F.lit("click_handler").alias("type"), F.concat(F.lit("view:"), "g1").alias("function_name"),
                       F.array("g1").alias("entities"), F.col("match").alias("trigger"), F.lit(0.95).alias("confidence")), (1,))


@query("custom_detector", oracle=fx.with_ctes(fx.CODE_LINES_CTE) + r"""
SELECT repo, path, 'view:' || regexp_extract(text, '^track\(''(\w+)_viewed''', 1) AS function_name, min(line_no) AS line_no
FROM code_lines WHERE regexp_matches(text, '^track\(''(\w+)_viewed''') GROUP BY ALL""")
def q_custom_detector(spark, sf_dir):
    """2.11: a registered detector's interactions, guarded and deduplicated with those of the built-in ones."""
    lines, files = S.corpus_tables(spark, sf_dir)
    K.register_detector(VIEW_CALL)
    try:
        rows = K.interactions(files, lines)
    finally:
        K.unregister_detector(VIEW_CALL.name)
    return rows.where(F.col("function_name").startswith("view:")).select("repo", "path", "function_name", "line_no")


@query("event_totals_sketch", oracle=fx.with_ctes(EV) + """
SELECT repo_id, count(*) AS total_events, count(DISTINCT event_name) AS distinct_names, true AS users_within_bound
FROM ev WHERE received_at >= (SELECT max(CAST(received_at AS DATE)) FROM ev) - 6 GROUP BY repo_id""")
def q_event_totals_sketch(spark, sf_dir):
    """A2 from daily sketches of the last seven days: few names are counted exactly, users within three standard errors."""
    e = T.events(spark, sf_dir)
    daily = E.daily_sketches(e)
    last = e.agg(F.to_date(F.max("received_at"))).scalar()
    got = E.totals_of_range(daily, F.date_sub(last, 6), last)
    exact = e.where(F.to_date("received_at").between(F.date_sub(last, 6), last)).groupBy("repo_id").agg(F.count_distinct("user_id").alias("users"))
    off = F.abs(F.col("distinct_users") - F.col("users")) / F.col("users")
    return got.join(exact, "repo_id").select("repo_id", "total_events", "distinct_names", (off <= 3 * E.SKETCH_ERROR).alias("users_within_bound"))
