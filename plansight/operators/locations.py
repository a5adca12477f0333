"""Locations for suggested events: status transitions (C14, T5) and the
fallback chain (C15).

Status values come from a fixed set, so every (status, pattern) pair is a
literal regex run once over the corpus with exact positions; the runtime-code
test and the context are line windows joined on exploded line numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.util import at as _at
from ..session import stored
from .corpus import many_matches

# Lifecycle statuses that name a transition, and the patterns.
STATUSES = ["started", "completed", "failed", "accepted", "rejected"]
TRANSITION_PATTERNS = [
    ("update-status", r"\.update\(\s*\{\s*status\s*:\s*['\"`]{s}['\"`]\s*\}\s*\)", 0.2),
    ("return-status", r"return\s+\{[\s\S]*?status\s*:\s*['\"`]{s}['\"`][\s\S]*?\}", 0.0),
    ("assignment", r"(\w+)\.status\s*=\s*['\"`]{s}['\"`]", 0.1),
]
NOT_RUNTIME = [r"\binterface\b|\btype\b", r":\s*['\"`]?[a-zA-Z_]+['\"`]?\s*(\||;|,)"]
STATUS_SUFFIX = r"_(started|completed|failed|accepted|rejected)$"
# (name substring test, path test, confidence) in rule order
INFER_RULES = [
    (["scan"], lambda p: p.contains("scan") & (p.contains("service") | p.contains("route") | p.contains("api")), 0.3),
    (["user", "auth", "login", "signup"], lambda p: p.contains("auth") | p.contains("user"), 0.3),
    (["workflow"], lambda p: p.contains("workflow") | p.contains("workflows"), 0.25),
]


def _window_text(rows: DataFrame, lines: DataFrame, lo, hi, out: str) -> DataFrame:
    """Text of lines lo..hi (1-based, clipped) for each row (repo, path, _k)."""
    probe = rows.select("repo", "path", "_k", F.explode(F.sequence(F.greatest(lo, F.lit(1)), hi)).alias("_l"))
    j = probe.join(lines.select("repo", "path", F.col("line_no").alias("_l"), "text"), ["repo", "path", "_l"])
    t = j.groupBy("repo", "path", "_k").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_l", "text"))), lambda s: s["text"]), "\n").alias(out))
    return rows.join(t, ["repo", "path", "_k"], "left")


def status_transitions(files: DataFrame, lines: DataFrame) -> DataFrame:
    """C14: runtime status transitions for every status of the fixed set."""
    named = files.where(F.col("content").contains("status"))  # every pattern holds the word
    kinds = [(s, pname, pi, bonus, pat.replace("{s}", s)) for s in STATUSES for pi, (pname, pat, bonus) in enumerate(TRANSITION_PATTERNS)]
    m = many_matches(named, [(k, pat, (), None) for k, (*_, pat) in enumerate(kinds)])  # one exchange for all of them
    kind = _at(F.array(*[F.struct(F.lit(s).alias("status"), F.lit(pname).alias("pattern"), F.lit(pi).alias("pattern_no"), F.lit(bonus).alias("_bonus"))
                         for s, pname, pi, bonus, _ in kinds]), F.col("pid") + 1)
    m = m.select("repo", "path", "match_no", "line_no", kind.alias("_kind")).select("repo", "path", "match_no", "line_no", "_kind.*")
    m = m.withColumn("_k", F.concat_ws(":", "status", F.col("pattern_no").cast("string"), F.col("match_no").cast("string")))
    # the match line is line_no; the reference's window is 6 lines above to 2 below
    m = _window_text(m, lines, F.col("line_no") - 6, F.col("line_no") + 2, "_rt")
    m = m.where(~F.col("_rt").rlike(NOT_RUNTIME[0]) & ~F.col("_rt").rlike(NOT_RUNTIME[1]))
    m = _window_text(m, lines, F.col("line_no") - 3, F.col("line_no") + 3, "context")
    line = lines.select("repo", "path", "line_no", F.col("text").alias("_line"))
    return m.join(line, ["repo", "path", "line_no"], "left").drop("_rt", "_k")


def rank_for_entity(trans: DataFrame, targets: DataFrame) -> DataFrame:
    """T5: transitions for each target (name, status, entity) by confidence
    (0.5 + pattern bonus + 0.1 when the line mentions the entity), ties in
    (file, pattern, match) order."""
    j = targets.join(trans, (targets["status"] == trans["status"]) & (targets["t_repo"] == trans["repo"])) \
        .drop(trans["status"])
    conf = F.least(F.lit(1.0), F.lit(0.5) + F.col("_bonus") + F.when(
        F.lower(F.coalesce("_line", F.lit(""))).contains(F.lower("entity")) & (F.col("entity") != ""), 0.1).otherwise(0.0))
    j = j.withColumn("confidence", F.round(conf, 6))
    w = Window.partitionBy("t_repo", "name").orderBy(F.col("confidence").desc(), "path", "pattern_no", "match_no")
    return j.withColumn("rank", F.row_number().over(w))


def best_locations(gaps: DataFrame, files: DataFrame, lines: DataFrame) -> DataFrame:
    """Keep a known location; otherwise the best status transition of
    the name's status (for ``_started/_completed/_failed/_accepted/_rejected``
    names), else a file inferred from the name, else ``unknown``."""
    g = gaps.select(F.col("repo").alias("t_repo"), "name", "path", "line_no", "confidence")
    need = g.where(F.col("path").isNull() | (F.col("path") == "unknown") | (F.col("line_no") == 0))
    tg = need.select("t_repo", "name", F.regexp_extract("name", STATUS_SUFFIX, 1).alias("status"),
                     F.regexp_replace("name", r"_\w+$", "").alias("entity")).where(F.col("status") != "")
    tr = stored(status_transitions(files, lines))
    ranked = rank_for_entity(tr, tg).where(F.col("rank") == 1)
    st = ranked.select("t_repo", "name", F.col("path").alias("s_path"), F.col("line_no").alias("s_line"),
                       F.col("confidence").alias("s_conf"))
    nl = F.lower(F.col("name"))
    order = 0
    parts = []
    for words, pred, conf in INFER_RULES:
        cond = reduce(lambda a, b: a | b, [nl.contains(w) for w in words])
        # one path per repo and rule before the join
        first = files.where(pred(F.col("path"))).groupBy(F.col("repo").alias("t_repo")).agg(F.min("path").alias("i_path"))
        parts.append(need.where(cond).select("t_repo", "name").distinct().join(first, "t_repo")
                     .withColumn("_rule", F.lit(order)).withColumn("i_conf", F.lit(conf)))
        order += 1
    inferred = reduce(lambda a, b: a.unionByName(b), parts)
    inferred = inferred.withColumn("_r", F.row_number().over(Window.partitionBy("t_repo", "name").orderBy("_rule"))) \
        .where("_r = 1").drop("_r", "_rule")
    x = g.join(st, ["t_repo", "name"], "left").join(inferred, ["t_repo", "name"], "left")
    known = F.col("path").isNotNull() & (F.col("path") != "unknown") & (F.col("line_no") != 0)
    return x.select(
        F.col("t_repo").alias("repo"), "name",
        F.when(known, F.col("path")).when(F.col("s_path").isNotNull(), F.col("s_path")).when(F.col("i_path").isNotNull(), F.col("i_path"))
        .otherwise(F.lit("unknown")).alias("file"),
        F.when(known, F.col("line_no")).when(F.col("s_path").isNotNull(), F.col("s_line"))
        .when(F.col("i_path").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("line"),
        F.when(known, F.col("confidence")).when(F.col("s_path").isNotNull(), F.col("s_conf"))
        .when(F.col("i_path").isNotNull(), F.col("i_conf")).otherwise(F.lit(0.1)).alias("confidence"),
        F.when(known, F.lit("detected")).when(F.col("s_path").isNotNull(), F.lit("status_transition"))
        .when(F.col("i_path").isNotNull(), F.lit("inferred")).otherwise(F.lit("unknown")).alias("hint"))
