"""Pull-request patches: added lines, markers, new interactions, anchors.

A patch is bounded by the size of one file's diff; every window here is per
(repo, pr, path). Interactions are joined to added lines with a semi join on
(path, line), never by scanning diffs per interaction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
# The implemented-event marker comment "// <tag>: <event>". The reference
# uses its product name as the tag; here it is a parameter.
MARKER_TAG = "plansight"


def patch_lines(patches: DataFrame) -> DataFrame:
    """Every patch line with its diff line number, and for added
    lines the right-side (new file) line number."""
    keys = ["repo", "pr", "path"]
    x = patches.select(*keys, F.posexplode(F.split("patch", "\n", -1)).alias("pos", "line"))
    x = x.withColumn("diff_line", F.col("pos") + 1)
    is_hunk = F.col("line").rlike(HUNK)
    w = Window.partitionBy(*keys).orderBy("pos")
    x = (x.withColumn("_hunk", F.sum(is_hunk.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_start", F.when(is_hunk, F.regexp_extract("line", HUNK, 1).cast("int"))))
    added = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    removed = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    counts = ~is_hunk & (added | (~removed & ~F.col("line").startswith("\\")))
    wh = Window.partitionBy(*keys, "_hunk").orderBy("pos")
    x = (x.withColumn("_s", F.max("_start").over(wh.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("_before", F.coalesce(F.sum(counts.cast("int")).over(wh.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # lines before the first hunk count from 0, as in the reference
    right = F.coalesce(F.col("_s"), F.lit(0)) + F.col("_before")
    return x.select(*keys, "diff_line", "line", added.alias("is_added"),
                    F.when(added, right).alias("right_line"))


def added_lines(patches: DataFrame) -> DataFrame:
    return patch_lines(patches).where("is_added").select("repo", "pr", "path", F.col("right_line").alias("line_no"),
                                                         "diff_line")


def implemented_markers(patches: DataFrame, tag: str = MARKER_TAG) -> DataFrame:
    """Event names marked implemented in added lines (lower-cased, distinct)."""
    pl = patch_lines(patches).where("is_added")
    name = F.lower(F.regexp_extract("line", rf"(?i)//\s*{tag}:\s*([a-z0-9_]+)", 1))
    return pl.where(name != "").select("repo", "pr", name.alias("event_name")).distinct()


def new_interactions(interactions: DataFrame, added: DataFrame) -> DataFrame:
    """Interactions that sit on an added line of the PR's file."""
    a = added.select("repo", "path", "line_no", "pr").distinct()
    return interactions.join(a, ["repo", "path", "line_no"], "inner")


def anchor_lines(events: DataFrame, added: DataFrame) -> DataFrame:
    """The added line a comment goes on: the event's own line when it was
    added, else the nearest added line of the file (earliest on ties)."""
    j = events.select("repo", "pr", "path", "name", F.col("line_no").alias("src_line")).join(
        added.select("repo", "pr", "path", "line_no"), ["repo", "pr", "path"])
    return j.groupBy("repo", "pr", "path", "name", "src_line").agg(
        F.min_by("line_no", F.struct(F.abs(F.col("line_no") - F.col("src_line")), F.col("line_no"))).alias("anchor_line"))


def ranked(df: DataFrame, keys: list[str], order: list, n: int | None = None) -> DataFrame:
    """T4: rows with their ``rank`` in the group; with ``n`` only the first n, and ``n_more``, how many follow."""
    w = Window.partitionBy(*keys).orderBy(*order)
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    out = df.withColumn("rank", F.row_number().over(w)).join(total, keys)
    if n is not None:
        out = out.where(F.col("rank") <= n)
    more = F.lit(0).cast("long") if n is None else F.greatest(F.col("_n") - n, F.lit(0))
    return out.withColumn("n_more", more).drop("_n")
