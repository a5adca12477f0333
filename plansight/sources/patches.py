"""Patch source: pull-request diffs derived from the corpus.

Every file gets a PR whose unified diff adds its last five lines (after up
to three context lines and one removed line); files of every third user also
add an implemented-event marker comment (naming a plan event) as the last
added line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from ..functions.util import at as _at

from ..operators.patches import MARKER_TAG

# Plan events that the marker comments of the derived PRs declare implemented.
MARKED_EVENTS = ["view", "click", "purchase", "signup", "legacy_click", "refund"]


def derived_patches(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("repo", "path")
    x = lines.withColumn("_n", F.max("line_no").over(w))
    a = F.greatest(F.col("_n") - 4, F.lit(1))
    s = F.greatest(a - 3, F.lit(1))
    x = x.withColumn("_a", a).withColumn("_s", s).where(F.col("line_no") >= F.col("_s"))
    body = x.withColumn("_txt", F.when(F.col("line_no") < F.col("_a"), F.concat(F.lit(" "), "text"))
                        .otherwise(F.concat(F.lit("+"), "text")))
    g = body.groupBy("repo", "path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_txt"))), lambda t: t["_txt"]),
                     "\n").alias("_body"),
        F.first("_n").alias("_n"), F.first("_a").alias("_a"), F.first("_s").alias("_s"))
    user = F.regexp_extract("path", r"U(\d+)\.tsx$", 1).cast("int")
    name = _at(F.array(*[F.lit(n) for n in MARKED_EVENTS]), (F.floor(user / 3) % len(MARKED_EVENTS) + 1).cast("int"))
    marker = F.when(user % 3 == 0, F.concat(F.lit(f"\n+// {MARKER_TAG}: "), name)).otherwise(F.lit(""))
    n_ctx = F.col("_a") - F.col("_s")
    header = F.concat(F.lit("@@ -"), F.col("_s").cast("string"), F.lit(","), (n_ctx + 1).cast("string"),
                      F.lit(" +"), F.col("_s").cast("string"), F.lit(","),
                      (n_ctx + F.col("_n") - F.col("_a") + 1 + F.when(marker != "", 1).otherwise(0)).cast("string"),
                      F.lit(" @@"))
    patch = F.concat(header, F.lit("\n-// removed line\n"), F.col("_body"), marker,
                     F.lit("\n\\ No newline at end of file"))
    return g.select("repo", (F.length("path") % 5 + 1).cast("int").alias("pr"), "path",
                    F.lit("modified").alias("status"), patch.alias("patch"))
