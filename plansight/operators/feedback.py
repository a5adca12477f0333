"""Review feedback: rejections from comments, suppression, boosts, state.

Feedback is an append-only fact table ``(repo, event_name, verdict, pr,
path, seq)``; the per-repo state is an aggregate over it, so concurrent
writers never lose an update (the reference rewrites one JSON per repo).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tag word of "<tag> reject: <event>" comments. The reference uses its
# own product name; here it is a parameter with this package's name.
REJECT_TAG = "plansight"
HEADING = r"(?i)Track\s+`([a-z0-9_]+)`"


def rejected_name(body: Column, tag: str = REJECT_TAG) -> Column:
    """Event rejected by a review comment, lower-cased, else null."""
    by_tag = F.nullif(F.regexp_extract(body, rf"(?i){tag}\s*reject\s*:\s*([a-z0-9_]+)", 1), F.lit(""))
    by_head = F.nullif(F.regexp_extract(body, HEADING, 1), F.lit(""))
    thumbs = body.contains("👎") | F.lower(body).contains("thumbs down")
    return F.lower(F.coalesce(by_tag, F.when(thumbs, by_head)))


def feedback_facts(comments: DataFrame, tag: str = REJECT_TAG) -> DataFrame:
    return (comments.withColumn("event_name", rejected_name(F.col("body"), tag))
            .where(F.col("event_name").isNotNull())
            .select("repo", "event_name", F.lit("rejected").alias("verdict"), "pr", "path", "seq"))


def suppress_rejected(suggestions: DataFrame, facts: DataFrame) -> DataFrame:
    """Drop suggestions whose lower-cased name was rejected in the repo."""
    rej = facts.where(F.col("verdict") == "rejected").select("repo", F.lower("event_name").alias("_k")).distinct()
    return suggestions.join(rej, (suggestions["repo"] == rej["repo"]) & (F.lower(suggestions["name"]) == rej["_k"]),
                            "left_anti")


def confidence_boost(suggestions: DataFrame, facts: DataFrame) -> DataFrame:
    """+0.2 for >= 5 acceptances of the name in the repo, +0.1 for >= 2."""
    acc = (facts.where(F.col("verdict") == "accepted")
           .groupBy("repo", F.lower("event_name").alias("_k")).agg(F.count(F.lit(1)).alias("_n")))
    j = suggestions.join(acc, (suggestions["repo"] == acc["repo"]) & (F.lower(suggestions["name"]) == acc["_k"]), "left")
    boost = F.when(F.col("_n") >= 5, 0.2).when(F.col("_n") >= 2, 0.1).otherwise(0.0)
    return j.select(suggestions["*"], boost.alias("boost"))


def feedback_state(facts: DataFrame) -> DataFrame:
    """ST11: state per (repo, event name) from the fact log: how often it was
    accepted / rejected and the last PR that said so."""
    return facts.groupBy("repo", F.lower("event_name").alias("event_name")).agg(
        F.count_if(F.col("verdict") == "accepted").alias("n_accepted"),
        F.count_if(F.col("verdict") == "rejected").alias("n_rejected"),
        F.max_by("pr", "seq").alias("last_pr"))
