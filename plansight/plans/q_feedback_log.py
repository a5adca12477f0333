"""Feedback with acceptances, kept as a log (ST11) and used for boosts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import feedback as FB
from ..session import scratch_path
from ..sources import tables as T
from ..streaming import feedback_log as FL
from ..streaming import jobs as J
from . import fixtures as fx
from .catalog import query
from .q_misc import SUGG_DUCK, suggestions

#: Verdicts on planned and sent names, one per conversation turn; three of four accept.
NAMES = ["view", "Purchase", "error", "signup", "view", "click", "refund"]
VERDICTS_SQL = """SELECT 'repo' || CAST(conv_id % 5 AS STRING) AS repo, CASE (conv_id + turn) % 7 {names} END AS event_name,
  CASE WHEN (conv_id + turn) % 4 = 3 THEN 'rejected' ELSE 'accepted' END AS verdict, CAST(conv_id % 13 + 1 AS INT) AS pr,
  'src/C' || CAST(conv_id AS STRING) || '.tsx' AS path, conv_id * 1000 + turn AS seq
FROM {conversations} WHERE conv_id % 3 = 0""".replace("{names}", " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)))
VERDICTS = fx.cte("verdicts", VERDICTS_SQL.format(conversations="conversations"))


def verdicts(spark, sf_dir):
    return spark.sql(VERDICTS_SQL.format(conversations="{conversations}"), conversations=T.read_table(spark, sf_dir, "conversations"))


@query("stream_feedback", oracle=fx.with_ctes(VERDICTS) + """
SELECT repo, lower(event_name) AS event_name, count_if(verdict = 'accepted') AS n_accepted, count_if(verdict = 'rejected') AS n_rejected,
       arg_max(pr, seq) AS last_pr
FROM verdicts GROUP BY ALL""")
def q_stream_feedback(spark, sf_dir):
    """ST11: two writers follow their own streams of verdicts, with a compaction between them; the merged state is whole."""
    log = FL.FeedbackLog(spark, scratch_path(spark, os.path.join("feedback", uuid.uuid4().hex[:12])))
    rows = verdicts(spark, sf_dir)
    for writer, part in (("even", F.col("pr") % 2 == 0), ("odd", F.col("pr") % 2 == 1)):
        land = scratch_path(spark, os.path.join("landing", f"verdicts-{uuid.uuid4().hex[:12]}"))
        rows.where(part).write.parquet(land)
        _, ck = J.new_location(spark, "feedback")
        log.follow(J.file_stream(spark, land), ck, writer)
        if writer == "even":
            log.compact()
    return log.state()


@query("feedback_boosts", oracle=SUGG_DUCK.rstrip() + ",\n" + VERDICTS + """,
acc AS (SELECT repo, lower(event_name) AS k, count(*) AS n FROM verdicts WHERE verdict = 'accepted' GROUP BY ALL)
SELECT s.*, CAST(CASE WHEN acc.n >= 5 THEN 0.2 WHEN acc.n >= 2 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS boost
FROM sugg s LEFT JOIN acc ON acc.repo = s.repo AND acc.k = lower(s.name)""")
def q_feedback_boosts(spark, sf_dir):
    """J14 on names that were accepted: boosts of 0.2, 0.1 and none."""
    return FB.confidence_boost(suggestions(spark, sf_dir), verdicts(spark, sf_dir))
