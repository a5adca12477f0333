"""Pull-request queries: added lines, markers, plan sync, new interactions,
comment anchors and the PR gap report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import feedback as FB
from ..operators import patches as PT
from ..operators import plan as P
from ..operators import synthesis as Y
from ..session import materialize, stored
from ..sources import corpus as S
from ..sources import patches as SP
from ..sources import tables as T
from . import fixtures as fx
from .catalog import query
from .q_corpus import CL, INTER_DUCK
from .q_misc import facts as feedback_facts
from .q_plan import MERGED_DUCK, merged_plan

# Added lines follow from the construction: lines a..n of every file, plus the
# marker line n+1 for every third user; diff line = 3 + (right line - s).
ADDED_DUCK = """pl AS (SELECT repo, path, max(line_no) AS n, CAST(regexp_extract(path, 'U(\\d+)\\.tsx$', 1) AS INT) AS u
       FROM code_lines GROUP BY repo, path),
pl2 AS (SELECT *, greatest(n - 4, 1) AS a, greatest(greatest(n - 4, 1) - 3, 1) AS s,
               CAST(length(path) % 5 + 1 AS INT) AS pr FROM pl),
added AS (
  SELECT c.repo, p.pr, c.path, c.line_no, 3 + (c.line_no - p.s) AS diff_line
  FROM code_lines c JOIN pl2 p ON p.repo = c.repo AND p.path = c.path WHERE c.line_no >= p.a
  UNION ALL
  SELECT repo, pr, path, n + 1, 3 + (n + 1 - s) FROM pl2 WHERE u % 3 = 0)"""


def lines_and_patches(spark, sf_dir):
    lines, files = S.corpus_tables(spark, sf_dir)
    return lines, files, stored(SP.derived_patches(lines))


@query("patch_added_lines", oracle=fx.with_ctes(CL, ADDED_DUCK) + "SELECT * FROM added")
def q_patch_added_lines(spark, sf_dir):
    """Right-side line numbers of added lines, from unified diffs."""
    _, _, patches = lines_and_patches(spark, sf_dir)
    return PT.added_lines(patches)


MARKS_DUCK = f"""marks AS (
  SELECT DISTINCT repo, pr, {SP.MARKED_EVENTS!r}[(u // 3) % {len(SP.MARKED_EVENTS)} + 1] AS event_name
  FROM pl2 WHERE u % 3 = 0)"""


@query("patch_implemented", oracle=fx.with_ctes(CL, ADDED_DUCK, MARKS_DUCK) + "SELECT * FROM marks")
def q_patch_implemented(spark, sf_dir):
    """Events marked implemented in the added lines of each PR."""
    _, _, patches = lines_and_patches(spark, sf_dir)
    return PT.implemented_markers(patches)


@query("plan_mark_implemented", oracle=MERGED_DUCK.rstrip() + ",\n" + CL + ",\n" + ADDED_DUCK + ",\n" + MARKS_DUCK + """
SELECT m.repo_id, m.id, m.name,
  CASE WHEN EXISTS (SELECT 1 FROM marks k WHERE k.repo = 'repo' || CAST(m.repo_id AS VARCHAR) AND k.event_name = lower(m.name))
       THEN 'implemented' ELSE m.status END AS status
FROM merged m""")
def q_plan_mark_implemented(spark, sf_dir):
    """Merged PR markers promote plan events to implemented (from any
    status, deprecated included)."""
    _, _, patches = lines_and_patches(spark, sf_dir)
    marks = PT.implemented_markers(patches).select(
        F.regexp_extract("repo", r"(\d+)$", 1).cast("int").alias("repo_id"), "event_name")
    m = merged_plan(spark, sf_dir)
    now = T.events(spark, sf_dir).agg(F.max("received_at")).scalar()
    return P.mark_implemented(m, marks, now).select("repo_id", "id", "name", "status")


NEW_DUCK = INTER_DUCK.rstrip() + ",\n" + ADDED_DUCK + """,
newi AS (SELECT i.repo, a.pr, i.path, i.line_no, i.function_name, i.type, i.confidence
         FROM inter i JOIN added a ON a.repo = i.repo AND a.path = i.path AND a.line_no = i.line_no)
"""


def pr_interactions(spark, sf_dir):
    lines, files, patches = lines_and_patches(spark, sf_dir)
    inter = materialize(K.interactions(files, lines))
    return inter, PT.added_lines(patches)


@query("patch_new_interactions", oracle=NEW_DUCK + "SELECT * FROM newi")
def q_patch_new_interactions(spark, sf_dir):
    """Interactions on lines the PR adds."""
    inter, added = pr_interactions(spark, sf_dir)
    return PT.new_interactions(inter, added).select("repo", "pr", "path", "line_no", "function_name", "type",
                                                     "confidence")


@query("patch_anchor", oracle=INTER_DUCK.rstrip() + ",\n" + ADDED_DUCK + """
SELECT i.repo, a.pr, i.path, i.function_name AS name, i.line_no AS src_line,
       arg_min(a.line_no, (abs(a.line_no - i.line_no), a.line_no)) AS anchor_line
FROM inter i JOIN added a ON a.repo = i.repo AND a.path = i.path
GROUP BY i.repo, a.pr, i.path, i.function_name, i.line_no""")
def q_patch_anchor(spark, sf_dir):
    """Where a suggestion for each interaction would be anchored in the PR."""
    inter, added = pr_interactions(spark, sf_dir)
    ev = inter.join(added.select("repo", "path", "pr").distinct(), ["repo", "path"]) \
        .select("repo", "pr", "path", F.col("function_name").alias("name"), "line_no")
    return PT.anchor_lines(ev, added)


@query("pr_gap_report")
def q_pr_gap_report(spark, sf_dir):
    """Events synthesized from a PR's new interactions, minus names the
    repo rejected, ranked per PR (rows-only; each step has its own oracle-checked
    query). ``patches.ranked`` takes a cap for a comment of limited length."""
    inter, added = pr_interactions(spark, sf_dir)
    new = PT.new_interactions(inter, added)
    scoped = new.withColumn("repo", F.concat_ws("#", "repo", F.col("pr").cast("string"))).drop("pr")
    ev = Y.synthesize(scoped)
    ev = ev.withColumn("pr", F.split("repo", "#")[1].cast("int")).withColumn("repo", F.split("repo", "#")[0])
    kept = FB.suppress_rejected(ev, feedback_facts(spark, sf_dir))
    return PT.ranked(kept, ["repo", "pr"], ["pos"]).select("repo", "pr", "rank", "n_more", "name", "path", "line_no", "priority")
