"""Plan document round trip, corpus fingerprints and delta, naming lint and
PII guard."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.util import LATER
from ..operators import conventions as CV
from ..session import scratch_path
from ..sources import corpus as S
from ..sources import plan_io as PIO
from ..sources import tables as T
from . import fixtures as fx
from .catalog import query
from .q_corpus import CL
from .q_plan import ISO, PLAN_IDS, merged_plan


@query("plan_roundtrip", oracle=fx.with_ctes(fx.EVENTS_CTE, PLAN_IDS) + f""", m AS (
SELECT coalesce(ex.repo_id, nw.repo_id) AS repo_id, coalesce(ex.id, nw.id) AS id,
  CASE WHEN ex.id IS NULL THEN nw.name WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.name ELSE ex.name END AS name,
  CASE WHEN ex.id IS NULL THEN nw.description WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.description ELSE ex.description END AS description,
  CASE WHEN ex.id IS NULL THEN nw.priority WHEN nw.id IS NOT NULL AND ex.status = 'suggested' THEN nw.priority ELSE ex.priority END AS priority,
  CASE WHEN ex.id IS NULL THEN nw.status ELSE ex.status END AS status,
  CASE WHEN ex.id IS NULL THEN nw.first_seen ELSE ex.first_seen END AS first_seen,
  CASE WHEN ex.id IS NULL THEN nw.last_seen
       WHEN nw.id IS NOT NULL AND ex.status IN ('suggested', 'approved', 'implemented')
       THEN strftime((SELECT now FROM nowt), '{ISO}') ELSE ex.last_seen END AS last_seen,
  CASE WHEN ex.id IS NULL THEN nw.location
       WHEN nw.id IS NOT NULL AND ex.status IN ('suggested', 'approved') THEN nw.location ELSE ex.location END AS location,
  coalesce(ex.ord, {LATER}) AS o
FROM ex FULL OUTER JOIN nw ON ex.repo_id = nw.repo_id AND ex.id = nw.id)
SELECT CAST(repo_id AS BIGINT) AS repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY o, id) AS INT) AS ord,
       id, name, description, priority, status, first_seen, last_seen, location FROM m""")
def q_plan_roundtrip(spark, sf_dir):
    """S4 then S3: the merged plan written as one JSON document per repo into
    the shared folder, read back with the plan schema and flattened."""
    path = scratch_path(spark, os.path.join("plans", uuid.uuid4().hex[:12]))
    PIO.write_plans(merged_plan(spark, sf_dir).withColumn("ord", F.struct("ord", "id")), path)
    return PIO.flatten(PIO.read_plans(spark, path)).withColumn("ord", F.col("ord").cast("int"))


SNAP = "2024-01-25 00:00:00"

FP_DUCK = fx.with_ctes(CL, f"""cl_prev AS (
  SELECT * FROM (
    SELECT concat('repo', CAST(user_id % 5 AS STRING)) AS repo,
      concat(CASE user_id % 4 WHEN 0 THEN 'src/components/U' WHEN 1 THEN 'src/app/api/orders/U'
             WHEN 2 THEN 'src/lib/U' ELSE 'src/pages/U' END, CAST(user_id AS STRING), '.tsx') AS path,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no, ts
    FROM events) WHERE ts < TIMESTAMP '{SNAP}'),
cur AS (SELECT repo, path, sha256(string_agg(text, chr(10) ORDER BY line_no)) AS content_hash
        FROM code_lines GROUP BY repo, path),
prev AS (SELECT c.repo, c.path, sha256(string_agg(c.text, chr(10) ORDER BY c.line_no)) AS content_hash
         FROM code_lines c JOIN cl_prev p USING (repo, path, line_no) GROUP BY c.repo, c.path)""")


def snapshots(spark, sf_dir):
    """Current corpus and the corpus as it was at the snapshot time (lines of
    events before it), both derived from the events table."""
    raw = T.read_table(spark, sf_dir, "events")
    cur = S.derived_code_lines(raw)
    prev = S.derived_code_lines(raw).join(
        S.derived_code_lines(raw.where(F.col("ts") < F.lit(SNAP).cast("timestamp_ntz"))).select("repo", "path", "line_no"),
        ["repo", "path", "line_no"], "left_semi")
    return S.to_files(cur), S.to_files(prev)


@query("corpus_delta", oracle=FP_DUCK + """
SELECT c.repo, c.path, c.content_hash FROM cur c
WHERE NOT EXISTS (SELECT 1 FROM prev p WHERE p.repo = c.repo AND p.path = c.path AND p.content_hash = c.content_hash)""")
def q_corpus_delta(spark, sf_dir):
    """Files whose content changed since the snapshot (only these would
    be re-analysed)."""
    cur, prev = snapshots(spark, sf_dir)
    return S.changed_files(cur, S.fingerprints(prev))


@query("corpus_fingerprint", oracle=FP_DUCK + """
SELECT repo, sha256(string_agg(part || '|' || h, chr(10) ORDER BY part || '|' || h)) AS corpus_hash, sum(n) AS n_files
FROM (SELECT repo, substr(md5(path), 1, 3) AS part, count(*) AS n,
             sha256(string_agg(path || '|' || content_hash, chr(10) ORDER BY path || '|' || content_hash)) AS h
      FROM cur GROUP BY 1, 2) GROUP BY repo""")
def q_corpus_fingerprint(spark, sf_dir):
    """One content hash per repo, in two levels over its ``path|hash`` entries."""
    cur, _ = snapshots(spark, sf_dir)
    return S.corpus_hash(S.fingerprints(cur))


@query("convention_name_lint", oracle=fx.with_ctes(fx.EVENTS_CTE, CL, f"""names AS (
  SELECT DISTINCT event_name AS name FROM ev
  UNION SELECT DISTINCT regexp_extract(text, 'track\\(''([^'']+)''', 1) FROM code_lines WHERE regexp_matches(text, 'track\\(''([^'']+)'''))""") + f"""
SELECT name, regexp_matches(name, '{CV.SNAKE}') AS is_snake_case,
  CASE WHEN string_split(name, '_')[-1] IN ({", ".join(repr(x) for x in CV.LIFECYCLES)}) THEN string_split(name, '_')[-1] END AS lifecycle,
  regexp_matches(name, '{CV.SNAKE}') AND len(string_split(name, '_')) >=
    (CASE WHEN string_split(name, '_')[-1] IN ({", ".join(repr(x) for x in CV.LIFECYCLES)}) THEN 3 ELSE 2 END) AS follows_convention
FROM names""")
def q_convention_name_lint(spark, sf_dir):
    """Received and tracked event names against object_action[_lifecycle]."""
    ev = T.events(spark, sf_dir).select(F.col("event_name").alias("name"))
    calls = S.code_lines(spark, sf_dir).select(F.regexp_extract("text", r"track\('([^']+)'", 1).alias("name")) \
        .where(F.col("name") != "")
    return CV.name_lint(ev.unionByName(calls).distinct())


@query("property_pii", oracle="SELECT doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, '{p}')) AS n_{k}" for k, p in CV.PII_PATTERNS.items()) + " FROM documents")
def q_property_pii(spark, sf_dir):
    """Personal data (email, phone, card number) found in whole texts."""
    return CV.pii_counts(T.read_table(spark, sf_dir, "documents"), "text", "doc_id")
