"""Pages, review feedback and plan exports."""

from __future__ import annotations

from pyspark.sql import functions as F
from ..functions.util import at as _at

from ..operators import exports as X
from ..operators import feedback as FB
from ..operators import pages as PG
from ..sources import tables as T
from . import fixtures as fx
from .catalog import query
from .q_plan import MERGED_DUCK, merged_plan

# --- S17 -------------------------------------------------------------------------


def _dq(p):
    return "'" + p.replace("'", "''") + "'"


def _squash_d(x):
    return f"regexp_replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


def _tag_d(pats):
    pats = [pats] if isinstance(pats, str) else pats
    return "coalesce(" + ", ".join(f"nullif({_squash_d(f'regexp_extract(html, {_dq(p)}, 1)')}, '')" for p in pats) + ", '')"


def _decode_d(x):
    for a, b in PG.ENTITIES:
        x = f"replace({x}, {_dq(a)}, {_dq(b)})"
    return x


def _strip_d(x):
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


PAGE_DUCK = f"""WITH t AS (
  SELECT page_id, url, html, {_tag_d(PG.TITLE)} AS title, {_tag_d(PG.OG_TITLE)} AS og_title,
         {_tag_d(PG.DESC)} AS descr, {_tag_d(PG.OG_DESC)} AS og_desc,
         list_filter(list_transform(regexp_extract_all(html, {_dq(PG.HEADING)}, 1), lambda s: {_decode_d(_strip_d('s'))}),
                     lambda s: length(s) > 3)[1:5] AS heads
  FROM pages)
SELECT page_id, url,
  CASE WHEN title <> '' THEN {_decode_d('title')} END AS title,
  CASE WHEN og_title <> '' AND og_title <> title THEN {_decode_d('og_title')} END AS og_title,
  CASE WHEN descr <> '' THEN {_decode_d('descr')} END AS description,
  CASE WHEN og_desc <> '' AND og_desc <> descr THEN {_decode_d('og_desc')} END AS og_description,
  CASE WHEN len(heads) > 0 THEN array_to_string(heads, ' · ') END AS headings
FROM t"""


@query("page_metadata", oracle=PAGE_DUCK)
def q_page_metadata(spark, sf_dir):
    return PG.page_metadata(T.read_table(spark, sf_dir, "pages"))


# --- feedback ------------------------------------------------------------------------

EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


def review_comments(conv):
    """Review comments derived from the given conversations: every fifth
    turn carries a reject tag, others a heading with or without a thumbs
    down, or a reject tag naming a real event type."""
    word = F.lower(F.regexp_extract("text", r"([A-Za-z]{3,})", 1))
    evtype = _at(F.array(*[F.lit(e) for e in EVENT_TYPES]), (F.col("conv_id") % 5 + 1).cast("int"))
    name = F.concat(word, F.lit("_"), evtype)
    t = F.col("turn") % 5
    tag = FB.REJECT_TAG
    body = (F.when(t == 0, F.concat("text", F.lit(f"\n{tag} reject: "), name))
            .when(t == 1, F.concat(F.lit("Track `"), name, F.lit("` 👎\n"), "text"))
            .when(t == 2, F.concat(F.lit("Track `"), name, F.lit("`\n"), "text"))
            .when(t == 3, F.concat("text", F.lit(f"\n{tag} reject: "), evtype))
            .otherwise(F.col("text")))
    return conv.select(F.concat(F.lit("repo"), (F.col("conv_id") % 5).cast("string")).alias("repo"),
                       (F.col("conv_id") % 13 + 1).cast("int").alias("pr"),
                       F.concat(F.lit("src/components/C"), F.col("conv_id").cast("string"), F.lit(".tsx")).alias("path"),
                       (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), body.alias("body"))


COMMENTS_DUCK = f"""comments AS (
  SELECT 'repo' || CAST(conv_id % 5 AS VARCHAR) AS repo, CAST(conv_id % 13 + 1 AS INT) AS pr,
         'src/components/C' || CAST(conv_id AS VARCHAR) || '.tsx' AS path, conv_id * 1000 + turn AS seq,
         CASE turn % 5
           WHEN 0 THEN text || chr(10) || '{FB.REJECT_TAG} reject: ' || nm
           WHEN 1 THEN 'Track `' || nm || '` 👎' || chr(10) || text
           WHEN 2 THEN 'Track `' || nm || '`' || chr(10) || text
           WHEN 3 THEN text || chr(10) || '{FB.REJECT_TAG} reject: ' || ev
           ELSE text END AS body
  FROM (SELECT *, {EVENT_TYPES!r}[conv_id % 5 + 1] AS ev,
               lower(regexp_extract(text, '([A-Za-z]{{3,}})', 1)) || '_' || {EVENT_TYPES!r}[conv_id % 5 + 1] AS nm
        FROM conversations) c),
facts AS (
  SELECT repo, lower(coalesce(nullif(regexp_extract(body, '(?i){FB.REJECT_TAG}\\s*reject\\s*:\\s*([a-z0-9_]+)', 1), ''),
         CASE WHEN contains(body, '👎') OR contains(lower(body), 'thumbs down')
              THEN nullif(regexp_extract(body, '(?i)Track\\s+`([a-z0-9_]+)`', 1), '') END)) AS event_name,
         'rejected' AS verdict, pr, path, seq
  FROM comments)"""


def facts(spark, sf_dir):
    return FB.feedback_facts(review_comments(T.read_table(spark, sf_dir, "conversations")))


@query("feedback_from_comments", oracle=fx.with_ctes(COMMENTS_DUCK) + "SELECT * FROM facts WHERE event_name IS NOT NULL")
def q_feedback_from_comments(spark, sf_dir):
    return facts(spark, sf_dir)


SUGG_DUCK = MERGED_DUCK.rstrip() + ",\n" + COMMENTS_DUCK + """,
sugg AS (SELECT 'repo' || CAST(repo_id AS VARCHAR) AS repo, id, name, status FROM merged)
"""


def suggestions(spark, sf_dir):
    m = merged_plan(spark, sf_dir)
    return m.select(F.concat(F.lit("repo"), F.col("repo_id").cast("string")).alias("repo"), "id", "name", "status")


@query("feedback_filter", oracle=SUGG_DUCK + """
SELECT s.* FROM sugg s WHERE NOT EXISTS (
  SELECT 1 FROM facts f WHERE f.event_name IS NOT NULL AND f.repo = s.repo AND f.event_name = lower(s.name))""")
def q_feedback_filter(spark, sf_dir):
    return FB.suppress_rejected(suggestions(spark, sf_dir), facts(spark, sf_dir))


@query("feedback_boost", oracle=SUGG_DUCK + """, acc AS (
  SELECT repo, lower(event_name) AS k, count(*) AS n FROM facts WHERE verdict = 'accepted' GROUP BY ALL)
SELECT s.*, CASE WHEN acc.n >= 5 THEN 0.2 WHEN acc.n >= 2 THEN 0.1 ELSE 0.0 END AS boost
FROM sugg s LEFT JOIN acc ON acc.repo = s.repo AND acc.k = lower(s.name)""")
def q_feedback_boost(spark, sf_dir):
    return FB.confidence_boost(suggestions(spark, sf_dir), facts(spark, sf_dir))


@query("feedback_state", oracle=fx.with_ctes(COMMENTS_DUCK) + """
SELECT repo, lower(event_name) AS event_name, count_if(verdict = 'accepted') AS n_accepted,
       count_if(verdict = 'rejected') AS n_rejected, arg_max(pr, seq) AS last_pr
FROM facts WHERE event_name IS NOT NULL GROUP BY ALL""")
def q_feedback_state(spark, sf_dir):
    return FB.feedback_state(facts(spark, sf_dir))


# --- exports ---------------------------------------------------------------------------

EXPORT_DUCK = MERGED_DUCK.rstrip() + ",\n" + fx.cte("plan_props", fx.PLAN_PROPS_SQL) + """,
mp AS (SELECT m.*, coalesce(p.description, 'Observed ' || m.name) AS description
       FROM merged m LEFT JOIN plan_events p ON p.repo_id = m.repo_id AND p.name = m.name),
act AS (SELECT * FROM mp WHERE status <> 'deprecated'),
obs AS (SELECT DISTINCT repo_id, lower(event_name) AS k, key AS prop,
               CASE WHEN json_type(properties, '$."' || key || '"') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number'
                    WHEN json_type(properties, '$."' || key || '"') = 'BOOLEAN' THEN 'boolean'
                    WHEN json_type(properties, '$."' || key || '"') = 'OBJECT' THEN 'object' ELSE 'string' END AS type
        FROM ev, unnest(json_keys(properties)) AS u(key)),
decl AS (SELECT a.repo_id, a.name, pp.prop, pp.type, pp.required, CAST(NULL AS VARCHAR) AS prop_description, pp.ord AS prop_ord
         FROM act a JOIN plan_props pp ON pp.event_name = a.name),
props AS (
  SELECT * FROM decl
  UNION ALL
  SELECT a.repo_id, a.name, o.prop, o.type, false, NULL, dense_rank() OVER (PARTITION BY a.repo_id, a.name ORDER BY o.prop)
  FROM act a JOIN obs o ON o.repo_id = a.repo_id AND o.k = lower(a.name)
  WHERE NOT EXISTS (SELECT 1 FROM decl d WHERE d.repo_id = a.repo_id AND d.name = a.name))
"""


def export_inputs(spark, sf_dir):
    ev = T.events(spark, sf_dir)
    m = merged_plan(spark, sf_dir)
    desc = T.plan_events(spark).select("repo_id", "name", F.col("description").alias("_d"))
    m = m.join(desc, ["repo_id", "name"], "left").withColumn(
        "description", F.coalesce("_d", F.concat(F.lit("Observed "), "name"))).drop("_d")
    props = X.export_props(m, T.plan_props(spark), X.observed_props(ev))
    return m, props


@query("export_segment", oracle=EXPORT_DUCK + """
SELECT a.repo_id, a.name AS event_name, a.description, p.prop,
       CASE WHEN p.type = 'date' THEN 'string' ELSE p.type END AS json_type, coalesce(p.required, false) AS is_required
FROM act a LEFT JOIN props p ON p.repo_id = a.repo_id AND p.name = a.name""")
def q_export_segment(spark, sf_dir):
    m, props = export_inputs(spark, sf_dir)
    return X.segment_rows(m, props)


@query("export_amplitude", oracle=EXPORT_DUCK + """
SELECT a.repo_id, a.name AS event_name, CASE WHEN a.priority IN ('critical', 'high') THEN 'core' ELSE 'other' END AS category,
       p.prop, CASE WHEN p.type = 'date' THEN 'string' WHEN p.type = 'object' THEN 'any' ELSE p.type END AS type,
       coalesce(p.required, false) AS is_required
FROM act a LEFT JOIN props p ON p.repo_id = a.repo_id AND p.name = a.name""")
def q_export_amplitude(spark, sf_dir):
    m, props = export_inputs(spark, sf_dir)
    return X.amplitude_rows(m, props)


@query("export_otel", oracle=EXPORT_DUCK + """, att AS (
  SELECT repo_id, name, string_agg(concat_ws(chr(10), '      - id: ' || prop,
           '        type: ' || CASE WHEN type = 'date' THEN 'string' WHEN type = 'object' THEN 'any' ELSE type END,
           '        requirement_level: ' || CASE WHEN required THEN 'required' ELSE 'recommended' END), chr(10) ORDER BY prop_ord) AS attrs
  FROM props GROUP BY ALL)
SELECT a.repo_id, a.name AS event_name,
  concat_ws(chr(10), '  - id: ' || a.name, '    type: event', '    brief: "' || replace(a.description, '"', '\\"') || '"',
            '    stability: experimental', CASE WHEN att.attrs IS NOT NULL THEN '    attributes:' END, att.attrs) AS yaml
FROM act a LEFT JOIN att ON att.repo_id = a.repo_id AND att.name = a.name""")
def q_export_otel(spark, sf_dir):
    m, props = export_inputs(spark, sf_dir)
    return X.otel_yaml(m, props)


@query("export_stream_rules", oracle=EXPORT_DUCK + """
SELECT repo_id, 'filter' AS kind, 'filter_' || name AS rule, name AS event_name, 'pass' AS action, CAST(NULL AS VARCHAR) AS required FROM act
UNION ALL
SELECT repo_id, 'transform', 'validate_' || name, name, 'validate', string_agg(prop, ',' ORDER BY prop_ord)
FROM props WHERE required GROUP BY repo_id, name""")
def q_export_stream_rules(spark, sf_dir):
    m, props = export_inputs(spark, sf_dir)
    return X.stream_rules(m, props)
