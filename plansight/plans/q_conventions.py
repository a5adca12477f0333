"""Convention queries: domain activation, coverage and payload checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conventions as CV
from ..operators import corpus as K
from ..sources import corpus as S
from ..sources import tables as T
from . import duck as D
from . import fixtures as fx
from .catalog import query
from .q_corpus import CL, INV_DUCK


REASON_TESTS = {"name contains": "contains(e.name, {})", "name is": "e.name = {}", "domain is": "e.domain = {}"}


def conv_attrs(spark):
    return T.dim(spark, fx.CONV_ATTRS_SQL).withColumn("values", F.split("values_list", r"\|")).drop("values_list")


def _domain_duck():
    parts = []
    for dom, sig in CV.SIGNALS.items():
        p = " OR ".join(f"contains(lower(replace(path, chr(92), '/')), {D.q(x)})" for x in sig["paths"])
        c = " OR ".join(f"contains(content, {D.q(x)})" for x in sig["components"])
        r = " OR ".join(f"regexp_matches(content, {D.q('(?i)' + x)})" for x in sig["patterns"])
        parts.append(f"""SELECT repo, '{dom}' AS domain, bool_or({p}) AS path_signal, bool_or({c}) AS component_signal,
       bool_or({r}) AS pattern_signal FROM files GROUP BY repo""")
    return "\nUNION ALL\n".join(parts)


@query("domain_activation", oracle=fx.with_ctes(CL, """files AS (
  SELECT repo, path, string_agg(text, chr(10) ORDER BY line_no) AS content FROM code_lines GROUP BY repo, path)""")
       + "SELECT *, CAST(path_signal AS INT) + CAST(component_signal AS INT) + CAST(pattern_signal AS INT) AS n_signal_types,"
       + " CAST(path_signal AS INT) + CAST(component_signal AS INT) + CAST(pattern_signal AS INT) >= 2 AS active FROM ("
       + _domain_duck() + ") x")
def q_domain_activation(spark, sf_dir):
    """Convention domains signalled by at least two signal types."""
    _, files = S.corpus_tables(spark, sf_dir)
    return CV.domain_activation(files)


@query("convention_coverage", oracle=INV_DUCK.rstrip() + ",\n" + fx.cte("conv_events", fx.CONV_EVENTS_SQL) + ",\n"
       + fx.cte("conv_attrs", fx.CONV_ATTRS_SQL) + f""",
first AS (SELECT repo, lower(name) AS k, arg_min(path, (path, pattern_no, line_no, pos)) AS path,
                 arg_min(line_no, (path, pattern_no, line_no, pos)) AS line_no FROM calls GROUP BY repo, lower(name)),
m AS (SELECT f.repo, e.domain, e.name, f.path, f.line_no FROM conv_events e JOIN first f ON f.k = lower(e.name)),
ctx AS (SELECT m.repo, m.domain, m.name, string_agg(c.text, chr(10) ORDER BY c.line_no) AS ctx
        FROM m JOIN code_lines c ON c.repo = m.repo AND c.path = m.path AND c.line_no BETWEEN m.line_no AND m.line_no + 5
        GROUP BY ALL),
miss AS (SELECT x.repo, x.domain, x.name, string_agg(a.attr, ',' ORDER BY a.ord) AS mr
         FROM ctx x JOIN conv_attrs a ON a.event_name = x.name AND a.required
         WHERE NOT regexp_matches(x.ctx, '["'']?' || replace(a.attr, '_', '[_s]?') || '["'']?\\s*:')
           AND NOT regexp_matches(x.ctx, '\\b' || a.attr || '\\b')
         GROUP BY ALL),
hn AS (SELECT event_name, string_agg(CASE WHEN type = 'enum' AND values_list IS NOT NULL
                                          THEN attr || ' (enum: ' || replace(values_list, '|', ', ') || ')' ELSE attr END,
                                     ', ' ORDER BY ord) AS required_hint FROM conv_attrs WHERE required GROUP BY 1),
rl AS (SELECT event_name, string_agg(CASE WHEN type = 'enum' AND values_list IS NOT NULL THEN attr || ' (enum)' ELSE attr END,
                                   ',' ORDER BY ord) AS req FROM conv_attrs WHERE required GROUP BY 1)
SELECT m.repo, m.domain, m.name, 'matched' AS state, m.path || ':' || CAST(m.line_no AS VARCHAR) AS location,
       coalesce(miss.mr, '') AS missing_required, CAST(NULL AS VARCHAR) AS reason, hn.required_hint
FROM m LEFT JOIN miss ON miss.repo = m.repo AND miss.domain = m.domain AND miss.name = m.name
LEFT JOIN hn ON hn.event_name = m.name
UNION ALL
SELECT repos.repo, e.domain, e.name, 'missing', NULL, coalesce(rl.req, ''),
  CASE {" ".join(f"WHEN {REASON_TESTS[t].format(D.q(v))} THEN {D.q(x)}" for t, v, x in CV.MISSING_REASONS)}
       ELSE {D.q(CV.NO_REASON)} END, CAST(NULL AS VARCHAR)
FROM conv_events e CROSS JOIN (SELECT DISTINCT repo FROM code_lines) repos LEFT JOIN rl ON rl.event_name = e.name
WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.repo = repos.repo AND f.k = lower(e.name))""")
def q_convention_coverage(spark, sf_dir):
    """Per repo, convention events matched in the corpus (with missing
    required attributes near the call) or missing (with the reason). Every
    repo is taken to have all domains; ``domain_activation`` finds the active
    ones where signals exist."""
    lines, files = S.corpus_tables(spark, sf_dir)
    calls = K.inventory_calls(files)
    order = F.struct("path", "pattern_no", "offset")
    first = calls.groupBy("repo", F.lower("name").alias("key")).agg(
        F.min_by("path", order).alias("path"), F.min_by("line_no", order).alias("line_no"))
    conv = T.dim(spark, fx.CONV_EVENTS_SQL)
    # repos x domains: two small dimensions
    every = conv.select(F.collect_set("domain").alias("d"))
    domains = lines.select("repo").distinct().select("repo", F.explode(every.scalar()).alias("domain"))
    return CV.convention_coverage(conv, conv_attrs(spark), first, lines, domains)


@query("convention_payload_check", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("conv_attrs", fx.CONV_ATTRS_SQL)) + """,
j AS (SELECT e.event_id, e.event_name, a.attr, a.type, a.required, string_split(a.values_list, '|') AS vals,
             coalesce(list_contains(json_keys(e.properties), a.attr), false) AS present,
             json_type(e.properties, '$."' || a.attr || '"') AS vt,
             json_extract_string(e.properties, '$."' || a.attr || '"') AS v
      FROM ev e JOIN conv_attrs a ON lower(a.event_name) = lower(e.event_name)),
t AS (SELECT *, CASE WHEN vt IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'number' WHEN vt = 'VARCHAR' THEN 'string'
                     WHEN vt = 'BOOLEAN' THEN 'boolean' WHEN vt = 'OBJECT' THEN 'object' WHEN vt = 'ARRAY' THEN 'array'
                     WHEN vt = 'NULL' THEN 'null' ELSE lower(vt) END AS actual FROM j)
SELECT event_id, event_name, attr, violation FROM (
  SELECT *, CASE WHEN required AND NOT present THEN 'missing'
                 WHEN present AND type = 'enum' AND actual = 'string' AND NOT list_contains(vals, v) THEN 'not_in_enum'
                 WHEN present AND actual <> (CASE WHEN type IN ('enum', 'string') THEN 'string' ELSE type END) THEN 'type_mismatch'
            END AS violation FROM t) WHERE violation IS NOT NULL""")
def q_convention_payload_check(spark, sf_dir):
    """Live events checked against the convention's attributes."""
    return CV.payload_check(T.events(spark, sf_dir), conv_attrs(spark))
