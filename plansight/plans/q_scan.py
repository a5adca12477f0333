"""Scan path queries: synthesized events, scores, gaps, scan coverage,
top gaps and interaction batches over the derived corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import graph as G
from ..operators import synthesis as Y
from ..sources import corpus as S
from . import duck as D
from . import fixtures as fx
from .catalog import query
from ..session import materialize, stored
from .q_corpus import CL, INTER_DUCK, INV_DUCK
from .q_graph import OBJ_DUCK


def parts(spark, sf_dir):
    """Corpus lines, files and interactions; files and interactions are
    checkpointed so the scoring plans stay small and restartable."""
    lines, files = S.corpus_tables(spark, sf_dir)
    inter = materialize(K.interactions(files, lines))
    return lines, files, inter


def synthesized(spark, sf_dir):
    _, _, inter = parts(spark, sf_dir)
    return Y.synthesize(inter)


def scored(spark, sf_dir):
    lines, files, inter = parts(spark, sf_dir)
    ev = materialize(Y.synthesize(inter))
    ents = ev.select("repo", Y.N.entity_of_scored(F.col("name")).alias("entity"))
    return Y.score(ev, materialize(G.context_objects(files)), K.cross_reference(lines, ents))


def _rxd(x, p, g):
    return f"nullif(regexp_extract({x}, {D.q(p)}, {g}), '')"


def _name_duck(t, fn):
    """F12 for the interaction types the corpus yields (route, mutation, UI)."""
    route_path = f"regexp_extract({fn}, {D.q(Y.ROUTE_FN)}, 2)"
    segs = (f"list_filter(list_transform(string_split({route_path}, '/'), lambda s: trim(s)), "
            f"lambda s: s <> '' AND NOT starts_with(s, ':') AND NOT regexp_matches(s, '(?i)^v\\d+$') AND lower(s) <> 'api')")
    meth = f"upper({_rxd(fn, Y.ROUTE_FN, 1)})"
    verb = f"(CASE {meth} WHEN 'POST' THEN 'created' WHEN 'PUT' THEN 'updated' WHEN 'PATCH' THEN 'updated' WHEN 'DELETE' THEN 'deleted' END)"
    route = (f"(CASE WHEN {meth} IS NOT NULL AND {segs}[-1] IS NOT NULL AND {verb} IS NOT NULL THEN "
             f"regexp_replace(replace({segs}[-1], '-', '_'), 's$', '') || '_' || {verb} END)")
    gv = f"lower(regexp_extract({fn}, {D.q(Y.GENERIC_CRUD_FN)}, 2))"
    gv2 = f"(CASE WHEN {gv} = 'insert' THEN 'create' WHEN {gv} IN ('destroy', 'remove') THEN 'delete' ELSE {gv} END)"
    mut = (f"(CASE WHEN {_rxd(fn, Y.GENERIC_CRUD_FN, 1)} IS NOT NULL THEN "
           f"regexp_replace({_rxd(fn, Y.GENERIC_CRUD_FN, 1)}, 's$', '') || '_' || {D.past_tense(gv2)} END)")
    name = f"regexp_replace(regexp_replace(regexp_replace({fn}, '^handle', ''), '^on', ''), '^use', '')"
    vo = (f"(CASE WHEN {_rxd(name, Y.VERB_OBJECT, 1)} IS NOT NULL THEN "
          f"{D.snake_from_camel(f'regexp_extract({name}, {D.q(Y.VERB_OBJECT)}, 2)')} || '_' || "
          f"{D.past_tense(f'regexp_extract({name}, {D.q(Y.VERB_OBJECT)}, 1)')} "
          f"WHEN {_rxd(name, Y.OBJECT_VERB, 1)} IS NOT NULL THEN "
          f"{D.snake_from_camel(f'regexp_extract({name}, {D.q(Y.OBJECT_VERB)}, 1)')} || '_' || "
          f"{D.past_tense(f'regexp_extract({name}, {D.q(Y.OBJECT_VERB)}, 2)')} END)")
    return f"(CASE WHEN {t} = 'route_handler' THEN {route} WHEN {t} = 'mutation' THEN {mut} ELSE {vo} END)"


SYN_DUCK = INTER_DUCK.rstrip() + f""",
inter2 AS (SELECT *, min({{'detector': detector, 'line_no': line_no}}) OVER (PARTITION BY repo, path, function_name) AS fpos FROM allx),
inter3 AS (SELECT i.*, (i.path, i.fpos.detector, i.fpos.line_no) AS pos
           FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, function_name ORDER BY confidence DESC, detector, line_no) AS rr
                 FROM inter2) i WHERE rr = 1),
named AS (SELECT *, {_name_duck('type', 'function_name')} AS name FROM inter3),
ev AS (SELECT repo, name, type || ': ' || function_name AS description,
              {D.priority_heuristic('name', 'type')} AS priority, {D.signal_type('type')} AS signal_type,
              path, line_no, context, confidence, trigger AS hint, pos, 1 AS n_sources
       FROM named WHERE name IS NOT NULL AND {D.is_valid_event_name('name')}),
p1 AS (SELECT repo, arg_min({{'name': name, 'description': description, 'priority': priority, 'signal_type': signal_type, 'path': path, 'line_no': line_no, 'context': context, 'confidence': confidence, 'hint': hint}},
                            (-confidence, pos)) AS w, min(pos) AS pos, sum(n_sources) AS n_sources
       FROM ev GROUP BY repo, lower(name)),
p1f AS (SELECT repo, w.name, w.description, w.priority, w.signal_type, w.path, w.line_no, w.context, w.confidence, w.hint,
               pos, n_sources FROM p1),
p2 AS (SELECT repo, arg_min({{'name': name, 'description': description, 'priority': priority, 'signal_type': signal_type, 'path': path, 'line_no': line_no, 'context': context, 'confidence': confidence, 'hint': hint}},
                            (-confidence, pos)) AS w, min(pos) AS pos, sum(n_sources) AS n_sources
       FROM p1f GROUP BY repo,
         array_to_string(string_split(name, '_')[1:len(string_split(name, '_')) - 1], '_') || ':' ||
         (CASE WHEN string_split(name, '_')[-1] IN ('created', 'added', 'inserted') THEN 'created'
               WHEN string_split(name, '_')[-1] IN ('deleted', 'removed', 'destroyed') THEN 'deleted'
               ELSE string_split(name, '_')[-1] END)),
syn AS (SELECT repo, w.name, w.description, w.priority, w.signal_type, w.path, w.line_no, w.context, w.confidence, w.hint,
               pos, n_sources FROM p2)
"""

SYN_COLS = "repo, name, description, priority, signal_type, path, line_no, confidence, hint, n_sources"


@query("synthesized_events", oracle=SYN_DUCK + f"SELECT {SYN_COLS} FROM syn")
def q_synthesized_events(spark, sf_dir):
    """C8 + A8-A10: business events named from the corpus interactions."""
    return synthesized(spark, sf_dir).select(*[c.strip() for c in SYN_COLS.split(",")])


def _merge_key_duck(name):
    """The key of A9: object and canonical verb."""
    parts = f"string_split({name}, '_')"
    return (f"(array_to_string({parts}[1:len({parts}) - 1], '_') || ':' || "
            f"(CASE WHEN {parts}[-1] IN ('created', 'added', 'inserted') THEN 'created' "
            f"WHEN {parts}[-1] IN ('deleted', 'removed', 'destroyed') THEN 'deleted' ELSE {parts}[-1] END))")


@query("event_sources", oracle=SYN_DUCK + f"""
SELECT n.repo, s.name, n.path AS source_path, n.function_name AS source_function
FROM named n JOIN p1f p ON p.repo = n.repo AND lower(p.name) = lower(n.name)
JOIN syn s ON s.repo = p.repo AND {_merge_key_duck('s.name')} = {_merge_key_duck('p.name')}
WHERE n.name IS NOT NULL AND {D.is_valid_event_name('n.name')}""")
def q_event_sources(spark, sf_dir):
    """The interactions (path and function of the repo) that each
    synthesized event came from, one row each."""
    _, _, inter = parts(spark, sf_dir)
    events, links = Y.synthesize_with_sources(inter)
    return links.join(events.select("repo", "pos", "name"), ["repo", "pos"]).select(
        "repo", "name", "source_path", "source_function")


OBJ_CTES = OBJ_DUCK[len("WITH " + CL + ",\n"):]


def _file_rel_d(p):
    expr = "CASE"
    for i, (pat, sc) in enumerate(Y.FILE_RELEVANCE):
        cond = f"regexp_matches(lower({p}), {D.q(pat)})"
        if pat == r"/hooks?/":
            cond = f"({cond} OR regexp_matches({p}, '/use[A-Z]'))"
        expr += f" WHEN {cond} THEN {sc}"
    return expr + " ELSE 0.1 END"


def _quality_d(e):
    parts = f"list_filter(string_split({e}, '_'), lambda p: p <> '')"
    bare = f"lower(replace({e}, '_', ''))"
    infra = ", ".join(D.q(x) for x in Y.INFRASTRUCTURE_ENTITIES)
    biz = ", ".join(D.q(x) for x in Y.BUSINESS_ENTITIES)
    return (f"(CASE WHEN coalesce({e}, '') = '' THEN 0.0 WHEN length({bare}) <= 2 THEN 0.0 "
            f"WHEN len({parts}) > 0 AND list_bool_and(list_transform({parts}, lambda p: lower(p) IN ({infra}))) THEN 0.02 "
            f"WHEN list_bool_or(list_transform({parts}, lambda p: lower(p) IN ({biz}))) THEN 0.15 "
            f"WHEN contains({e}, '_') THEN 0.1 WHEN length({bare}) >= 5 THEN 0.1 WHEN length({bare}) >= 3 THEN 0.08 ELSE 0.05 END)")


def _itype_d(h, p):
    return (f"(CASE WHEN regexp_matches({h}, '(?i)\\bonSubmit\\b') THEN 0.15 "
            f"WHEN regexp_matches({h}, '(?i)\\bonClick\\b') AND regexp_matches({h}, 'handle[A-Z]') THEN 0.12 "
            f"WHEN regexp_matches({h}, '\\buseMutation\\b') THEN 0.12 "
            f"WHEN regexp_matches({h}, '\\bexport\\s+function\\s+(POST|PUT|PATCH|DELETE)\\b') "
            f"OR regexp_matches({h}, {D.q(Y.HTTP_CALL)}) THEN 0.1 "
            f"WHEN regexp_matches({h}, '\\.(create|insert|update|delete|upsert|remove)\\s*\\(') THEN "
            f"(CASE WHEN regexp_matches({p}, '(?i)/(lib|utils?|helpers?)/') THEN 0.08 ELSE 0.1 END) "
            f"WHEN regexp_matches({h}, '(?i)\\bonClick\\b') THEN 0.05 "
            f"WHEN regexp_matches({h}, '(?i)\\bon(Change|Toggle)\\b') THEN 0.03 ELSE 0.05 END)")


SCORE_DUCK = SYN_DUCK.rstrip() + ",\n" + OBJ_CTES.rstrip() + f""",
se AS (SELECT *, {D.entity_of_scored('name')} AS entity FROM syn),
sm AS (SELECT se.repo, se.entity,
              arg_min(CASE WHEN o2 = en THEN 0.3 ELSE 0.2 END, o.ord) AS schema_match
       FROM (SELECT DISTINCT repo, entity, lower(replace(entity, '_', '')) AS en FROM se) se
       JOIN (SELECT repo, ord, lower(replace(name, '_', '')) AS o2 FROM objs2) o
         ON o.repo = se.repo AND (o2 = en OR (length(o2) >= 3 AND length(en) >= 3 AND (contains(o2, en) OR contains(en, o2))))
       GROUP BY se.repo, se.entity),
tok AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS token FROM code_lines),
xr AS (SELECT e.repo, e.entity, count(DISTINCT t.path) AS n_files
       FROM (SELECT DISTINCT repo, entity FROM se) e LEFT JOIN tok t ON t.repo = e.repo AND lower(t.token) = lower(e.entity)
       GROUP BY e.repo, e.entity),
sc AS (SELECT se.*, coalesce(sm.schema_match, 0.0) AS schema_match, {_file_rel_d('se.path')} AS file_relevance,
              CASE WHEN coalesce(se.entity, '') = '' THEN 0.03 WHEN xr.n_files >= 10 THEN 0.2 WHEN xr.n_files >= 5 THEN 0.15
                   WHEN xr.n_files >= 2 THEN 0.1 WHEN xr.n_files >= 1 THEN 0.03 ELSE 0.0 END AS cross_reference,
              {_quality_d('se.entity')} AS entity_quality, {_itype_d('se.hint', 'se.path')} AS interaction_type
       FROM se LEFT JOIN sm ON sm.repo = se.repo AND sm.entity = se.entity
       LEFT JOIN xr ON xr.repo = se.repo AND xr.entity = se.entity),
scored AS (SELECT *, round(least(1.0, schema_match + file_relevance + cross_reference + entity_quality + interaction_type), 6) AS relevance FROM sc)
"""

SCORE_COLS = "repo, name, entity, schema_match, file_relevance, cross_reference, entity_quality, interaction_type, relevance"


@query("scored_events", oracle=SCORE_DUCK + f"SELECT {SCORE_COLS} FROM scored")
def q_scored_events(spark, sf_dir):
    """Relevance breakdown of every synthesized event."""
    return scored(spark, sf_dir).select(*[c.strip() for c in SCORE_COLS.split(",")])


GAPS_DUCK = SCORE_DUCK.rstrip() + ",\n" + INV_DUCK[len("WITH " + CL + ",\n"):].rstrip() + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, lower(name) ORDER BY relevance DESC, pos) AS rb FROM scored)
         WHERE rb = 1 AND relevance >= 0.25),
gp AS (SELECT b.*, CASE WHEN relevance >= 0.7 THEN 'critical' WHEN relevance >= 0.55 THEN 'high'
                        WHEN relevance >= 0.4 THEN 'medium' ELSE 'low' END AS gap_priority
       FROM best b WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.repo = b.repo AND lower(c.name) = lower(b.name)))
"""


def gap_rows(spark, sf_dir):
    lines, files, inter = parts(spark, sf_dir)
    ev = materialize(Y.synthesize(inter))
    ents = ev.select("repo", Y.N.entity_of_scored(F.col("name")).alias("entity"))
    sc = Y.score(ev, materialize(G.context_objects(files)), K.cross_reference(lines, ents))
    existing = K.inventory(K.inventory_calls(files), lines)
    return Y.gaps(sc, existing), existing


@query("tracking_gaps", oracle=GAPS_DUCK + """
SELECT repo, name, gap_priority AS priority, relevance, path, line_no FROM gp""")
def q_tracking_gaps(spark, sf_dir):
    """C17 core: scored events above the threshold that are not tracked yet."""
    g, _ = gap_rows(spark, sf_dir)
    return g.select("repo", "name", "priority", "relevance", "path", "line_no")


@query("coverage_scan", oracle=GAPS_DUCK + f""", tr AS (SELECT repo, count(DISTINCT lower(name)) AS tracked FROM calls GROUP BY repo),
gc AS (SELECT repo, count(*) AS missing FROM gp GROUP BY repo)
SELECT coalesce(tr.repo, gc.repo) AS repo, coalesce(tr.tracked, 0) AS tracked, coalesce(gc.missing, 0) AS missing,
  CAST(CASE WHEN coalesce(tr.tracked, 0) + coalesce(gc.missing, 0) > 0
            THEN round(CAST(coalesce(tr.tracked, 0) AS DOUBLE) / (coalesce(tr.tracked, 0) + coalesce(gc.missing, 0)) * 100)
            ELSE 0 END AS BIGINT) AS percentage
FROM tr FULL OUTER JOIN gc ON gc.repo = tr.repo""")
def q_coverage_scan(spark, sf_dir):
    """A4(b): tracked events / (tracked + gaps)."""
    g, existing = gap_rows(spark, sf_dir)
    return Y.coverage_scan(existing, g)


@query("gaps_topk", oracle=GAPS_DUCK + f""", r AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {D.priority_rank('gap_priority')}, pos) AS rank,
         count(*) OVER (PARTITION BY repo) AS n_gaps FROM gp)
SELECT repo, rank, name, gap_priority AS priority, n_gaps, greatest(n_gaps - 20, 0) AS n_more FROM r WHERE rank <= 20""")
def q_gaps_topk(spark, sf_dir):
    """The first 20 gaps by priority, with the count not shown."""
    g, _ = gap_rows(spark, sf_dir)
    return Y.gaps_topk(g, 20).select("repo", "rank", "name", "priority", "n_gaps", "n_more")


@query("interaction_batches", oracle=INTER_DUCK.rstrip() + """,
inter2 AS (SELECT *, min({'detector': detector, 'line_no': line_no}) OVER (PARTITION BY repo, path, function_name) AS fpos FROM allx),
inter3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, function_name
                                                         ORDER BY confidence DESC, detector, line_no) AS rr FROM inter2) WHERE rr = 1),
ix AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, fpos.detector, fpos.line_no) - 1 AS idx FROM inter3)
SELECT repo, CAST(idx // 30 AS INT) AS batch, idx AS "index", path, function_name,
       string_split(path, '/')[-1] || '::' || coalesce(entities[1], 'unknown') AS group_hint FROM ix""")
def q_interaction_batches(spark, sf_dir):
    """Interactions packed in batches of 30 in discovery order."""
    _, _, inter = parts(spark, sf_dir)
    return Y.interaction_batches(inter, 30)


@query("best_location", oracle=GAPS_DUCK + """
SELECT repo, name, path AS file, line_no AS line, confidence, 'detected' AS hint FROM gp""")
def q_best_location(spark, sf_dir):
    """The location of every gap through the fallback chain (detected
    location, status transition, inferred file, unknown)."""
    from ..operators import locations as L
    g, _ = gap_rows(spark, sf_dir)
    g = stored(g.select("repo", "name", "path", "line_no", "confidence"))  # read by every step of the chain
    lines, files = S.corpus_tables(spark, sf_dir)
    return L.best_locations(g, files, lines)


@query("status_transition_locations")
def q_status_transition_locations(spark, sf_dir):
    """C14 + T5: runtime status transitions in the corpus with their pattern
    (rows-only: the derived corpus assigns no statuses; the rules are
    unit-tested)."""
    from ..operators import locations as L
    lines, files = S.corpus_tables(spark, sf_dir)
    return L.status_transitions(files, lines).select("repo", "path", "line_no", "status", "pattern", "context")
