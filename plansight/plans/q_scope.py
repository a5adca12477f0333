"""Scope variables at interaction lines (C12) and inferred event properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as K
from ..operators import graph as G
from ..operators import scope as SC
from ..operators import synthesis as Y
from ..session import materialize
from ..sources import corpus as S
from . import duck as D
from .catalog import query
from .q_corpus import INTER_DUCK


def _names_of_d(g):
    items = f"list_filter(list_transform(string_split({g}, ','), lambda s: trim(s)), lambda s: s <> '')"
    pick = ("lambda s: CASE WHEN coalesce(trim(string_split(s, ':')[2]), '') <> '' "
            "THEN trim(string_split(s, ':')[2]) ELSE trim(string_split(s, ':')[1]) END")
    return f"list_filter(list_transform({items}, {pick}), lambda s: coalesce(s, '') <> '')"


def _vars_d(names, source):
    return f"list_transform({names}, lambda n: {{'name': n, 'type': CAST(NULL AS VARCHAR), 'source': {source}}})"


def _clean_d(t):
    x = f"regexp_replace(trim({t}), '[\\s=].*$', '')"
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '\\|.*$', ''), '&.*$', ''), '\\[\\]$', '')"
    return f"trim({x})"


EMPTY = "CAST([] AS STRUCT(name VARCHAR, type VARCHAR, source VARCHAR)[])"


def _decls_d(t):
    def rx(p, g=1):
        return f"regexp_extract({t}, {D.q(p)}, {g})"

    def has(p):
        return f"regexp_matches({t}, {D.q(p)})"
    us = (f"CASE WHEN {has(SC.USE_STATE)} THEN [{{'name': {rx(SC.USE_STATE)}, 'type': CASE WHEN {rx(SC.USE_STATE, 2)} <> '' "
          f"THEN {_clean_d(rx(SC.USE_STATE, 2))} END, 'source': 'useState'}}] ELSE {EMPTY} END")
    uc = (f"CASE WHEN {has(SC.USE_CONTEXT_D)} THEN {_vars_d(_names_of_d(rx(SC.USE_CONTEXT_D)), chr(39) + 'useContext' + chr(39))} "
          f"WHEN {has(SC.USE_CONTEXT)} THEN {_vars_d('[' + rx(SC.USE_CONTEXT) + ']', chr(39) + 'useContext' + chr(39))} ELSE {EMPTY} END")
    qsrc = f"(CASE WHEN {rx(SC.USE_QUERY_D, 2)} = 'Mutation' THEN 'useMutation' ELSE 'useQuery' END)"
    uq = (f"CASE WHEN {has(SC.USE_QUERY_D)} THEN {_vars_d(_names_of_d(rx(SC.USE_QUERY_D)), qsrc)} "
          f"WHEN {has(SC.USE_QUERY)} THEN {_vars_d('[' + rx(SC.USE_QUERY) + ']', chr(39) + 'useQuery' + chr(39))} ELSE {EMPTY} END")
    up = f"CASE WHEN {has(SC.USE_PARAMS)} THEN {_vars_d(_names_of_d(rx(SC.USE_PARAMS)), chr(39) + 'useParams' + chr(39))} ELSE {EMPTY} END"
    de = (f"CASE WHEN {has(SC.DESTRUCTURING)} THEN {_vars_d(_names_of_d(rx(SC.DESTRUCTURING)), chr(39) + 'destructured' + chr(39))} "
          f"ELSE {EMPTY} END")
    co = f"CASE WHEN {has(SC.CONST_DECL)} THEN {_vars_d('[' + rx(SC.CONST_DECL) + ']', chr(39) + 'const' + chr(39))} ELSE {EMPTY} END"
    return f"list_concat({us}, {uc}, {uq}, {up}, {de}, {co})"


FOLD = ("list_reduce(string_split(raw, ''), lambda acc, ch: {"
        "'p': CASE WHEN ch = '(' THEN acc.p + 1 WHEN ch = ')' THEN greatest(acc.p - 1, 0) ELSE acc.p END, "
        "'a': CASE WHEN ch = '<' THEN acc.a + 1 WHEN ch = '>' THEN greatest(acc.a - 1, 0) ELSE acc.a END, "
        "'b': CASE WHEN ch = '{' THEN acc.b + 1 WHEN ch = '}' THEN greatest(acc.b - 1, 0) ELSE acc.b END, "
        "'buf': CASE WHEN ch = ',' AND acc.p = 0 AND acc.a = 0 AND acc.b = 0 THEN '' ELSE acc.buf || ch END, "
        "'parts': CASE WHEN ch = ',' AND acc.p = 0 AND acc.a = 0 AND acc.b = 0 THEN list_append(acc.parts, acc.buf) ELSE acc.parts END}, "
        "{'p': 0, 'a': 0, 'b': 0, 'buf': '', 'parts': CAST([] AS VARCHAR[])})")

SCOPE_DUCK = INTER_DUCK.rstrip() + f""",
dl AS (SELECT *, (length(text) - length(replace(text, '{{', ''))) - (length(text) - length(replace(text, '}}', ''))) AS dd,
              (regexp_matches(text, {D.q(SC.FUNC_START_DECL)}) AND contains(text, '{{'))
              OR (regexp_matches(text, {D.q(SC.FUNC_START_ARROW)}) AND contains(text, '{{'))
              OR regexp_matches(text, {D.q(SC.FUNC_START_BLOCK)}) AS is_start FROM code_lines),
ds AS (SELECT *, coalesce(sum(dd) OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
              last_value(CASE WHEN is_start THEN line_no END IGNORE NULLS)
                OVER (PARTITION BY repo, path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM dl),
dep AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY repo, path ORDER BY line_no
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS depth FROM ds),
tg AS (SELECT DISTINCT i.repo, i.path, i.line_no, d.st, d.depth AS tdepth FROM inter i
       JOIN dep d ON d.repo = i.repo AND d.path = i.path AND d.line_no = i.line_no),
sg AS (SELECT t.*, trim(regexp_extract(d.text, {D.q(SC.PARAMS)}, 1)) AS raw, regexp_matches(d.text, {D.q(SC.PARAMS)}) AS has_p
       FROM tg t JOIN dep d ON d.repo = t.repo AND d.path = t.path AND d.line_no = t.st),
sp AS (SELECT *, CASE WHEN has_p AND raw <> '' THEN
             (CASE WHEN trim(f.buf) <> '' THEN list_append(f.parts, f.buf) ELSE f.parts END) ELSE CAST([] AS VARCHAR[]) END AS params
       FROM (SELECT *, {FOLD} AS f FROM sg)),
pe AS (SELECT repo, path, line_no, st AS decl_line, u.i - 1000000 AS pos, trim(u.p) AS p
       FROM sp, unnest(params) WITH ORDINALITY AS u(p, i)),
pv AS (SELECT repo, path, line_no, decl_line, pos, v.name, v.type, v.source FROM (
         SELECT *, CASE WHEN p = '' THEN {EMPTY}
                        WHEN regexp_matches(p, {D.q(SC.DESTRUCTURED_PARAM)})
                        THEN {_vars_d(_names_of_d(f"regexp_extract(p, {D.q(SC.DESTRUCTURED_PARAM)}, 1)"), "'parameter'")}
                        WHEN trim(string_split(coalesce(string_split(p, ':')[1], ''), '=')[1]) <> ''
                        THEN [{{'name': trim(string_split(coalesce(string_split(p, ':')[1], ''), '=')[1]),
                               'type': CASE WHEN coalesce(string_split(p, ':')[2], '') <> '' THEN {_clean_d("string_split(p, ':')[2]")} END,
                               'source': 'parameter'}}]
                        ELSE {EMPTY} END AS vs FROM pe), unnest(vs) AS x(v)),
dv AS (SELECT t.repo, t.path, t.line_no, d.line_no AS decl_line, u.i AS pos, u.v.name, u.v.type, u.v.source
       FROM tg t JOIN dep d ON d.repo = t.repo AND d.path = t.path
         AND d.line_no >= coalesce(t.st, 1) AND d.line_no < t.line_no AND d.depth <= t.tdepth,
       unnest({_decls_d('d.text')}) WITH ORDINALITY AS u(v, i)),
av AS (SELECT * FROM pv UNION ALL SELECT * FROM dv),
av2 AS (SELECT *, max(decl_line) OVER k AS maxl, min({{'l': decl_line, 'p': pos}}) OVER k AS f
        FROM av WINDOW k AS (PARTITION BY repo, path, line_no, name)),
bestv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, line_no, name
                           ORDER BY CASE WHEN decl_line = maxl THEN 0 ELSE 1 END,
                                    CASE WHEN coalesce(type, '') <> '' THEN 0 ELSE 1 END, pos) AS r FROM av2) WHERE r = 1)
"""


@query("scope_variables", oracle=SCOPE_DUCK + """
SELECT repo, path, line_no, row_number() OVER (PARTITION BY repo, path, line_no ORDER BY f.l, f.p) AS ord,
       name, CASE WHEN coalesce(type, '') <> '' THEN type END AS type, source, name AS access_path, decl_line FROM bestv""")
def q_scope_variables(spark, sf_dir):
    """Variables in scope at every detected interaction."""
    lines, files = S.corpus_tables(spark, sf_dir)
    inter = materialize(K.interactions(files, lines))
    return SC.scope_variables(lines, inter.select("repo", "path", "line_no"))


@query("inferred_properties")
def q_inferred_properties(spark, sf_dir):
    """Properties of every synthesized event - object id, parent and
    grandparent ids (corpus relationships and join paths), user id and
    lifecycle properties - verified against the variables in scope at the
    event's location (rows-only; the rules are unit-tested)."""
    lines, files = S.corpus_tables(spark, sf_dir)
    inter = materialize(K.interactions(files, lines))
    ev = materialize(Y.synthesize(inter)).select("repo", "name", "path", "line_no")
    scope = SC.scope_variables(lines, ev.select("repo", "path", "line_no"))
    objs = materialize(G.context_objects(files))
    rel = G.fk_relationships(files, objs)
    paths = G.join_paths(rel, keys=["repo"])
    lcs = G.lifecycles_from_code(files, objs)
    return SC.infer_properties(ev, scope, rel, paths, lifecycles=lcs)


@query("event_properties_from_code")
def q_event_properties_from_code(spark, sf_dir):
    """Properties read from the code of each interaction's file (typed
    parameter, untyped parameter use, DB return); rows-only - the derived
    corpus has none of these shapes; the rules are unit-tested."""
    lines, files = S.corpus_tables(spark, sf_dir)
    inter = materialize(K.interactions(files, lines))
    return SC.code_properties(inter, files)
