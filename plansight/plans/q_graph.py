"""Context graph queries: objects, relationships, join paths, hierarchy
properties, ontology edges, lifecycles, and join-path execution on TPC-H."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import events as E
from ..operators import graph as G
from ..sources import corpus as S
from ..sources import tables as T
from . import duck as D
from . import fixtures as fx
from .catalog import query
from ..session import materialize
from .q_corpus import CL


def corpus(spark, sf_dir):
    return S.corpus_tables(spark, sf_dir)


def objects(spark, sf_dir):
    _, files = corpus(spark, sf_dir)
    return G.context_objects(files)


def relationships(spark, sf_dir):
    _, files = corpus(spark, sf_dir)
    return G.fk_relationships(files, materialize(G.context_objects(files)))


def _pascal(x):
    return D.pascal_keep_tail(x)


OBJ_DUCK = fx.with_ctes(CL, f"""om AS (
  SELECT repo, path, line_no, 0 AS pattern_no, u.pos, {_pascal('u.m')} AS name, 'prisma' AS source, false AS api
  FROM code_lines, unnest(regexp_extract_all(text, {D.q(G.PRISMA_MODEL)}, 1)) WITH ORDINALITY AS u(m, pos)
  UNION ALL
  SELECT repo, path, line_no, 1, u.pos, {_pascal("regexp_replace(u.m, 's$', '')")}, 'database', false
  FROM code_lines, unnest(regexp_extract_all(text, {D.q(G.SUPABASE_TABLE)}, 1)) WITH ORDINALITY AS u(m, pos)
  UNION ALL
  SELECT repo, path, line_no, 2, u.pos, {_pascal("replace(regexp_replace(u.m, 's$', ''), '-', '_')")}, 'inferred', true
  FROM code_lines, unnest(regexp_extract_all(text, {D.q(G.API_SEGMENT)}, 1)) WITH ORDINALITY AS u(m, pos)),
objs AS (
  SELECT repo, lower(name) AS key, arg_min(name, (path, pattern_no, line_no, pos)) AS name,
         arg_min(source, (path, pattern_no, line_no, pos)) AS source, bool_or(api) AS exposed_via_api,
         'id' AS properties, min((path, pattern_no, line_no, pos)) AS f
  FROM om GROUP BY repo, lower(name)),
objs2 AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY f) AS ord FROM objs)""")


@query("context_objects", oracle=OBJ_DUCK + "SELECT repo, key, name, source, exposed_via_api, properties, ord FROM objs2")
def q_context_objects(spark, sf_dir):
    return objects(spark, sf_dir)


REL_DUCK = OBJ_DUCK.rstrip() + f""",
prim AS (
  SELECT repo, path,
    coalesce(arg_min({_pascal(f"nullif(regexp_extract(text, {D.q(G.PRISMA_ANY)}, 1), '')")}, line_no)
               FILTER (WHERE regexp_matches(text, {D.q(G.PRISMA_ANY)})),
             arg_min({_pascal(f"regexp_replace(regexp_extract(text, {D.q(G.SUPABASE_TABLE)}, 1), 's$', '')")}, line_no)
               FILTER (WHERE regexp_matches(text, {D.q(G.SUPABASE_TABLE)})),
             arg_min({_pascal(f"replace(regexp_replace(regexp_extract(text, {D.q(G.API_ANY)}, 1), 's$', ''), '-', '_')")}, line_no)
               FILTER (WHERE regexp_matches(text, {D.q(G.API_ANY)}))) AS child
  FROM code_lines GROUP BY repo, path),
tok AS (
  SELECT c.repo, c.path, c.line_no, u.pos, {_pascal("regexp_replace(u.b, '_+$', '')")} AS parent
  FROM code_lines c, unnest(regexp_extract_all(c.text, {D.q(G.FK_TOKEN)}, 1)) WITH ORDINALITY AS u(b, pos)),
e AS (SELECT t.*, p.child FROM tok t JOIN objs2 o ON o.repo = t.repo AND o.key = lower(t.parent)
      JOIN prim p ON p.repo = t.repo AND p.path = t.path WHERE p.child IS NOT NULL),
rel0 AS (SELECT repo, arg_min(child, (path, line_no, pos)) AS child, arg_min(parent, (path, line_no, pos)) AS parent,
                min((path, line_no, pos)) AS f
         FROM e GROUP BY repo, lower(child), lower(parent)),
rel AS (SELECT repo, child, parent, 'belongs_to' AS relationship, row_number() OVER (PARTITION BY repo ORDER BY f) AS ord FROM rel0)
"""


@query("fk_relationships", oracle=REL_DUCK + "SELECT * FROM rel")
def q_fk_relationships(spark, sf_dir):
    return relationships(spark, sf_dir)


def _via_d(c, p):
    return f"({c} || '.' || {D.snake_from_camel(p)} || '_id → ' || {p} || '.id')"


PATHS_DUCK = REL_DUCK.rstrip() + f""",
ed AS (SELECT repo, child, parent, ord, {_via_d('child', 'parent')} AS via FROM rel),
p1 AS (SELECT repo, child AS "from", parent AS "to", [via] AS via, [ord] AS ords FROM ed),
p2 AS (SELECT p.repo, p."from", e.parent AS "to", list_append(p.via, e.via) AS via, list_append(p.ords, e.ord) AS ords
       FROM p1 p JOIN ed e ON e.repo = p.repo AND e.child = p."to"),
p3 AS (SELECT p.repo, p."from", e.parent AS "to", list_append(p.via, e.via) AS via, list_append(p.ords, e.ord) AS ords
       FROM p2 p JOIN ed e ON e.repo = p.repo AND e.child = p."to"),
allp AS (SELECT *, len(via) AS hops FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
best AS (SELECT repo, "from", "to", arg_min(via, (hops, ords)) AS via, min(hops) AS hops, arg_min(ords, (hops, ords)) AS ords
         FROM allp GROUP BY ALL)
"""


def paths(spark, sf_dir):
    return G.join_paths(relationships(spark, sf_dir), keys=["repo"])


@query("join_paths", oracle=PATHS_DUCK + """
SELECT repo, "from", "to", hops, array_to_string(via, ' | ') AS via FROM best""")
def q_join_paths(spark, sf_dir):
    return paths(spark, sf_dir).drop("ords")


HIER_DUCK = PATHS_DUCK.rstrip() + ",\n" + fx.cte("plan_events", fx.PLAN_EVENTS_SQL) + f""",
ev AS (SELECT DISTINCT 'repo' || CAST(repo_id AS VARCHAR) AS repo, name AS event_name,
              {D.snake_from_camel('object')} AS obj FROM plan_events),
par AS (SELECT ev.repo, ev.event_name, ev.obj, r.parent, r.ord, {D.snake_from_camel('r.parent')} AS ps
        FROM ev JOIN rel r ON r.repo = ev.repo AND lower(r.child) = lower(ev.obj)),
direct AS (SELECT repo, event_name, ps || '_id' AS prop, 'string' AS type, true AS required,
                  'ID of the parent ' || parent AS description, CAST(ord AS BIGINT) AS ord
           FROM par WHERE ps <> obj),
gp0 AS (SELECT ev.repo, ev.event_name, ev.obj, arg_min(b."to", (b.hops, b.ords)) AS gp
        FROM ev JOIN best b ON b.repo = ev.repo AND lower(b."from") = lower({_pascal('ev.obj')}) AND b.hops >= 2
        GROUP BY ALL),
grand AS (SELECT g.repo, g.event_name, {D.snake_from_camel('g.gp')} || '_id' AS prop, 'string' AS type, false AS required,
                 'ID of the grandparent ' || g.gp || ' (for cross-entity correlation)' AS description, CAST(1000000 AS BIGINT) AS ord
          FROM gp0 g
          WHERE {D.snake_from_camel('g.gp')} <> g.obj
            AND NOT EXISTS (SELECT 1 FROM par p WHERE p.repo = g.repo AND p.event_name = g.event_name
                            AND p.ps = {D.snake_from_camel('g.gp')} AND p.ps <> p.obj)),
u AS (SELECT * FROM direct UNION ALL SELECT * FROM grand)
"""


@query("hierarchy_props", oracle=HIER_DUCK + """
SELECT repo, event_name, prop, type, required, description, ord, true AS todo FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, event_name, prop ORDER BY ord) AS r FROM u) WHERE r = 1""")
def q_hierarchy_props(spark, sf_dir):
    rel = relationships(spark, sf_dir)
    pth = G.join_paths(rel, keys=["repo"])
    ev = T.plan_events(spark).select(F.concat(F.lit("repo"), F.col("repo_id").cast("string")).alias("repo"),
                                     F.col("name").alias("event_name"), "object").distinct()
    return G.hierarchy_props(ev, rel, pth)


@query("ontology_edges", oracle=REL_DUCK.rstrip() + ",\n" + fx.cte("plan_events", fx.PLAN_EVENTS_SQL) + ",\n"
       + fx.cte("lifecycle_states", fx.LIFECYCLE_STATES_SQL) + """
SELECT DISTINCT 'repo' || CAST(repo_id AS VARCHAR) AS repo, 'action' AS kind, actor AS src, action AS label, object AS dst
FROM plan_events WHERE status <> 'deprecated' AND actor IS NOT NULL AND object IS NOT NULL
UNION ALL
SELECT repo, 'relationship', parent, relationship, child FROM rel
UNION ALL
SELECT '*', 'lifecycle', state, 'next', nxt FROM (
  SELECT object, state, lead(state) OVER (PARTITION BY object ORDER BY ord) AS nxt FROM lifecycle_states) WHERE nxt IS NOT NULL""")
def q_ontology_edges(spark, sf_dir):
    """Actor-action-object edges of active plan events, parent-child
    relationships found in the corpus and lifecycle state successions."""
    plan = T.plan_events(spark).where((F.col("status") != "deprecated") & F.col("actor").isNotNull()
                                      & F.col("object").isNotNull())
    a = plan.select(F.concat(F.lit("repo"), F.col("repo_id").cast("string")).alias("repo"), F.lit("action").alias("kind"),
                    F.col("actor").alias("src"), F.col("action").alias("label"), F.col("object").alias("dst")).distinct()
    r = relationships(spark, sf_dir).select("repo", F.lit("relationship").alias("kind"), F.col("parent").alias("src"),
                                            F.col("relationship").alias("label"), F.col("child").alias("dst"))
    lc = G.lifecycle_edges(T.dim(spark, fx.LIFECYCLE_STATES_SQL)).select(
        F.lit("*").alias("repo"), F.lit("lifecycle").alias("kind"), F.col("from_state").alias("src"),
        F.lit("next").alias("label"), F.col("to_state").alias("dst"))
    return a.unionByName(r).unionByName(lc)


@query("lifecycle_edges", oracle=fx.with_ctes(fx.cte("lifecycle_states", fx.LIFECYCLE_STATES_SQL), """d AS (
  SELECT object, state AS from_state, lead(state) OVER (PARTITION BY object ORDER BY ord) AS to_state FROM lifecycle_states),
t AS (SELECT o_orderstatus AS from_state,
             lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_state FROM orders),
obs AS (SELECT from_state, to_state, count(*) AS n FROM t WHERE to_state IS NOT NULL GROUP BY ALL)""") + """
SELECT d.object, d.from_state, d.to_state, CAST(coalesce(CASE WHEN d.object = 'Order' THEN obs.n END, 0) AS BIGINT) AS n_observed
FROM d LEFT JOIN obs ON obs.from_state = d.from_state AND obs.to_state = d.to_state WHERE d.to_state IS NOT NULL""")
def q_lifecycle_edges(spark, sf_dir):
    """Declared lifecycle successions with how often each was observed
    between consecutive orders of a customer (A24)."""
    decl = G.lifecycle_edges(T.dim(spark, fx.LIFECYCLE_STATES_SQL))
    o = T.read_table(spark, sf_dir, "orders")
    obs = E.state_transitions(o, "o_custkey", "o_orderstatus", "o_orderdate", "o_orderkey") \
        .withColumn("object", F.lit("Order"))
    return decl.join(obs, ["object", "from_state", "to_state"], "left").select(
        "object", "from_state", "to_state", F.coalesce("n_transitions", F.lit(0)).cast("bigint").alias("n_observed"))


@query("join_path_exec", oracle="""
SELECT n.n_nationkey, n.n_name, count(*) AS n_lineitems, round(sum(l.l_extendedprice), 2) AS revenue
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_nationkey, n.n_name""")
def q_join_path_exec(spark, sf_dir):
    """LineItem -> Order -> Customer -> Nation, the path the graph
    gives for these objects, executed with aggregation before each join."""
    li = T.read_table(spark, sf_dir, "lineitem")
    hops = [(T.read_table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey"),
            (T.read_table(spark, sf_dir, "customer"), "o_custkey", "c_custkey"),
            (T.read_table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey")]
    out = G.path_rollup(li, hops, "n_nationkey", {"n_lineitems": F.count(F.lit(1)),
                                                   "revenue": F.sum("l_extendedprice")}, ["n_name"])
    return out.select("n_nationkey", "n_name", F.col("n_lineitems").cast("bigint").alias("n_lineitems"),
                      F.round("revenue", 2).alias("revenue"))


@query("context_actors", oracle=fx.with_ctes(CL, """f AS (
  SELECT repo, bool_or(regexp_matches(text, 'req\\.user\\b|request\\.user\\b|session\\.user\\b')
                       OR regexp_matches(text, '\\buse(Auth|User|Session)\\b')) AS u,
               bool_or(regexp_matches(text, '\\bcron\\b|\\bschedule\\b|\\bsetInterval\\b')) AS s,
               bool_or(regexp_matches(text, '(?i)\\bstripe\\b')) AND bool_or(regexp_matches(text, '(?i)\\bwebhook\\b')) AS st
  FROM code_lines GROUP BY repo)""") + """
SELECT repo, 'User' AS name, 'user' AS type, 'user.id' AS identifier_pattern, 'auth/session usage' AS detected_from, 0.7 AS confidence FROM f WHERE u
UNION ALL SELECT repo, 'System', 'system', 'system', 'cron/scheduler patterns', 0.5 FROM f WHERE s
UNION ALL SELECT repo, 'Stripe', 'integration', 'stripe.customer', 'stripe webhook patterns', 0.6 FROM f WHERE st""")
def q_context_actors(spark, sf_dir):
    _, files = corpus(spark, sf_dir)
    return G.context_actors(files)


@query("context_lifecycles")
def q_context_lifecycles(spark, sf_dir):
    """A23 over the corpus (rows-only: the derived corpus declares no status
    enums; the reference's own inputs are checked in the tests)."""
    _, files = corpus(spark, sf_dir)
    lc = G.lifecycles_from_code(files, G.context_objects(files))
    return lc.select("repo", "object", F.array_join("states", ",").alias("states"))


@query("export_agent_context")
def q_export_agent_context(spark, sf_dir):
    """Compact agent JSON per repo (rows-only; every section is an
    oracle-checked query of its own)."""
    from ..operators import exports as X
    from ..operators import metrics as M
    from .q_plan import merged_plan
    _, files = corpus(spark, sf_dir)
    objs = materialize(G.context_objects(files))
    rel = G.fk_relationships(files, objs)
    paths = G.join_paths(rel, keys=["repo"])
    rid = F.regexp_extract("repo", r"(\d+)$", 1).cast("int").alias("repo_id")
    m = merged_plan(spark, sf_dir).withColumn("includes", F.lit(None).cast("array<string>"))
    lcs = T.dim(spark, fx.LIFECYCLE_STATES_SQL)
    metrics = M.generate_metrics(m, lcs)
    seqs = M.expected_sequences(m, lcs)
    lc_code = G.lifecycles_from_code(files, objs).select(rid, "object", "states")
    return X.agent_context(m, metrics, seqs, G.context_actors(files).select(rid, "*").drop("repo"),
                           objs.select(rid, "*").drop("repo"), rel.select(rid, "*").drop("repo"),
                           paths.select(rid, "*").drop("repo"), lc_code)
