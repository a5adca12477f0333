"""Inline dimensions and derived inputs shared by Spark and the DuckDB oracle.

Every dimension here is a handful of rows written as portable ``VALUES`` SQL,
so both engines see byte-identical inputs. Facts are never defined here: they
are read from the given parquet tables and derived from them by Spark.
"""

from __future__ import annotations

# Repositories (tenants). Repos 0-3 carry the tracking plan below; repo 4 has
# no plan, which exercises the "no implemented events -> null coverage" path.
REPOS_SQL = """SELECT * FROM (VALUES
 (0, 100, 'acme',   'web'),
 (1, 100, 'acme',   'api'),
 (2, 100, 'acme',   'mobile'),
 (3, 200, 'globex', 'shop'),
 (4, 200, 'globex', 'admin')
) AS repos(repo_id, installation_id, owner, name)"""

PLAN_REPO_IDS = (0, 1, 2, 3)

# The tracking plan of every planned repo (FIXTURES.md 4.2). `error` is absent
# on purpose (drift), `refund` is implemented but never seen, `Purchase` tests
# case handling and `legacy_click` is deprecated.
PLAN_ROWS = [
    (1, "view", "User", "page_view", "viewed", "high", "implemented", "action"),
    (2, "click", "User", "Button", "clicked", "low", "suggested", "action"),
    (3, "Purchase", "User", "Order", "created", "critical", "implemented", "state_change"),
    (4, "refund", "User", "Order", "refunded", "medium", "implemented", "state_change"),
    (5, "signup", "User", "Account", "created", "critical", "approved", "action"),
    (6, "legacy_click", "User", "Button", "clicked", "low", "deprecated", "action"),
    (7, "workflow_created", "User", "Workflow", "created", "high", "implemented", "state_change"),
    (8, "workflow_completed", "User", "Workflow", "completed", "medium", "approved", "state_change"),
]


def _lit(v) -> str:
    if v is None:
        return "CAST(NULL AS STRING)"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def values_sql(rows, alias: str, cols: list[str]) -> str:
    body = ",\n ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES\n {body}\n) AS {alias}({', '.join(cols)})"


# Plan timestamps are ISO strings, as in the plan document.
PLAN_FIRST_SEEN = "2023-12-01T00:00:00"
PLAN_LAST_SEEN = "2023-12-15T00:00:00"

PLAN_EVENTS_SQL = values_sql(
    [(rid, o, n, f"{n} event", a, obj, act, p, s, sig, PLAN_FIRST_SEEN, PLAN_LAST_SEEN, "plan")
     for rid in PLAN_REPO_IDS
     for (o, n, a, obj, act, p, s, sig) in PLAN_ROWS],
    "plan_events",
    ["repo_id", "ord", "name", "description", "actor", "object", "action",
     "priority", "status", "signal_type", "first_seen", "last_seen", "location"],
)

PLAN_PROPS_SQL = """SELECT * FROM (VALUES
 ('view',     'k',        'number', true,  false, 1),
 ('view',     'user_id',  'string', true,  true,  2),
 ('Purchase', 'k',        'number', true,  false, 1),
 ('Purchase', 'order_id', 'string', true,  false, 2),
 ('click',    'k',        'string', false, false, 1)
) AS plan_props(event_name, prop, type, required, todo, ord)"""

# Metric definitions (FIXTURES.md 4.3).
PLAN_METRICS_SQL = """SELECT * FROM (VALUES
 ('purchase_count',      'count', 'purchase', CAST(NULL AS STRING), 'daily',  'revenue',    'active'),
 ('purchase_per_signup', 'ratio', 'purchase', 'signup',             'weekly', 'conversion', 'active'),
 ('refund_per_view',     'ratio', 'refund',   'view',               'daily',  'retention',  'active'),
 ('view_per_refund',     'ratio', 'view',     'refund',             'daily',  'engagement', 'active')
) AS plan_metrics(metric, kind, num_event, den_event, grain, category, status)"""

# Expected sequence: signup -> view -> purchase within 7 days of the start.
SEQUENCES_SQL = """SELECT * FROM (VALUES
 ('activation', 1, 'signup',   604800),
 ('activation', 2, 'view',     604800),
 ('activation', 3, 'purchase', 604800)
) AS sequences(name, step, event_name, window_seconds)"""

# Foreign-key edges of the star schema (child -> parent), in declaration order.
RELATIONSHIPS_SQL = """SELECT * FROM (VALUES
 ('Nation',   'Region',   1),
 ('Customer', 'Nation',   2),
 ('Supplier', 'Nation',   3),
 ('Order',    'Customer', 4),
 ('LineItem', 'Order',    5),
 ('LineItem', 'Part',     6),
 ('LineItem', 'Supplier', 7)
) AS relationships(child, parent, ord)"""

# Declared lifecycle of Order (TPC-H order status codes) and of Workflow.
LIFECYCLE_STATES_SQL = """SELECT * FROM (VALUES
 ('Order',    1, 'O'),
 ('Order',    2, 'P'),
 ('Order',    3, 'F'),
 ('Workflow', 1, 'draft'),
 ('Workflow', 2, 'active'),
 ('Workflow', 3, 'completed')
) AS lifecycle_states(object, ord, state)"""

# API keys: one live key per repo, one revoked key for repo 2.
API_KEYS_SQL = """SELECT * FROM (VALUES
 ('key_0',     0, false),
 ('key_1',     1, false),
 ('key_2_old', 2, true),
 ('key_2',     2, false),
 ('key_3',     3, false),
 ('key_4',     4, false)
) AS api_keys(key, repo_id, revoked)"""

# Fan-out destinations per repo. The custom target of repo 3 is plain http on
# a host outside the allow-list and therefore blocks every destination of
# that repo's events.
FANOUT_TARGETS_SQL = """SELECT * FROM (VALUES
 (0, 'segment',   'wk_seg0',  CAST(NULL AS STRING)),
 (0, 'posthog',   'phc_0',    'https://app.posthog.com'),
 (1, 'mixpanel',  'mp_tok1',  CAST(NULL AS STRING)),
 (1, 'amplitude', 'amp_key1', CAST(NULL AS STRING)),
 (2, 'custom',    CAST(NULL AS STRING), 'https://hooks.example.com/in'),
 (3, 'custom',    CAST(NULL AS STRING), 'http://collector.internal.test/in'),
 (3, 'segment',   'wk_seg3',  CAST(NULL AS STRING))
) AS fanout_targets(repo_id, destination, api_key, url)"""

ALLOWED_HOSTS_SQL = """SELECT * FROM (VALUES
 ('hooks.example.com')
) AS allowed_hosts(host)"""


# --- derived facts ---------------------------------------------------------

# Canonical event table derived from the given `events` parquet
# (FIXTURES.md 4.1). DuckDB form; the Spark form is sources.tables.
EVENTS_CTE = """ev AS (
  SELECT event_id,
         user_id % 5 AS repo_id,
         event_type AS event_name,
         user_id,
         props AS properties,
         CASE WHEN event_id % 10 = 0 THEN 'staging' ELSE 'production' END AS environment,
         ts AS event_ts,
         ts AS received_at,
         value
  FROM events
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def cte(name: str, sql: str) -> str:
    return f"{name} AS (\n{sql}\n)"

# Derived code corpus (FIXTURES.md 4.4), DuckDB form; Spark form is
# sources.corpus.derived_code_lines.
CODE_LINES_CTE = """code_lines AS (
SELECT concat('repo', CAST(user_id % 5 AS STRING)) AS repo,
 concat(CASE user_id % 4 WHEN 0 THEN 'src/components/U' WHEN 1 THEN 'src/app/api/orders/U'
        WHEN 2 THEN 'src/lib/U' ELSE 'src/pages/U' END, CAST(user_id AS STRING), '.tsx') AS path,
 CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS line_no,
 CASE event_type
  WHEN 'view'     THEN concat('track(', chr(39), obj, '_viewed', chr(39), ', { ', obj, '_id: x.id, user_id: u.id });')
  WHEN 'click'    THEN concat('<button onClick={handleCreate', upper(substr(obj,1,1)), substr(obj,2), '}>')
  WHEN 'signup'   THEN concat('await prisma.', obj, '.create({ data });')
  WHEN 'purchase' THEN concat('app.post(', chr(39), '/api/', obj, 's', chr(39), ', async (req, res) => {')
  ELSE concat('// track(', chr(39), 'legacy_', obj, chr(39), ')') END AS text
FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN 'workflow' WHEN 1 THEN 'invoice'
                WHEN 2 THEN 'member' ELSE 'project' END AS obj FROM events) e
)"""

# A small convention set for the convention queries (own content; the
# loader reads real convention YAML files with the same shape).
CONV_EVENTS_SQL = """SELECT * FROM (VALUES
 ('workspace',     'workflow_viewed',  'success',  'A workflow was opened',  1),
 ('workspace',     'invoice_viewed',   'success',  'An invoice was opened',  2),
 ('workspace',     'project_archived', 'complete', 'A project was archived', 3),
 ('collaboration', 'member_invited',   'success',  'A member was invited',   1),
 ('commerce',      'purchase',         'success',  'An order was paid',      1),
 ('commerce',      'signup',           'start',    'An account was created', 2)
) AS conv_events(domain, name, lifecycle, description, ord)"""

CONV_ATTRS_SQL = """SELECT * FROM (VALUES
 ('workspace',     'workflow_viewed',  'workflow_id', 'string', true,  CAST(NULL AS STRING), 1),
 ('workspace',     'workflow_viewed',  'user_id',     'string', true,  CAST(NULL AS STRING), 2),
 ('workspace',     'invoice_viewed',   'invoice_id',  'string', true,  CAST(NULL AS STRING), 1),
 ('workspace',     'invoice_viewed',   'amount',      'number', true,  CAST(NULL AS STRING), 2),
 ('workspace',     'project_archived', 'project_id',  'string', true,  CAST(NULL AS STRING), 1),
 ('collaboration', 'member_invited',   'role',        'enum',   true,  'admin|member',       1),
 ('commerce',      'purchase',         'k',           'number', true,  CAST(NULL AS STRING), 1),
 ('commerce',      'purchase',         'currency',    'enum',   true,  'usd|eur',            2),
 ('commerce',      'signup',           'k',           'enum',   true,  '1|2|3',              1),
 ('commerce',      'signup',           'method',      'enum',   false, 'email|google',       2)
) AS conv_attrs(domain, event_name, attr, type, required, values_list, ord)"""
