"""Ingest path: resolve keys, validate bodies, normalise, limit, fan out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fanout as FO
from ..operators import ingest as I
from ..sources import ingest as src
from ..sources import tables as T
from . import fixtures as fx
from .catalog import query

LIMIT, WINDOW = 25, 12 * 3600

VALIDATED = fx.with_ctes(src.REQUESTS_CTE, fx.cte("api_keys", fx.API_KEYS_SQL), f"""res AS (
  SELECT r.*, k.repo_id, CASE WHEN json_valid(r.body) THEN r.body END AS jb FROM ingest_raw r LEFT JOIN api_keys k ON k.key = r.api_key AND NOT k.revoked),
val AS (
  SELECT *, CASE
    WHEN repo_id IS NULL THEN 'invalid_key'
    WHEN octet_length(CAST(body AS BLOB)) > {I.MAX_BODY_BYTES} THEN 'payload_too_large'
    WHEN NOT json_valid(body) THEN 'invalid_json'
    WHEN json_type(json_extract(jb, '$.events')) IS DISTINCT FROM 'ARRAY'
      OR json_array_length(json_extract(jb, '$.events')) < 1
      OR json_array_length(json_extract(jb, '$.events')) > {I.MAX_BATCH}
      OR EXISTS (SELECT 1 FROM unnest(CAST(json_extract(jb, '$.events') AS JSON[])) AS u(it)
                 WHERE json_extract_string(it, '$.event') IS NULL
                    OR length(json_extract_string(it, '$.event')) < 1
                    OR (json_extract(it, '$.properties') IS NOT NULL
                        AND json_type(json_extract(it, '$.properties')) <> 'OBJECT'))
    THEN 'invalid_body' ELSE 'accepted' END AS status
  FROM res),
val2 AS (SELECT *, CASE WHEN status = 'accepted' THEN json_array_length(json_extract(jb, '$.events')) ELSE 0 END AS n_events FROM val)""")

GOOD_EVENTS = VALIDATED.rstrip() + """,
good AS (
  SELECT request_id, repo_id, received_at, CAST(u.pos - 1 AS INT) AS pos,
         lower(trim(json_extract_string(u.it, '$.event'))) AS event_name,
         CAST(json_extract(u.it, '$.properties') AS VARCHAR) AS properties,
         coalesce(json_extract_string(u.it, '$.environment'), 'production') AS environment,
         json_extract_string(u.it, '$.timestamp') AS client_ts
  FROM val2, unnest(CAST(json_extract(jb, '$.events') AS JSON[])) WITH ORDINALITY AS u(it, pos)
  WHERE status = 'accepted')
"""


def validated(spark, sf_dir):
    req = src.derived_requests(T.read_table(spark, sf_dir, "events"))
    return I.validate(I.resolve_keys(req, T.dim(spark, fx.API_KEYS_SQL)))


@query("ingest_resolve", oracle=VALIDATED + """
SELECT request_id, api_key, repo_id FROM res""")
def q_ingest_resolve(spark, sf_dir):
    req = src.derived_requests(T.read_table(spark, sf_dir, "events"))
    return I.resolve_keys(req, T.dim(spark, fx.API_KEYS_SQL)).select("request_id", "api_key", "repo_id")


@query("ingest_validate", oracle=VALIDATED + """
SELECT request_id, repo_id, status, CAST(n_events AS INT) AS n_events FROM val2""")
def q_ingest_validate(spark, sf_dir):
    return validated(spark, sf_dir).select("request_id", "repo_id", "status", "n_events")


@query("ingest_normalize", oracle=GOOD_EVENTS + """
SELECT request_id, repo_id, pos, event_name, properties, environment, client_ts FROM good""")
def q_ingest_normalize(spark, sf_dir):
    return I.normalize(validated(spark, sf_dir)).drop("received_at")


@query("rate_window_counts", oracle=fx.with_ctes(fx.EVENTS_CTE) + """
SELECT event_id, repo_id,
  count(*) OVER (PARTITION BY repo_id ORDER BY epoch_us(received_at)
                 RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS window_count
FROM ev""")
def q_rate_window_counts(spark, sf_dir):
    """Events of the same repo in the 60 s up to and including each event."""
    e = T.events(spark, sf_dir).select("event_id", "repo_id", "received_at")
    return I.sliding_sum(e, "repo_id", "received_at", F.lit(1), "window_count").select(
        "event_id", "repo_id", F.col("window_count").cast("bigint").alias("window_count"))


@query("rate_limit", oracle="WITH RECURSIVE " + VALIDATED[len("WITH "):].rstrip() + f""",
acc AS (SELECT request_id, repo_id, received_at, epoch_us(received_at) AS t, CAST(n_events AS BIGINT) AS n
        FROM val2 WHERE status = 'accepted'),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY t, request_id) AS rn FROM acc),
lim AS (
  SELECT repo_id, rn, request_id, n <= {LIMIT} AS allowed,
         CASE WHEN n <= {LIMIT} THEN [{{'t': t, 'n': n}}] ELSE CAST([] AS STRUCT(t BIGINT, n BIGINT)[]) END AS st
  FROM r WHERE rn = 1
  UNION ALL
  SELECT r.repo_id, r.rn, r.request_id,
    coalesce(list_sum(list_transform(list_filter(lim.st, lambda s: s.t >= r.t - {WINDOW * 1_000_000}), lambda s: s.n)), 0) + r.n <= {LIMIT},
    list_concat(list_filter(lim.st, lambda s: s.t >= r.t - {WINDOW * 1_000_000}),
      CASE WHEN coalesce(list_sum(list_transform(list_filter(lim.st, lambda s: s.t >= r.t - {WINDOW * 1_000_000}), lambda s: s.n)), 0) + r.n <= {LIMIT}
           THEN [{{'t': r.t, 'n': r.n}}] ELSE CAST([] AS STRUCT(t BIGINT, n BIGINT)[]) END)
  FROM lim JOIN r ON r.repo_id = lim.repo_id AND r.rn = lim.rn + 1)
SELECT acc.request_id, acc.repo_id, CAST(acc.n AS INT) AS n_events, lim.allowed
FROM acc JOIN lim ON lim.request_id = acc.request_id""")
def q_rate_limit(spark, sf_dir):
    """W2 with a small limit (25 events per 12 h per repo) so that it bites."""
    v = validated(spark, sf_dir).where(F.col("status") == "accepted") \
        .select("request_id", "repo_id", "received_at", "n_events")
    return I.rate_limit(v, limit=LIMIT, window_seconds=WINDOW).select("request_id", "repo_id", "n_events", "allowed")


ALLOWED_HOSTS = ["hooks.example.com"]


@query("fanout_allowed", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("fanout_targets", fx.FANOUT_TARGETS_SQL)) + """
SELECT t.repo_id, t.destination, t.url,
  CASE WHEN t.destination <> 'custom' THEN true
       ELSE coalesce(regexp_extract(t.url, '^([A-Za-z]+)://', 1) IN ('http', 'https')
            AND lower(regexp_extract(t.url, '^[A-Za-z]+://([^/:?#]+)', 1)) IN ('hooks.example.com'), false) END AS allowed,
  (SELECT count(*) FROM ev WHERE ev.repo_id = t.repo_id) AS n_events
FROM fanout_targets t""")
def q_fanout_allowed(spark, sf_dir):
    """P10 per destination, with the number of events that would fan out to it."""
    t = T.dim(spark, fx.FANOUT_TARGETS_SQL)
    n = T.events(spark, sf_dir).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_events"))
    ok = F.when(F.col("destination") != "custom", F.lit(True)).otherwise(I.is_allowed_url(F.col("url"), ALLOWED_HOSTS))
    return t.join(n, "repo_id", "left").select("repo_id", "destination", "url", ok.alias("allowed"),
                                               F.coalesce("n_events", F.lit(0)).alias("n_events"))


def fanout_sql(good_sql: str) -> str:
    """DuckDB oracle for fan-out payloads over a ``good`` CTE of accepted events."""
    return (good_sql.rstrip() + ",\n" + fx.cte("fanout_targets", fx.FANOUT_TARGETS_SQL) + f""",
tg AS (SELECT *, CASE WHEN destination <> 'custom' THEN true
                      ELSE coalesce(regexp_extract(url, '^([A-Za-z]+)://', 1) IN ('http', 'https')
                           AND lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) IN ('hooks.example.com'), false) END AS ok
       FROM fanout_targets),
bl AS (SELECT repo_id, bool_or(NOT ok) AS blocked_all FROM tg GROUP BY repo_id),
j AS (SELECT g.*, tg.destination, tg.api_key, sha256(g.request_id || '|' || CAST(g.pos AS VARCHAR) || '|' || tg.destination) AS mid,
             coalesce(g.properties, '{{}}') AS props,
             trim(regexp_replace(regexp_replace(coalesce(g.properties, '{{}}'), '^\\s*\\{{', ''), '\\}}\\s*$', '')) AS inner_p
      FROM good g JOIN tg ON tg.repo_id = g.repo_id JOIN bl ON bl.repo_id = g.repo_id WHERE NOT bl.blocked_all)
SELECT request_id, pos, repo_id, destination, event_name, mid AS message_id,
  CASE destination
   WHEN 'segment' THEN '{{"type":"track","event":' || to_json(event_name) || ',"properties":' || props
        || ',"timestamp":' || to_json(client_ts) || ',"messageId":"' || mid || '"}}'
   WHEN 'posthog' THEN '{{"api_key":' || to_json(api_key) || ',"event":' || to_json(event_name) || ',"properties":{{'
        || concat_ws(',', CASE WHEN inner_p <> '' THEN inner_p END, '"$lib":"{FO.LIB_NAME}"') || '}}'
        || ',"timestamp":' || to_json(client_ts) || '}}'
   WHEN 'mixpanel' THEN '[{{"event":' || to_json(event_name) || ',"properties":{{'
        || concat_ws(',', '"token":' || to_json(api_key), CASE WHEN inner_p <> '' THEN inner_p END) || '}}}}]'
   WHEN 'amplitude' THEN '{{"api_key":' || to_json(api_key) || ',"events":[{{"event_type":' || to_json(event_name)
        || ',"event_properties":' || props || ',"time":' || CAST(epoch_us(CAST(client_ts AS TIMESTAMP)) // 1000 AS VARCHAR)
        || ',"insert_id":"' || mid || '","user_id":' || to_json(coalesce(json_extract_string(props, '$.user_id'), 'anonymous')) || '}}]}}'
   ELSE '{{"event":' || to_json(event_name) || ',"properties":' || props || ',"timestamp":' || to_json(client_ts) || '}}'
  END AS payload
FROM j""")


@query("fanout_payloads", oracle=fanout_sql(GOOD_EVENTS))
def q_fanout_payloads(spark, sf_dir):
    ev = I.normalize(validated(spark, sf_dir))
    return FO.fanout_payloads(ev, T.dim(spark, fx.FANOUT_TARGETS_SQL), ALLOWED_HOSTS)
