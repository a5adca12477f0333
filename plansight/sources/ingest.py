"""Ingest request source: raw JSON batch bodies, one row per HTTP request.

``ingest_raw(request_id, api_key, body, received_at)``. For tests and the
bench the requests are derived from the given events table: the events of
one repo within a block of 50 consecutive event ids form one batch request
(so a batch holds at most 50 events by construction).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 50


def derived_requests(raw_events: DataFrame) -> DataFrame:
    """Batch requests from the given events.

    Name spellings vary by ``event_id % 3`` (`` View ``, ``VIEW``, ``view``),
    ids divisible by 97 get an empty name (the whole batch is then invalid),
    ids ending in 5 omit the environment, every 17th block uses an unknown
    key, even blocks of repo 2 use its revoked key and every 23rd block is
    cut short (malformed JSON).
    """
    e = raw_events
    repo = e.user_id % 5
    blk = F.floor(e.event_id / BLOCK)
    name = (F.when(e.event_id % 97 == 0, F.lit(""))
            .when(e.event_id % 3 == 0, F.concat(F.lit(" "), F.initcap(e.event_type), F.lit(" ")))
            .when(e.event_id % 3 == 1, F.upper(e.event_type))
            .otherwise(e.event_type))
    env = (F.when(e.event_id % 10 == 0, F.lit("staging"))
           .when(e.event_id % 10 == 5, F.lit(None)).otherwise(F.lit("production")))
    iso = F.date_format(e.ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    item = F.concat(F.lit('{"event":"'), name, F.lit('","properties":'), e.props,
                    F.lit(',"timestamp":"'), iso, F.lit('"'),
                    F.coalesce(F.concat(F.lit(',"environment":"'), env, F.lit('"')), F.lit("")),
                    F.lit("}"))
    items = e.select(repo.alias("repo_id"), blk.alias("blk"), e.event_id, e.ts, item.alias("item"))
    req = items.groupBy("repo_id", "blk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "item"))),
                                 lambda s: s["item"]), ",").alias("items"),
        F.max("ts").alias("received_at"))
    body = F.concat(F.lit('{"events":['), F.col("items"), F.lit("]}"))
    body = F.when(F.col("blk") % 23 == 0, F.substring(body, 1, 40)).otherwise(body)
    key = (F.when(F.col("blk") % 17 == 0, F.lit("key_unknown"))
           .when((F.col("repo_id") == 2) & (F.col("blk") % 2 == 0), F.lit("key_2_old"))
           .otherwise(F.concat(F.lit("key_"), F.col("repo_id").cast("string"))))
    return req.select(F.concat(F.col("repo_id").cast("string"), F.lit("-"), F.col("blk").cast("string")).alias("request_id"),
                      key.alias("api_key"), body.alias("body"), "received_at")


# DuckDB form of derived_requests for the oracle.
REQUESTS_CTE = f"""items AS (
  SELECT user_id % 5 AS repo_id, floor(event_id / {BLOCK}) AS blk, event_id, ts,
    '{{"event":"' || (CASE WHEN event_id % 97 = 0 THEN ''
                          WHEN event_id % 3 = 0 THEN ' ' || upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' '
                          WHEN event_id % 3 = 1 THEN upper(event_type) ELSE event_type END)
    || '","properties":' || props || ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"'
    || coalesce(',"environment":"' || (CASE WHEN event_id % 10 = 0 THEN 'staging'
                                            WHEN event_id % 10 = 5 THEN NULL ELSE 'production' END) || '"', '')
    || '}}' AS item
  FROM events),
req0 AS (
  SELECT repo_id, blk, '{{"events":[' || string_agg(item, ',' ORDER BY event_id) || ']}}' AS full_body,
         max(ts) AS received_at
  FROM items GROUP BY repo_id, blk),
ingest_raw AS (
  SELECT CAST(repo_id AS VARCHAR) || '-' || CAST(CAST(blk AS BIGINT) AS VARCHAR) AS request_id,
    CASE WHEN blk % 17 = 0 THEN 'key_unknown' WHEN repo_id = 2 AND blk % 2 = 0 THEN 'key_2_old'
         ELSE 'key_' || CAST(repo_id AS VARCHAR) END AS api_key,
    CASE WHEN blk % 23 = 0 THEN substr(full_body, 1, 40) ELSE full_body END AS body,
    received_at
  FROM req0)"""
