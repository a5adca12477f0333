"""Claims that expire (ST3, ST5): pull-request heads and webhook deliveries, each analysed once per retention."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import tables as T
from ..streaming import claims as CL
from ..streaming import jobs as J
from .catalog import query

#: The given events span 30 days, so the queries keep claims for days, not for the 365 and 90 days of ``claims``.
HEAD_DAYS, DELIVERY_DAYS, LANDINGS = 6, 2, 3
HEAD_KEYS = ["installation_id", "repo_full_name", "pr_number", "head_sha"]


def drained(spark, deliveries, keys, days):
    """Deliveries land in time order in a few slices; the stream is restarted after each, with its claims as state."""
    sink, ck = J.new_location(spark, "claims")
    land = scratch_path(spark, os.path.join("landing", f"claims-{uuid.uuid4().hex[:12]}"))
    t = F.unix_micros(F.col("delivered_at").cast("timestamp"))
    low, high = deliveries.agg(F.min(t), F.max(t)).first()
    if low is None:
        deliveries.write.parquet(land)
    else:
        width = (high - low) // LANDINGS + 1
        for i in range(LANDINGS):
            deliveries.where(F.floor((t - low) / width) == i).write.mode("append").parquet(land)
            CL.drain(spark, CL.claims(J.file_stream(spark, land), keys, "delivered_at", days), sink, ck)
    schema = T.dim(spark, "SELECT 1").select(*[F.lit(None).cast(deliveries.schema[k].dataType).alias(k) for k in keys],
                                             F.lit(None).cast("long").alias("delivery_id"), F.lit(None).cast("boolean").alias("acquired")).schema
    return spark.createDataFrame([], schema) if low is None else spark.read.schema(schema).parquet(sink)


def claims_sql(deliveries: str, keys: list[str], days: int) -> str:
    """Every delivery with ``acquired``, by walking from claim to claim of a key."""
    k = ", ".join(keys)
    same = " AND ".join(f"r.{x} = c.{x}" for x in keys)
    per_key = ", ".join(f"r.{x}" for x in keys)
    return f"""
WITH RECURSIVE d AS ({deliveries}),
r AS (SELECT *, epoch_us(delivered_at) AS t, row_number() OVER (PARTITION BY {k} ORDER BY delivered_at, delivery_id) AS rn FROM d),
c AS (
  SELECT {k}, rn, t FROM r WHERE rn = 1
  UNION ALL
  SELECT {per_key}, min(r.rn), min(r.t) FROM c JOIN r ON {same} AND r.t >= c.t + {days * CL.DAY_US} GROUP BY {per_key})
SELECT {per_key}, r.delivery_id, c.rn IS NOT NULL AS acquired
FROM r LEFT JOIN c ON {same} AND c.rn = r.rn"""


HEADS_SQL = """
  SELECT CASE WHEN user_id % 5 < 3 THEN 100 ELSE 200 END AS installation_id, 'acme/repo' || CAST(user_id % 5 AS VARCHAR) AS repo_full_name,
         CAST(user_id % 20 AS INT) AS pr_number,
         substr(sha256(CAST(user_id % 20 AS VARCHAR) || ':' || CAST(event_id % 12 AS VARCHAR)), 1, 12) AS head_sha,
         event_id AS delivery_id, ts AS delivered_at FROM events"""


@query("stream_pr_heads", oracle=claims_sql(HEADS_SQL, HEAD_KEYS, HEAD_DAYS))
def q_stream_pr_heads(spark, sf_dir):
    """ST3 with expiry: the first delivery of a (installation, repo, PR, head) is analysed, later ones are duplicates
    until the claim is older than its retention."""
    d = CL.head_deliveries(T.read_table(spark, sf_dir, "events"))
    return drained(spark, d, HEAD_KEYS, HEAD_DAYS)


@query("stream_deliveries", oracle=claims_sql(
    "SELECT 'd' || CAST(event_id % 500 AS VARCHAR) AS delivery_guid, event_id AS delivery_id, ts AS delivered_at FROM events",
    ["delivery_guid"], DELIVERY_DAYS))
def q_stream_deliveries(spark, sf_dir):
    """ST5: a webhook delivery is processed once per retention; a re-delivery after it is new again."""
    e = T.read_table(spark, sf_dir, "events")
    d = e.select(F.concat(F.lit("d"), (F.col("event_id") % 500).cast("string")).alias("delivery_guid"),
                 F.col("event_id").alias("delivery_id"), F.col("ts").alias("delivered_at"))
    return drained(spark, d, ["delivery_guid"], DELIVERY_DAYS)
