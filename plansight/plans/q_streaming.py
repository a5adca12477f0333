"""Streaming queries: each drains a file stream with availableNow into the
shared checkpoint folder and returns the sink as a DataFrame."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import contracts as C
from ..operators import fanout as FO
from ..operators import ingest as I
from ..session import scratch_path
from ..sources import ingest as src
from ..sources import tables as T
from ..streaming import delivery as DL
from ..streaming import jobs as J
from . import fixtures as fx
from .catalog import query
from .q_ingest import ALLOWED_HOSTS, GOOD_EVENTS, LIMIT, VALIDATED, WINDOW, fanout_sql
from .q_ingest import q_rate_limit as _batch_rate_limit  # noqa: F401  (same limiter parameters)


def events_stream(spark, sf_dir):
    return J.file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")


def landed_requests(spark, sf_dir):
    """Derived ingest requests landed as JSON files in the shared folder (the
    stream source an HTTP front end would write)."""
    path = scratch_path(spark, os.path.join("landing", f"ingest-{uuid.uuid4().hex[:12]}"))
    src.derived_requests(T.read_table(spark, sf_dir, "events")).write.mode("overwrite").json(path)
    return path


@query("stream_append", oracle=fx.with_ctes(fx.EVENTS_CTE) + """
SELECT event_id, repo_id, event_name, environment, received_at, CAST(received_at AS DATE) AS date FROM ev""")
def q_stream_append(spark, sf_dir):
    """ST1 / S7: event-store append, partitioned by arrival date."""
    sink, ck = J.new_location(spark, "append")
    s = T.canonical_events(events_stream(spark, sf_dir)).withColumn("date", F.to_date("received_at"))
    J.run_available_now(s, sink, ck, partition_by=["date"])
    return spark.read.parquet(sink).select("event_id", "repo_id", "event_name", "environment", "received_at", "date")


@query("stream_dedup", oracle="SELECT DISTINCT event_id, user_id % 5 AS repo_id FROM events")
def q_stream_dedup(spark, sf_dir):
    """ST2: re-deliveries (every 50th event again, 5 minutes later) dropped
    within a 10-minute watermark."""
    sink, ck = J.new_location(spark, "dedup")
    a = J.with_event_time(events_stream(spark, sf_dir))
    b = J.with_event_time(events_stream(spark, sf_dir).where(F.col("event_id") % 50 == 0)) \
        .withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 5 MINUTES"))
    u = a.unionByName(b)
    d = J.dedupe_within_watermark(u, ["event_id"], "event_time", "10 minutes")
    J.run_available_now(d.select("event_id", (F.col("user_id") % 5).alias("repo_id")), sink, ck)
    return spark.read.parquet(sink)


@query("stream_counts", oracle="""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS event_name, count(*) AS n_events
FROM events GROUP BY ALL""")
def q_stream_counts(spark, sf_dir):
    """ST6: daily tumbling-window counts per event name, watermark 1 hour,
    update mode into an upserting sink."""
    sink, ck = J.new_location(spark, "counts")
    e = J.with_event_time(events_stream(spark, sf_dir)).withColumnRenamed("event_type", "event_name")
    agg = J.windowed_counts(e, "event_time", "1 day", "1 hour", [F.col("event_name")])
    J.run_upsert(agg.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                            "event_name", "n_events"), sink, ck)
    return J.read_upserted(spark, sink, ["window_start", "event_name"])


@query("stream_drift", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("plan_events", fx.PLAN_EVENTS_SQL)) + """
SELECT repo_id, event_name, count(*) AS n_events FROM ev e
WHERE NOT EXISTS (SELECT 1 FROM plan_events p WHERE p.repo_id = e.repo_id AND lower(p.name) = e.event_name)
GROUP BY ALL""")
def q_stream_drift(spark, sf_dir):
    """ST7: unplanned events as they arrive (stream-static anti join)."""
    sink, ck = J.new_location(spark, "drift")
    ev = T.canonical_events(events_stream(spark, sf_dir))
    names = F.broadcast(T.plan_events(spark).select("repo_id", F.lower("name").alias("event_name")).distinct())
    un = ev.join(names, ["repo_id", "event_name"], "left_anti")
    J.run_upsert(un.groupBy("repo_id", "event_name").agg(F.count(F.lit(1)).alias("n_events")), sink, ck)
    return J.read_upserted(spark, sink, ["repo_id", "event_name"])


@query("stream_rules", oracle=fx.with_ctes(fx.EVENTS_CTE, fx.cte("plan_events", fx.PLAN_EVENTS_SQL),
                                           fx.cte("plan_props", fx.PLAN_PROPS_SQL)) + """,
act AS (SELECT DISTINCT name FROM plan_events WHERE status <> 'deprecated'),
req AS (SELECT event_name AS name, list(prop ORDER BY prop) AS required FROM plan_props WHERE required GROUP BY 1),
r AS (SELECT a.name, coalesce(q.required, CAST([] AS VARCHAR[])) AS required FROM act a LEFT JOIN req q USING (name))
SELECT e.event_id, e.event_name,
  array_to_string(list_filter(r.required, lambda k: NOT coalesce(list_contains(json_keys(e.properties), k), false)), ',') AS missing,
  len(list_filter(r.required, lambda k: NOT coalesce(list_contains(json_keys(e.properties), k), false))) = 0 AS valid
FROM ev e JOIN r ON r.name = e.event_name""")
def q_stream_rules(spark, sf_dir):
    """ST8: the exported stream rules applied live - pass events of the active
    plan (exact name), validate their required properties."""
    sink, ck = J.new_location(spark, "rules")
    plan = T.plan_events(spark).where(F.col("status") != "deprecated").select("name").distinct()
    req = T.plan_props(spark).where("required").groupBy(F.col("event_name").alias("name")) \
        .agg(F.array_sort(F.collect_list("prop")).alias("required"))
    rules = F.broadcast(plan.join(req, "name", "left").select(
        F.col("name").alias("event_name"), F.coalesce("required", F.array().cast("array<string>")).alias("required")))
    ev = T.canonical_events(events_stream(spark, sf_dir)).join(rules, "event_name")
    missing = F.array_except("required", F.coalesce(F.json_object_keys("properties"), F.array().cast("array<string>")))
    out = ev.select("event_id", "event_name", F.array_join(missing, ",").alias("missing"),
                    (F.size(missing) == 0).alias("valid"))
    J.run_available_now(out, sink, ck)
    return spark.read.parquet(sink)


PER_EVENT_GOOD = fx.with_ctes(fx.EVENTS_CTE, """good AS (
  SELECT CAST(repo_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS request_id, repo_id, received_at, 0 AS pos,
         event_name, properties, environment, strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f') AS client_ts
  FROM ev)""")


def rendered_payloads(spark, sf_dir):
    """The stream of rendered payloads, one per event and destination."""
    ev = T.canonical_events(events_stream(spark, sf_dir)).select(
        F.concat(F.col("repo_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("request_id"),
        "repo_id", "received_at", F.lit(0).alias("pos"), "event_name", "properties", "environment",
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("client_ts"))
    return FO.fanout_payloads(ev, T.dim(spark, fx.FANOUT_TARGETS_SQL), ALLOWED_HOSTS)


PAYLOAD_COLS = ["request_id", "pos", "repo_id", "destination", "event_name", "message_id", "payload"]


@query("stream_fanout", oracle=fanout_sql(PER_EVENT_GOOD))
def q_stream_fanout(spark, sf_dir):
    """ST9: payloads rendered per micro-batch and written per destination."""
    sink, ck = J.new_location(spark, "fanout")
    J.run_available_now(rendered_payloads(spark, sf_dir), sink, ck, partition_by=["destination"])
    return spark.read.parquet(sink).select(*PAYLOAD_COLS)


@query("stream_delivery", oracle=fanout_sql(PER_EVENT_GOOD))
def q_stream_delivery(spark, sf_dir):
    """ST9 with failures: two destinations refuse their first batch, the others are served; a replay of the dead letters
    then delivers every payload exactly once."""
    sink, ck = J.new_location(spark, "delivery")
    refused: set[str] = set()

    def refusing_once(name):
        def send(rows, path):
            if name not in refused:
                refused.add(name)
                raise ConnectionError(f"{name} is down")
            DL.to_folder(rows, path)
        return send

    names = [r["destination"] for r in T.dim(spark, fx.FANOUT_TARGETS_SQL).select("destination").distinct().collect()]
    d = DL.Delivery(spark, sink, {n: refusing_once(n) if n in ("segment", "custom") else DL.to_folder for n in names})
    d.run(rendered_payloads(spark, sf_dir), ck)
    d.replay()
    return d.delivered().select(*PAYLOAD_COLS)


def _stream_validated(spark, sf_dir):
    path = landed_requests(spark, sf_dir)
    req = J.file_stream(spark, path, fmt="json")
    return I.validate(I.resolve_keys(req, T.dim(spark, fx.API_KEYS_SQL)))


@query("stream_ingest", oracle=GOOD_EVENTS + """
SELECT request_id, repo_id, pos, event_name, properties, environment, client_ts FROM good""")
def q_stream_ingest(spark, sf_dir):
    """ST1: landed request files -> key resolution -> validation -> events."""
    sink, ck = J.new_location(spark, "ingest")
    J.run_available_now(I.normalize(_stream_validated(spark, sf_dir)).drop("received_at"), sink, ck)
    return spark.read.parquet(sink)


@query("stream_rate_limit", oracle="WITH RECURSIVE " + VALIDATED[len("WITH "):].rstrip() + f""",
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
SELECT request_id, allowed FROM lim""")
def q_stream_rate_limit(spark, sf_dir):
    """ST4: the exact limiter as stateful streaming operator; same limit and
    window as the batch ``rate_limit`` query."""
    sink, ck = J.new_location(spark, "ratelimit")
    v = _stream_validated(spark, sf_dir).where(F.col("status") == "accepted")
    J.run_available_now(J.stream_rate_limit(v, "repo_id", "received_at", "n_events", LIMIT, WINDOW), sink, ck)
    return spark.read.parquet(sink)


@query("pr_head_dedupe", oracle="""
WITH d AS (
  SELECT CASE WHEN user_id % 5 < 3 THEN 100 ELSE 200 END AS installation_id,
         'acme/repo' || CAST(user_id % 5 AS VARCHAR) AS repo_full_name, CAST(user_id % 7 AS INT) AS pr_number,
         substr(sha256(CAST(user_id AS VARCHAR) || ':' || CAST(event_id // 100 AS VARCHAR)), 1, 12) AS head_sha,
         event_id AS delivery_id
  FROM events)
SELECT installation_id, repo_full_name, pr_number, head_sha, min(delivery_id) AS first_delivery,
       count(*) - 1 AS n_duplicates
FROM d GROUP BY ALL""")
def q_pr_head_dedupe(spark, sf_dir):
    """ST3 (batch form): one analysis claim per (installation, repo, PR, head);
    later deliveries of the same head are acknowledged as duplicates.
    Deliveries are derived from the events table."""
    e = T.read_table(spark, sf_dir, "events")
    d = e.select(F.when(F.col("user_id") % 5 < 3, 100).otherwise(200).alias("installation_id"),
                 F.concat(F.lit("acme/repo"), (F.col("user_id") % 5).cast("string")).alias("repo_full_name"),
                 (F.col("user_id") % 7).cast("int").alias("pr_number"),
                 F.substring(F.sha2(F.concat_ws(":", F.col("user_id").cast("string"),
                                                F.floor(F.col("event_id") / 100).cast("string")), 256), 1, 12).alias("head_sha"),
                 F.col("event_id").alias("delivery_id"))
    return d.groupBy("installation_id", "repo_full_name", "pr_number", "head_sha").agg(
        F.min("delivery_id").alias("first_delivery"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))


def _sequence_watch_fn(steps, window_us):
    def fn(key, pdfs, state):
        pending = [list(p) for p in (state.get[0] if state.exists else [])]
        out = []
        if state.hasTimedOut:
            wm = state.getCurrentWatermarkMs() * 1000
            keep = []
            for p in pending:
                (out.append((key[0], p[3], p[0], steps[p[2]])) if p[0] + window_us < wm else keep.append(p))
            pending = keep
        else:
            rows = pd.concat(list(pdfs)).sort_values(["t", "event_id"])
            for t, name, event_id in zip(rows["t"], rows["event_name"], rows["event_id"]):
                keep = []
                for p in pending:
                    if t > p[0] + window_us:
                        out.append((key[0], p[3], p[0], steps[p[2]]))
                        continue
                    if name == steps[p[2]] and t > p[1]:
                        p[1], p[2] = int(t), p[2] + 1
                        if p[2] == len(steps):
                            continue
                    keep.append(p)
                pending = keep
                if name == steps[0]:
                    pending.append([int(t), int(t), 1, int(event_id)])
        if pending:
            state.update((pending,))
            state.setTimeoutTimestamp(int(min(p[0] for p in pending) // 1000 + window_us // 1000 + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "start_id", "t1_us", "missing_step"])
    return fn


@query("stream_sequence_timeout")
def q_stream_sequence_timeout(spark, sf_dir):
    """ST10: alert when a started sequence misses a step within its window
    (event-time timeout per user). Once the source is drained, the same query
    runs on with one closing row of no user that takes the watermark past the
    last window, so every alert still pending fires; the row itself makes none."""
    from .q_sequences import steps_of
    steps, window = steps_of(spark)
    sink, ck = J.new_location(spark, "seqwatch")
    events = T.read_table(spark, sf_dir, "events")
    closing = scratch_path(spark, os.path.join("landing", f"closing-{uuid.uuid4().hex[:12]}"))
    events.limit(0).write.parquet(closing)
    e = J.with_event_time(events_stream(spark, sf_dir).unionByName(J.file_stream(spark, closing))) \
        .withWatermark("event_time", "1 hour")
    x = e.select("user_id", "event_time", "event_id", F.col("event_type").alias("event_name"),
                 F.unix_micros("event_time").alias("t"))
    alerts = x.groupBy("user_id").applyInPandasWithState(
        _sequence_watch_fn(steps, window * 1_000_000), "user_id long, start_id long, t1_us long, missing_step string",
        "pending array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)
    J.run_available_now(alerts, sink, ck)
    # the watermark lags an hour behind the closing row
    last = events.agg((F.max("ts") + F.make_dt_interval(hours=F.lit(2), secs=F.lit(window))).alias("ts"))
    last.where("ts IS NOT NULL").select(*[(F.col("ts") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name)
                                          for f in events.schema]).write.mode("append").parquet(closing)
    J.run_available_now(alerts, sink, ck)
    return spark.read.parquet(sink)
