"""Fan-out payloads (S9): one JSON document per accepted event and destination.

Delivery over HTTP is not done here; the payloads are data, written per
destination by the caller (``foreachBatch`` in streaming). Message ids are
deterministic (sha256 of request id, position and destination) instead of
random UUIDs, so a re-run produces the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import is_allowed_url

LIB_NAME = "plansight"


def _jstr(c: Column) -> Column:
    """JSON string literal of a string column (to_json escapes it)."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)


def _inner(props: Column) -> Column:
    """Members of a JSON object text without the braces ('' for {} or null)."""
    p = F.coalesce(props, F.lit("{}"))
    return F.trim(F.regexp_replace(F.regexp_replace(p, r"^\s*\{", ""), r"\}\s*$", ""))


def _join_members(a: Column, b: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", F.when(a != "", a), F.when(b != "", b)), F.lit("}"))


def fanout_payloads(events: DataFrame, targets: DataFrame, allowed_hosts: list[str] | None) -> DataFrame:
    """Join accepted events with their repo's destinations and render payloads.

    A custom target whose URL is not allowed blocks every destination of the
    repo's events (``blocked_all``), as the reference does. PostHog appends
    ``$lib`` after the properties; Mixpanel puts ``token`` first, so a
    property named ``token`` wins; Mixpanel carries no timestamp; Amplitude's
    user defaults to ``anonymous``.
    """
    t = targets.withColumn("_ok", F.when(F.col("destination") == "custom", is_allowed_url(F.col("url"), allowed_hosts))
                           .otherwise(F.lit(True)))
    blocked = t.groupBy("repo_id").agg(F.bool_or(~F.col("_ok")).alias("blocked_all"))
    tt = F.broadcast(t.join(blocked, "repo_id"))
    j = events.join(tt, "repo_id").where(~F.col("blocked_all"))
    ev = _jstr(F.col("event_name"))
    props = F.coalesce(F.col("properties"), F.lit("{}"))
    inner = _inner(F.col("properties"))
    ts = _jstr(F.col("client_ts"))
    key = _jstr(F.col("api_key"))
    mid = F.sha2(F.concat_ws("|", "request_id", F.col("pos").cast("string"), "destination"), 256)
    uid = F.get_json_object(props, "$.user_id")
    millis = F.unix_millis(F.to_timestamp(F.col("client_ts")))
    d = F.col("destination")
    payload = (
        F.when(d == "segment",
               F.concat(F.lit('{"type":"track","event":'), ev, F.lit(',"properties":'), props,
                        F.lit(',"timestamp":'), ts, F.lit(',"messageId":"'), mid, F.lit('"}')))
        .when(d == "posthog",
              F.concat(F.lit('{"api_key":'), key, F.lit(',"event":'), ev, F.lit(',"properties":'),
                       _join_members(inner, F.lit(f'"$lib":"{LIB_NAME}"')),
                       F.lit(',"timestamp":'), ts, F.lit("}")))
        .when(d == "mixpanel",
              F.concat(F.lit('[{"event":'), ev, F.lit(',"properties":'),
                       _join_members(F.concat(F.lit('"token":'), key), inner), F.lit("}]")))
        .when(d == "amplitude",
              F.concat(F.lit('{"api_key":'), key, F.lit(',"events":[{"event_type":'), ev,
                       F.lit(',"event_properties":'), props, F.lit(',"time":'), millis.cast("string"),
                       F.lit(',"insert_id":"'), mid, F.lit('","user_id":'),
                       _jstr(F.coalesce(uid, F.lit("anonymous"))), F.lit("}]}")))
        .otherwise(F.concat(F.lit('{"event":'), ev, F.lit(',"properties":'), props,
                            F.lit(',"timestamp":'), ts, F.lit("}"))))
    return j.select("request_id", "pos", "repo_id", "destination", "event_name",
                    mid.alias("message_id"), payload.alias("payload"))
