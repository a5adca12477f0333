"""Queries over the event store (S7, S8): appended as a stream, compacted, scanned with partition pruning."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import events as E
from ..session import scratch_path
from ..sources import event_store as S
from ..sources import tables as T
from ..streaming import jobs as J
from . import fixtures as fx
from .catalog import query
from .q_events import COUNTS_7D, EV

SCHEMA = "event_id long, repo_id long, event_name string, user_id long, properties string, environment string, received_at timestamp_ntz"
OPEN_DAYS = 4  # the newest days still change and are not compacted


def filled(spark, sf_dir):
    """The store of the given events: appended, and compacted but for the newest days."""
    store = S.EventStore(spark, scratch_path(spark, os.path.join("stores", uuid.uuid4().hex[:12])), SCHEMA)
    events = T.canonical_events(J.file_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet"))
    store.append(events.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")]))
    newest = T.read_table(spark, sf_dir, "events").agg(F.to_date(F.max("ts"))).first()[0]
    if newest is not None:
        store.compact(F.date_sub(F.lit(newest), OPEN_DAYS))
    return store


@query("store_event_counts", oracle=fx.with_ctes(EV, COUNTS_7D) + "SELECT * FROM c")
def q_store_event_counts(spark, sf_dir):
    """A1 over the store: the seven-day bound prunes dates; compacted and open days both lie in the range."""
    store = filled(spark, sf_dir)
    newest = store.scan().agg(F.max("received_at")).scalar()
    return E.event_counts(store.scan(since=newest - F.make_dt_interval(F.lit(7))), days=7, as_of=newest)


@query("store_repo_windows", oracle=fx.with_ctes(EV) + """
SELECT repo_id, event_name, count(*) AS n_events, min(received_at) AS first_seen
FROM ev WHERE repo_id < 4 AND received_at >= (SELECT max(received_at) FROM ev) - to_days(CAST(2 * repo_id + 1 AS INT))
GROUP BY ALL""")
def q_store_repo_windows(spark, sf_dir):
    """S8 with a window per repo (1, 3, 5 and 7 days): dates are pruned by the broadcast windows."""
    store = filled(spark, sf_dir)
    newest = store.scan().agg(F.max("received_at")).scalar()
    repos = T.repos(spark).where("repo_id < 4").select(
        "repo_id", (newest - F.make_dt_interval((2 * F.col("repo_id") + 1).cast("int"))).alias("since"))
    return store.windows(repos).groupBy("repo_id", "event_name").agg(F.count(F.lit(1)).alias("n_events"), F.min("received_at").alias("first_seen"))


@query("store_compaction", oracle=fx.with_ctes(EV) + f"""
SELECT CAST(received_at AS DATE) AS date, count(*) AS n_rows, CAST(received_at AS DATE) < (SELECT CAST(max(received_at) AS DATE) FROM ev) - {OPEN_DAYS} AS compacted
FROM ev GROUP BY ALL""")
def q_store_compaction(spark, sf_dir):
    """Rows per day as a reader sees them, and whether the day is read from its compacted files."""
    closed = F.col("part") == "days"
    return filled(spark, sf_dir).files().groupBy("date").agg(
        F.max_by("n_rows", closed).alias("n_rows"), F.bool_or(closed).alias("compacted"))
