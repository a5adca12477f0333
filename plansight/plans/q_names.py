"""Name functions (F1-F8, P2-P5, P7) over identifiers found in the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..sources import corpus, tables as T
from . import duck as D
from . import fixtures as fx
from .catalog import query

IDENT = r"[A-Za-z_][A-Za-z0-9_]*"

NAMES_DUCK = fx.with_ctes(fx.CODE_LINES_CTE, f"""tok AS (
  SELECT DISTINCT unnest(regexp_extract_all(text, '{IDENT}')) AS name FROM code_lines),
names AS (
  SELECT name FROM tok
  UNION SELECT {D.snake_from_camel('name')} FROM tok
  UNION SELECT event_type FROM events)""")


def corpus_names(spark, sf_dir):
    """Distinct identifiers of the derived corpus, their snake_case forms and
    the event types: one row per distinct name (shuffle by name)."""
    lines = corpus.code_lines(spark, sf_dir)
    tok = lines.select(F.explode(F.regexp_extract_all("text", F.lit(IDENT), 0)).alias("name")).distinct()
    ev = T.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    return (tok.unionByName(tok.select(N.snake_from_camel("name").alias("name")))
            .unionByName(ev).distinct())


@query("names_functions", oracle=NAMES_DUCK + f"""
SELECT name,
  {D.snake_from_camel('name')} AS snake,
  {D.snake_from_words("string_split(name, '_')")} AS snake_words,
  {D.pascal_keep_tail('name')} AS pascal_keep,
  {D.pascal_lower_tail('name')} AS pascal_lower,
  {D.singular('name')} AS singular,
  {D.past_tense('name')} AS past_tense,
  {D.event_id('name')} AS event_id,
  {D.metric_id("name || '_count'")} AS metric_id
FROM names""")
def q_names_functions(spark, sf_dir):
    n = corpus_names(spark, sf_dir)
    return n.select(
        "name",
        N.snake_from_camel("name").alias("snake"),
        N.snake_from_words(F.split("name", "_")).alias("snake_words"),
        N.pascal_keep_tail("name").alias("pascal_keep"),
        N.pascal_lower_tail("name").alias("pascal_lower"),
        N.singular("name").alias("singular"),
        N.past_tense("name").alias("past_tense"),
        N.event_id("name").alias("event_id"),
        N.metric_id(F.concat("name", F.lit("_count"))).alias("metric_id"),
    )


@query("valid_event_names", oracle=NAMES_DUCK + f"""
SELECT name, {D.is_valid_event_name('name')} AS valid FROM names""")
def q_valid_event_names(spark, sf_dir):
    return corpus_names(spark, sf_dir).select("name", N.is_valid_event_name("name").alias("valid"))


@query("business_events", oracle=NAMES_DUCK + f"""
SELECT name FROM names WHERE {D.is_business_event('name')}""")
def q_business_events(spark, sf_dir):
    return corpus_names(spark, sf_dir).where(N.is_business_event("name"))


_obj, _act = D.split_object_action("name")


@query("event_object_action", oracle=NAMES_DUCK + f"""
SELECT name, {_obj} AS object, {_act} AS action,
  {D.object_of_synth('name')} AS synth_object, {D.entity_of_scored('name')} AS scored_entity
FROM names""")
def q_event_object_action(spark, sf_dir):
    obj, act = N.split_object_action("name")
    return corpus_names(spark, sf_dir).select(
        "name", obj.alias("object"), act.alias("action"),
        N.object_of_synth("name").alias("synth_object"),
        N.entity_of_scored("name").alias("scored_entity"))


INTERACTION_TYPES = ["click_handler", "form_submit", "toggle", "route_handler", "mutation",
                     "lifecycle", "state_change", "error_boundary", "api_call", "retry_logic",
                     "job_handler", "other"]


def _types_sql():
    return "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in INTERACTION_TYPES) + ") AS it(itype)"


@query("signal_types", oracle=NAMES_DUCK + f""", it AS ({_types_sql()}),
pick AS (SELECT name, it.itype FROM names JOIN it
         ON it.itype = (CASE WHEN length(name) % 2 = 0 THEN 'mutation' ELSE 'click_handler' END)
            OR (name = 'error' AND it.itype = 'error_boundary'))
SELECT name, itype, {D.signal_type('itype')} AS signal_type,
       {D.priority_heuristic('name', 'itype')} AS priority
FROM pick""".replace("WITH ", "WITH ", 1))
def q_signal_types(spark, sf_dir):
    """P5 + P7: signal type and heuristic priority of each name under the
    interaction type it would be detected as (even length: mutation, else
    click handler; ``error`` also as an error boundary)."""
    n = corpus_names(spark, sf_dir)
    base = n.withColumn("itype", F.when(F.length("name") % 2 == 0, "mutation").otherwise("click_handler"))
    err = n.where(F.col("name") == "error").withColumn("itype", F.lit("error_boundary"))
    x = base.unionByName(err)
    return x.select("name", "itype", N.signal_type("itype").alias("signal_type"),
                    N.priority_heuristic("name", "itype").alias("priority"))


@query("object_from_path", oracle=fx.with_ctes(fx.CODE_LINES_CTE) + f"""
SELECT DISTINCT path, {D.object_from_path('path')} AS object FROM code_lines""")
def q_object_from_path(spark, sf_dir):
    return corpus.code_lines(spark, sf_dir).select("path").distinct() \
        .select("path", N.object_from_path("path").alias("object"))
