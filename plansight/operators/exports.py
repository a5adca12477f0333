"""Plan exports: Segment Protocols, Amplitude taxonomy, OpenTelemetry
semantic conventions, stream-filter rules, agent context.

Exports take the active (non-deprecated) plan and its properties. Properties
are the declared plan properties plus, for names the plan does not describe,
the keys actually observed in the event stream with their JSON types
(``schema_of_variant_agg`` per event name - a partial aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def observed_props(events: DataFrame) -> DataFrame:
    """Keys and JSON types seen per (repo, lower(event name))."""
    agg = (events.groupBy("repo_id", F.lower("event_name").alias("event_name"))
           .agg(F.schema_of_variant_agg(F.try_parse_json("properties")).alias("_s")))
    pairs = agg.select("repo_id", "event_name",
                       F.explode(F.regexp_extract_all("_s", F.lit(r"(\w+): ([A-Z]+)"), 0)).alias("_kv"))
    key = F.regexp_extract("_kv", r"^(\w+):", 1)
    vt = F.regexp_extract("_kv", r": ([A-Z]+)$", 1)
    typ = (F.when(vt.rlike(NUMERIC), "number").when(vt == "STRING", "string")
           .when(vt == "BOOLEAN", "boolean").when(vt == "OBJECT", "object").otherwise("string"))
    return pairs.select("repo_id", "event_name", key.alias("prop"), typ.alias("type"))


def export_props(plan: DataFrame, declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Properties of each active plan event: declared (by exact name) first,
    in declaration order; otherwise the observed keys (by lower-cased name),
    sorted, optional. One row per (repo, event, property)."""
    act = plan.where(F.col("status") != "deprecated").select("repo_id", "name", "description", "priority")
    d = F.broadcast(declared.select(F.col("event_name").alias("name"), "prop", "type", "required",
                                    F.col("description").alias("prop_description") if "description" in declared.columns
                                    else F.lit(None).cast("string").alias("prop_description"),
                                    F.col("ord").alias("prop_ord")))
    with_decl = act.join(d, "name")
    has_decl = with_decl.select("repo_id", "name").distinct()
    o = observed.select("repo_id", F.col("event_name").alias("_k"), "prop", "type")
    undecl = act.join(has_decl, ["repo_id", "name"], "left_anti").withColumn("_k", F.lower("name"))
    obs = (undecl.join(o, ["repo_id", "_k"])
           .withColumn("required", F.lit(False))
           .withColumn("prop_description", F.lit(None).cast("string"))
           .withColumn("prop_ord", F.dense_rank().over(Window.partitionBy("repo_id", "name").orderBy("prop")))
           .drop("_k"))
    return with_decl.unionByName(obs.select(*with_decl.columns))


def _map_type(t, date_to="string", object_to=None):
    out = F.when(t == "date", date_to)
    if object_to:
        out = out.when(t == "object", object_to)
    return out.otherwise(t)


def segment_rows(plan: DataFrame, props: DataFrame) -> DataFrame:
    """S10 flattened: one row per event and property (``null`` property for
    events without any); type in Segment's JSON-schema spelling."""
    act = plan.where(F.col("status") != "deprecated").select("repo_id", "name", "description")
    j = act.join(props.select("repo_id", "name", "prop", "type", "required", "prop_ord"), ["repo_id", "name"], "left")
    return j.select("repo_id", F.col("name").alias("event_name"), "description", "prop",
                    _map_type(F.col("type")).alias("json_type"),
                    F.coalesce("required", F.lit(False)).alias("is_required"))


def amplitude_rows(plan: DataFrame, props: DataFrame) -> DataFrame:
    """S11 flattened: category core for critical/high, else other; date ->
    string, object -> any."""
    act = plan.where(F.col("status") != "deprecated").select("repo_id", "name", "description", "priority")
    j = act.join(props.select("repo_id", "name", "prop", "type", "required"), ["repo_id", "name"], "left")
    cat = F.when(F.col("priority").isin("critical", "high"), "core").otherwise("other")
    return j.select("repo_id", F.col("name").alias("event_name"), cat.alias("category"), "prop",
                    _map_type(F.col("type"), object_to="any").alias("type"),
                    F.coalesce("required", F.lit(False)).alias("is_required"))


def _yq(c):
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def otel_yaml(plan: DataFrame, props: DataFrame) -> DataFrame:
    """The YAML block of each active event (a group of the semantic
    conventions file), properties in order; one text row per event."""
    act = plan.where(F.col("status") != "deprecated").select("repo_id", "name", "description")
    attr = F.concat_ws("\n",
                       F.concat(F.lit("      - id: "), "prop"),
                       F.concat(F.lit("        type: "), _map_type(F.col("type"), object_to="any")),
                       F.concat(F.lit("        requirement_level: "),
                                F.when(F.col("required"), "required").otherwise("recommended")),
                       F.when(F.col("prop_description").isNotNull() & (F.col("prop_description") != ""),
                              F.concat(F.lit("        brief: "), _yq(F.col("prop_description")))))
    attrs = (props.groupBy("repo_id", "name")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop_ord", attr.alias("a")))),
                                           lambda s: s["a"]), "\n").alias("_attrs")))
    j = act.join(attrs, ["repo_id", "name"], "left")
    head = F.concat_ws("\n", F.concat(F.lit("  - id: "), "name"), F.lit("    type: event"),
                       F.concat(F.lit("    brief: "), _yq(F.col("description"))), F.lit("    stability: experimental"))
    text = F.when(F.col("_attrs").isNotNull(), F.concat_ws("\n", head, F.lit("    attributes:"), F.col("_attrs"))).otherwise(head)
    return j.select("repo_id", F.col("name").alias("event_name"), text.alias("yaml"))


def stream_rules(plan: DataFrame, props: DataFrame) -> DataFrame:
    """A pass filter per active event and a validate transform per event
    with required properties (listed in order)."""
    act = plan.where(F.col("status") != "deprecated").select("repo_id", "name")
    filters = act.select("repo_id", F.lit("filter").alias("kind"), F.concat(F.lit("filter_"), "name").alias("rule"),
                         F.col("name").alias("event_name"), F.lit("pass").alias("action"),
                         F.lit(None).cast("string").alias("required"))
    req = (props.where("required").groupBy("repo_id", "name")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prop_ord", "prop"))),
                                         lambda s: s["prop"]), ",").alias("required")))
    tr = act.join(req, ["repo_id", "name"]).select(
        "repo_id", F.lit("transform").alias("kind"), F.concat(F.lit("validate_"), "name").alias("rule"),
        F.col("name").alias("event_name"), F.lit("validate").alias("action"), "required")
    return filters.unionByName(tr)


def agent_context(events: DataFrame, metrics: DataFrame, sequences: DataFrame, actors: DataFrame,
                  objects: DataFrame, relationships: DataFrame, paths: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """One compact JSON document per repo for agents: actors, objects,
    relationships, lifecycles, join paths, expected sequences, events
    (name, priority, status, includes) and metrics (name, formula, category,
    grain, events). Every section is bounded by the plan / graph size, not by
    the event stream; arrays are ordered so the document is deterministic."""
    def section(df, name, fields, order):
        return df.groupBy("repo_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.struct(*fields).alias("_v")))),
            lambda s: s["_v"]).alias(name))
    secs = [
        section(actors, "actors", ["name", "type", "identifier_pattern", "confidence"], ["name"]),
        section(objects, "objects", ["name", "source", F.col("exposed_via_api").alias("exposedViaAPI")], ["ord"]),
        section(relationships, "relationships", ["child", "parent", "relationship"], ["ord"]),
        section(lifecycles, "lifecycles", ["object", "states"], ["object"]),
        section(paths, "joinPaths", ["from", "to", "via"], ["from", "to"]),
        section(sequences, "expectedSequences", ["name", "steps", F.col("expected_window").alias("expectedWindow")], ["name"]),
        section(events, "events", ["name", "priority", "status", "includes"], ["ord", "name"]),
        section(metrics, "metrics", [F.col("metric").alias("name"), "formula", "category", "grain", "events"], ["metric"]),
    ]
    base = events.select("repo_id").distinct()
    for s in secs:
        base = base.join(s, "repo_id", "left")
    cols = [c for c in base.columns if c != "repo_id"]
    doc = F.to_json(F.struct(*[F.col(c) for c in cols]))
    return base.select("repo_id", doc.alias("document"),
                       *[F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in cols])
