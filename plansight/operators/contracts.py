"""Contracts on live events: required properties, property types, nearest
plan name for unknown events, signal routing.

Plan property and plan name tables are dimensions (bounded by the plan) and
are broadcast; events are streamed through narrow expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions.util import at as _at

# Where each signal type is routed.
ROUTES = {
    "action": ["analytics"],
    "operation": ["logs"],
    "state_change": ["analytics", "logs"],
    "error": ["logs", "alerts"],
}

NUMERIC_VARIANT = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def json_type_of(variant_type: Column) -> Column:
    """Map a ``schema_of_variant`` type to a JSON-schema-like type name."""
    return (F.when(variant_type.rlike(NUMERIC_VARIANT), "number")
            .when(variant_type == "STRING", "string")
            .when(variant_type == "BOOLEAN", "boolean")
            .when(variant_type.startswith("OBJECT"), "object")
            .when(variant_type.startswith("ARRAY"), "array")
            .when(variant_type == "NULL", "null")
            .otherwise(F.lower(variant_type)))


def declared_json_type(t: Column) -> Column:
    """Plan property type -> JSON type (dates travel as strings)."""
    return F.when(t == "date", "string").otherwise(t)


def property_types(names: list[str]) -> Column:
    """Map of the named properties to their ``schema_of_variant`` types in the JSON text ``properties``.

    A variant path quotes a name by ' or by ", without escapes: a name that holds both has no path and no type."""
    v = F.try_parse_json("properties")
    quoted = {n: f"['{n}']" if "'" not in n else f'["{n}"]' for n in names if "'" not in n or '"' not in n}
    pairs = [x for n, q in quoted.items() for x in (F.lit(n), F.schema_of_variant(F.try_variant_get(v, "$" + q, "variant")))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")


def property_names(plan_props: DataFrame) -> list[str]:
    """Distinct property names of the (small) property dimension."""
    return sorted({r.prop for r in plan_props.select("prop").distinct().collect()})


def contract_violations(events: DataFrame, plan_props: DataFrame) -> DataFrame:
    """For each event and each plan property of its (lower-cased) name:
    ``missing`` when a required, non-todo property is absent, ``type_mismatch``
    when a present property has another JSON type than declared.

    The property names are read from the (small) property dimension so that
    each becomes a literal JSON path; no per-row Python.
    """
    types = property_types(property_names(plan_props))
    ev = events.select("event_id", "event_name", "properties",
                       F.json_object_keys("properties").alias("_keys"), types.alias("_types"))
    pp = F.broadcast(plan_props.select(F.lower("event_name").alias("_k"), "prop", "type", "required", "todo"))
    j = ev.join(pp, F.lower(ev["event_name"]) == pp["_k"])
    present = F.coalesce(F.array_contains("_keys", F.col("prop")), F.lit(False))
    actual = json_type_of(_at("_types", F.col("prop")))
    viol = (F.when(F.col("required") & ~F.col("todo") & ~present, "missing")
            .when(present & (actual != declared_json_type(F.col("type"))), "type_mismatch"))
    return (j.withColumn("violation", viol).where(F.col("violation").isNotNull())
            .select("event_id", "event_name", "prop", F.col("type").alias("declared_type"),
                    F.when(present, actual).alias("actual_type"), "violation"))


def _segment_keys(name: Column, k: int) -> Column:
    """The ``k + 1`` even segments of an indexed name: array of (len, seg, text)."""
    size = F.length(name)
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(
        size.alias("len"), i.alias("seg"),
        F.substring(name, (F.floor(i * size / (k + 1)) + 1).cast("int"),
                    (F.floor((i + 1) * size / (k + 1)) - F.floor(i * size / (k + 1))).cast("int")).alias("text")))


def _probe_keys(name: Column, k: int) -> Column:
    """Every (len, seg, text) under which a name within ``k`` edits can be indexed.

    One of the ``k + 1`` segments is untouched by ``k`` edits. If it is moved by s and the lengths differ by d, at least
    |s| edits lie before it and |d - s| after it, so s runs from (d - k) / 2 to (d + k) / 2."""
    size = F.length(name)

    def of_length(n: Column) -> Column:
        def of_segment(i: Column) -> Column:
            start = F.floor(i * n / (k + 1))
            width = F.floor((i + 1) * n / (k + 1)) - start
            moves = F.sequence(F.ceil((size - n - k) / 2), F.floor((size - n + k) / 2))
            inside = F.filter(moves, lambda s: (start + s >= 0) & (start + s + width <= size))
            return F.transform(inside, lambda s: F.struct(n.alias("len"), i.alias("seg"),
                                                          F.substring(name, (start + s + 1).cast("int"), width.cast("int")).alias("text")))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), of_segment))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(size - k, F.lit(0)), size + k), of_length)))


def nearest_names(unknown: DataFrame, plan: DataFrame, max_distance: int = 4) -> DataFrame:
    """Nearest plan name by edit distance (<= ``max_distance``), first
    minimum in plan order wins; compared lower-cased.

    ``unknown(repo_id, name)`` is made distinct. Names meet plan names of the
    same repo only where they share a segment at a possible place (an index
    of segments, an equi-join); the distance is computed for those alone.
    """
    p = plan.select("repo_id", F.col("name").alias("plan_name"), "ord").select(
        F.col("repo_id").alias("_repo"), "plan_name", "ord", F.inline(_segment_keys(F.lower("plan_name"), max_distance)))
    u = unknown.select("repo_id", "name").distinct()
    probes = u.select("repo_id", "name", F.inline(_probe_keys(F.lower("name"), max_distance)))
    d = F.levenshtein(F.lower("name"), F.lower("plan_name"), max_distance)
    cand = (probes.join(p, (probes["repo_id"] == p["_repo"]) & (probes["len"] == p["len"]) & (probes["seg"] == p["seg"])
                        & (probes["text"] == p["text"]))
            .select(probes["repo_id"], "name", "plan_name", "ord", d.alias("dist"))
            .where(F.col("dist") >= 0))
    best = cand.groupBy("repo_id", "name").agg(
        F.min_by("plan_name", F.struct("dist", "ord")).alias("suggestion"),
        F.min("dist").alias("distance"))
    return u.join(best, ["repo_id", "name"], "left")


def signal_routes(events_with_signal: DataFrame) -> DataFrame:
    """One row per event and destination class of its signal type."""
    m = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    return events_with_signal.withColumn("destination", F.explode(F.coalesce(
        _at(m, F.col("signal_type")), F.array(F.lit("analytics")))))
