"""Context graph: objects, actors, lifecycles, foreign-key relationships,
join paths, hierarchy properties, ontology edges, join-path execution.

Objects, relationships and paths are per repository and tiny next to the
corpus; the corpus side is always reduced first (regex matches -> distinct
facts) before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..functions.util import LATER
from ..functions.util import at as _at

from ..functions import names as N
from ..session import materialize
from .corpus import regex_matches

# Object, relationship and lifecycle patterns.
PRISMA_MODEL = r"\bprisma\.([A-Za-z_][A-Za-z0-9_]*)\.(create|update|delete|upsert)\b"
SUPABASE_TABLE = r"""\bsupabase\.from\(\s*['"]([^'"]+)['"]\s*\)"""
API_SEGMENT = r"""['"`]/api/([A-Za-z0-9_-]+)(?:/|['"`])"""
PRISMA_ANY = r"\bprisma\.([A-Za-z_][A-Za-z0-9_]*)\."
API_ANY = r"""['"`]/api/([A-Za-z0-9_-]+)"""
FK_TOKEN = r"\b([A-Za-z_][A-Za-z0-9_]*?)(Id|_id)\b"
STATUS_ENUM = r"\benum\s+([A-Za-z_][A-Za-z0-9_]*Status)\s*\{([\s\S]*?)\}"
STATE_ENUM = r"\benum\s+([A-Za-z_][A-Za-z0-9_]*(?i:Status|State))\s*\{([\s\S]*?)\}"
STATE_TYPE = r"\btype\s+([A-Za-z_][A-Za-z0-9_]*(?:Status|State))\s*=\s*([^;]+);"
STATUS_TYPE = r"\btype\s+([A-Za-z_][A-Za-z0-9_]*Status)\s*=\s*([^;]+);"
ACTOR_USER = [r"req\.user\b|request\.user\b|session\.user\b", r"\buse(Auth|User|Session)\b"]
ACTOR_SYSTEM = r"\bcron\b|\bschedule\b|\bsetInterval\b"
ACTORS = [("User", "user", "user.id", "auth/session usage", 0.7),
          ("System", "system", "system", "cron/scheduler patterns", 0.5),
          ("Stripe", "integration", "stripe.customer", "stripe webhook patterns", 0.6)]


def object_mentions(files: DataFrame) -> DataFrame:
    """Every object mention with its source, in (path, pattern, offset) order."""
    a = regex_matches(files, PRISMA_MODEL, (1,)).select(
        "repo", "path", "offset", N.pascal_keep_tail(F.col("g1")).alias("name"),
        F.lit("prisma").alias("source"), F.lit(False).alias("api"), F.lit(0).alias("pattern_no"))
    b = regex_matches(files, SUPABASE_TABLE, (1,)).select(
        "repo", "path", "offset", N.pascal_keep_tail(F.regexp_replace("g1", "s$", "")).alias("name"),
        F.lit("database").alias("source"), F.lit(False).alias("api"), F.lit(1).alias("pattern_no"))
    c = regex_matches(files, API_SEGMENT, (1,)).select(
        "repo", "path", "offset",
        N.pascal_keep_tail(F.regexp_replace(F.regexp_replace("g1", "s$", ""), "-", "_")).alias("name"),
        F.lit("inferred").alias("source"), F.lit(True).alias("api"), F.lit(2).alias("pattern_no"))
    return a.unionByName(b).unionByName(c)


def context_objects(files: DataFrame) -> DataFrame:
    """Objects merged by lower-cased name: first spelling and source
    kept, API exposure OR-ed, properties unioned (each mention adds ``id``)."""
    order = F.struct("path", "pattern_no", "offset")
    return (object_mentions(files).groupBy("repo", F.lower("name").alias("key"))
            .agg(F.min_by("name", order).alias("name"), F.min_by("source", order).alias("source"),
                 F.bool_or("api").alias("exposed_via_api"), F.lit("id").alias("properties"),
                 F.min(order).alias("_first"))
            .withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("_first")))
            .drop("_first"))


def context_actors(files: DataFrame) -> DataFrame:
    """Actors whose signals appear in any file of the repo."""
    c = F.col("content")
    flags = files.groupBy("repo").agg(
        F.bool_or(c.rlike(ACTOR_USER[0]) | c.rlike(ACTOR_USER[1])).alias("User"),
        F.bool_or(c.rlike(ACTOR_SYSTEM)).alias("System"),
        F.bool_or(c.rlike(r"(?i)\bstripe\b") & c.rlike(r"(?i)\bwebhook\b")).alias("Stripe"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(i).alias("identifier_pattern"),
                              F.lit(d).alias("detected_from"), F.lit(conf).alias("confidence"),
                              F.col(n).alias("_on")) for n, t, i, d, conf in ACTORS])
    return flags.select("repo", F.explode(rows).alias("a")).where("a._on").select("repo", "a.name", "a.type",
                                                                                  "a.identifier_pattern", "a.detected_from", "a.confidence")


def primary_object(files: DataFrame, objects: DataFrame) -> DataFrame:
    """Primary object of each file: first prisma model, else supabase table,
    else API segment, else the file name if it names a known object."""
    c = F.col("content")
    def rx(p):
        return F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    base = F.regexp_replace(_at(F.split("path", r"[\\/]"), -1), r"\.(ts|tsx|js|jsx)$", "")
    guess = N.pascal_keep_tail(F.regexp_replace(base, "s$", ""))
    x = files.select("repo", "path",
                     F.coalesce(N.pascal_keep_tail(rx(PRISMA_ANY)),
                                N.pascal_keep_tail(F.regexp_replace(rx(SUPABASE_TABLE), "s$", "")),
                                N.pascal_keep_tail(F.regexp_replace(F.regexp_replace(rx(API_ANY), "s$", ""), "-", "_")))
                     .alias("_p"), guess.alias("_g"))
    known = objects.select(F.col("repo").alias("_gr"), F.col("key").alias("_gk")).withColumn("_known", F.lit(True))
    x = x.join(known, (F.col("repo") == F.col("_gr")) & (F.lower(F.col("_g")) == F.col("_gk")), "left").drop("_gr", "_gk")
    return x.select("repo", "path", F.coalesce("_p", F.when(F.col("_known"), F.col("_g"))).alias("child"))


def fk_relationships(files: DataFrame, objects: DataFrame) -> DataFrame:
    """``xId`` / ``x_id`` tokens naming a known object are edges from the
    file's primary object (child) to that object (parent); deduplicated by
    (child, parent), first occurrence kept for ordering."""
    toks = regex_matches(files, FK_TOKEN, (1,)).select(
        "repo", "path", "offset", N.pascal_keep_tail(F.regexp_replace("g1", "_+$", "")).alias("parent"))
    known = objects.select(F.col("repo").alias("_r"), F.col("key").alias("_k"))
    toks = toks.join(known, (toks["repo"] == F.col("_r")) & (F.lower("parent") == F.col("_k"))).drop("_r", "_k")
    prim = primary_object(files, objects)
    e = toks.join(prim, ["repo", "path"]).where(F.col("child").isNotNull())
    first = F.struct("path", "offset")
    d = e.groupBy("repo", F.lower("child").alias("_c"), F.lower("parent").alias("_p")).agg(
        F.min_by("child", first).alias("child"), F.min_by("parent", first).alias("parent"), F.min(first).alias("_f"))
    return (d.withColumn("ord", F.row_number().over(Window.partitionBy("repo").orderBy("_f")))
            .select("repo", "child", "parent", F.lit("belongs_to").alias("relationship"), "ord"))


def _via(child: Column, parent: Column) -> Column:
    return F.concat(child, F.lit("."), N.snake_from_camel(parent), F.lit("_id → "), parent, F.lit(".id"))


def join_paths(rel: DataFrame, keys: list[str] | None = None, max_hops: int | None = 3) -> DataFrame:
    """Child -> parent paths of up to ``max_hops`` edges (None: any number), the shortest per
    (from, to); among equally short ones the first in edge order (the BFS discovery order).

    Semi-naive: each round extends only the pairs that the round before found first, by one edge, and keeps those not
    found yet; a shortest path's beginning is itself a shortest one, so no path is missed, and a cycle ends. Rounds are
    written, and the last one finds nothing."""
    keys = keys or []
    pair = [*keys, "from", "to"]
    e = materialize(rel.select(*keys, F.col("child").alias("_c"), F.col("parent").alias("_p"), "ord").withColumn(
        "_via", _via(F.col("_c"), F.col("_p"))))

    def first(paths: DataFrame) -> DataFrame:
        return paths.groupBy(*pair).agg(F.min_by(F.struct("via", "ords"), "ords").alias("b")).select(*pair, "b.via", "b.ords")

    frontier = materialize(first(e.select(*keys, F.col("_c").alias("from"), F.col("_p").alias("to"), F.array("_via").alias("via"),
                                          F.array("ord").alias("ords"))))
    found, hops = frontier, 1
    while max_hops is None or hops < max_hops:
        longer = frontier.join(e, [frontier[k] == e[k] for k in keys] + [frontier["to"] == e["_c"]])
        longer = longer.select(*[frontier[k] for k in keys], "from", F.col("_p").alias("to"), F.concat("via", F.array("_via")).alias("via"),
                               F.concat("ords", F.array("ord")).alias("ords"))
        frontier = materialize(first(longer.join(found.select(*pair), pair, "left_anti")))
        if frontier.isEmpty():
            break
        found, hops = found.unionByName(frontier), hops + 1
    return found.select(*pair, F.size("via").alias("hops"), F.array_join("via", " | ").alias("via"), "ords")


def hierarchy_props(objects_of_events: DataFrame, rel: DataFrame, paths: DataFrame) -> DataFrame:
    """``<parent>_id`` (required, todo) per direct parent of the event's
    object and ``<grandparent>_id`` (optional, todo) from the first join path
    of at least two hops, unless it is the object or a direct parent."""
    ev = objects_of_events.withColumn("_obj", N.snake_from_camel("object"))
    parents = ev.join(rel, (ev["repo"] == rel["repo"]) & (F.lower(rel["child"]) == F.lower(ev["_obj"]))) \
        .select(ev["repo"], "event_name", "_obj", "parent", rel["ord"].alias("_o"))
    parents = parents.withColumn("_ps", N.snake_from_camel("parent")).where(F.col("_ps") != F.col("_obj"))
    direct = parents.select("repo", "event_name", F.concat("_ps", F.lit("_id")).alias("prop"),
                            F.lit("string").alias("type"), F.lit(True).alias("required"),
                            F.concat(F.lit("ID of the parent "), "parent").alias("description"),
                            F.col("_o").cast("bigint").alias("ord"))
    long = paths.where(F.col("hops") >= 2)
    gp0 = ev.join(long, (ev["repo"] == long["repo"]) & (F.lower(long["from"]) == F.lower(N.pascal_keep_tail(F.col("_obj")))))
    gp = gp0.groupBy(ev["repo"], "event_name", "_obj").agg(F.min_by("to", F.struct("hops", "ords")).alias("gp"))
    gp = gp.withColumn("_gs", N.snake_from_camel("gp"))
    dps = parents.groupBy("repo", "event_name").agg(F.collect_set("_ps").alias("_dps"))
    gp = gp.join(dps, ["repo", "event_name"], "left").where(
        (F.col("_gs") != F.col("_obj")) & ~F.coalesce(F.array_contains("_dps", F.col("_gs")), F.lit(False)))
    grand = gp.select("repo", "event_name", F.concat("_gs", F.lit("_id")).alias("prop"), F.lit("string").alias("type"),
                      F.lit(False).alias("required"),
                      F.concat(F.lit("ID of the grandparent "), "gp", F.lit(" (for cross-entity correlation)")).alias("description"),
                      F.lit(LATER).alias("ord"))
    u = direct.unionByName(grand)
    w = Window.partitionBy("repo", "event_name", "prop").orderBy("ord")
    return u.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("todo", F.lit(True))


def lifecycles_from_code(files: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """One lifecycle per object from ``enum XStatus { … }`` and ``type XStatus = 'a' | 'b';``.

    With ``objects`` only known objects count and only the ``Status`` ending;
    without, ``State`` is an ending too (in any case for enums). States are
    lower-cased; those of several declarations are merged in the order of
    file, enum before type, and place. Enum bodies are split on comma or
    newline (the documented intent)."""
    loose = objects is None
    enum, alias = (STATE_ENUM, STATE_TYPE) if loose else (STATUS_ENUM, STATUS_TYPE)
    ending = "(?i:Status|State)$" if loose else "Status$"
    names = F.transform(F.split("g2", r"[,\n]"), lambda s: F.trim(F.regexp_replace(F.trim(s), "=.*", "")))
    texts = F.transform(F.split("g2", r"\|"), lambda s: F.regexp_replace(F.trim(s), r"""^['"]|['"]$""", ""))

    def declarations(pattern: str, kind: int, states: Column, valid: str) -> DataFrame:
        return regex_matches(files, pattern, (1, 2)).select(
            "repo", "path", "offset", F.lit(kind).alias("kind"), F.regexp_replace("g1", ending, "").alias("object"),
            F.transform(F.filter(states, lambda s: s.rlike(valid)), lambda s: F.lower(s)).alias("states"))

    x = declarations(enum, 0, names, r"^[A-Za-z_][A-Za-z0-9_]*$").unionByName(
        declarations(alias, 1, texts, r"(?i)^[a-z0-9_-]{3,30}$")).where(F.size("states") > 0).withColumn("key", F.lower("object"))
    if objects is not None:
        x = x.join(objects.select("repo", "key"), ["repo", "key"], "left_semi")
    # a group is the declarations of one object, each a line or two of code
    declared = F.array_sort(F.collect_list(F.struct("path", "kind", "offset", "object", "states")))
    return x.groupBy("repo", "key").agg(declared.alias("d")).select(
        "repo", F.col("d")[0]["object"].alias("object"), F.array_distinct(F.flatten(F.col("d.states"))).alias("states"))


def lifecycle_edges(states: DataFrame) -> DataFrame:
    """Consecutive states of each lifecycle (``states(object, ord, state)``)."""
    w = Window.partitionBy("object").orderBy("ord")
    return (states.withColumn("to_state", F.lead("state").over(w)).where(F.col("to_state").isNotNull())
            .select("object", F.col("state").alias("from_state"), "to_state"))


def path_rollup(start: DataFrame, hops: list[tuple[DataFrame, str, str]], group_key: str,
                measures: dict[str, Column], out_cols: list[str]) -> DataFrame:
    """Walk a join path child -> parent -> ..., aggregating before every
    join: rows of the start table are first reduced to one row per foreign
    key, so each later join sees at most one row per parent key (eager
    aggregation; a hot key never reaches a join as many rows).

    ``hops`` = [(parent_df, child_fk, parent_pk)]; ``measures`` are additive
    aggregates over the start rows; the result is grouped by ``group_key``
    of the last parent, with ``out_cols`` of it kept.
    """
    fk0 = hops[0][1]
    cur = start.groupBy(fk0).agg(*[m.alias(n) for n, m in measures.items()]).withColumnRenamed(fk0, "_k")
    names = list(measures)
    for i, (parent, _fk, pk) in enumerate(hops):
        nxt_fk = hops[i + 1][1] if i + 1 < len(hops) else None
        keep = [nxt_fk] if nxt_fk else [group_key, *out_cols]
        p = parent.select(F.col(pk).alias("_k"), *keep)
        j = cur.join(p, "_k")
        gk = nxt_fk if nxt_fk else group_key
        extra = [] if nxt_fk else [F.first(c).alias(c) for c in out_cols]
        cur = j.groupBy(gk).agg(*[F.sum(n).alias(n) for n in names], *extra)
        if nxt_fk:
            cur = cur.withColumnRenamed(nxt_fk, "_k")
    return cur
