"""Scan path: interactions -> event names -> dedupe -> business grouping ->
relevance score -> gaps (C8, F12, F13, A8-A11, C10, P8, J5, T3, W8).

Order-sensitive choices of the reference ("first wins on ties") use an
explicit ``pos`` = (path, detector, match number) of each interaction's first
detection; every dedupe is a grouped ``max_by``/``min_by`` on (confidence,
position), never a sequential loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from ..functions.util import at as _at
from ..functions.util import let

from ..functions import names as N
from ..session import materialize, stored
from . import corpus as K

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
VERB_OBJECT = r"(?i)^(Create|Delete|Update|Add|Remove|Save|Submit|Start|Stop|Test|Select|Toggle|Enable|Disable|Upgrade|Invite)(.+)$"
OBJECT_VERB = r"(?i)^(.*?)(Create|Delete|Update|Add|Remove|Save|Submit|Start|Stop|Test|Select|Toggle|Enable|Disable|Change|Upgrade|Invite)$"
UI_HINT_VERB = r"(?i)^(Save|Create|Update|Add|Remove|Delete|Start|Stop|Select|Toggle|Enable|Disable|Submit|Upgrade|Invite|Cancel|Close|Open|Change)\s+(.+)$"
ROUTE_FN = r"(?i)^(GET|POST|PUT|PATCH|DELETE)\s+(.+)$"
GENERIC_CRUD_FN = r"(?i)^([a-z][a-z0-9_]*)\.(create|insert|update|delete|upsert|remove|destroy|save)$"
PRISMA_FN = r"(?i)prisma\.(\w+)\.(create|update|delete|upsert)"
SUPABASE_FN = r"""(?i)from\(['"](\w+)['"]\)\.(insert|update|delete)"""
DRIZZLE_FN = r"(?i)db\.(insert|update|delete)\((\w+)\)"
ROUTE_VERBS = {"POST": "created", "PUT": "updated", "PATCH": "updated", "DELETE": "deleted"}
OPERATIONAL_UTIL_NAMES = ["errhandler", "errorhandler", "catchhandler", "apicall", "retryhandler",
                          "jobhandler", "withretry", "retry", "backoff", "processjob"]
ENTITY_SKIP = ["retry", "error", "catch", "job", "handler", "util", "helper"]
EDIT_LIKE = r"_(updated|saved|added|removed|changed|toggled|enabled|disabled)$"
CREATE_DELETE = r"_(created|deleted)$"
CREATION_VERBS = ["created", "added", "inserted"]
DELETION_VERBS = ["deleted", "removed", "destroyed"]

BUSINESS_ENTITIES = [
    "user", "project", "order", "payment", "invoice", "team", "comment",
    "workspace", "organization", "member", "subscription", "issue", "task",
    "ticket", "document", "report", "dashboard", "chart", "message", "thread",
    "post", "article", "video", "image", "workflow", "pipeline", "campaign",
    "customer", "account", "lead", "contact", "deal", "opportunity", "product",
    "item", "cart", "checkout", "transaction", "link", "form", "survey",
    "response", "notification", "alert", "plan", "tier", "feature",
    "integration", "connection", "domain", "environment", "deployment",
    "build", "release", "version", "review", "approval", "policy", "rule",
    "automation", "schedule", "export", "import", "invite", "setting",
    "upload", "download", "file", "folder", "channel", "conversation", "room",
    "event", "session", "booking", "appointment", "reservation", "listing",
    "profile", "avatar", "asset", "collection", "playlist", "package",
]
INFRASTRUCTURE_ENTITIES = [
    "token", "cookie", "query", "param", "header",
    "listener", "observer", "handler", "middleware", "interceptor",
    "timer", "interval", "timeout", "socket",
    "log", "metric", "span", "trace",
    "stream", "buffer", "lock", "mutex", "semaphore", "cache",
    "ref", "effect", "provider", "store", "state",
    "map", "set", "array", "object",
]
# File relevance, first matching rule wins (patterns on the lower-cased path).
FILE_RELEVANCE = [
    (r"/(scripts?|migrations?|seeds?|e2e|cypress|playwright|__tests__|__mocks__|fixtures|test.utils|\.test\.|\.spec\.)/", 0.0),
    (r"/(cron|jobs?|workers?|queues?|tasks?|scheduler)/", 0.0),
    (r"/(components?|pages?|views?|screens?|features?|ui)/", 0.2),
    (r"/app/.*\.(tsx|jsx)$", 0.2),
    (r"/(api|routes?)/", 0.18),
    (r"/hooks?/", 0.15),
    (r"/actions?/", 0.15),
    (r"/lib/.*actions?", 0.12),
    (r"/(lib|utils?|helpers?|services?)/", 0.08),
    (r"/webhooks?/", 0.02),
]
RELEVANCE_MIN = 0.25
PRIORITY_BY_RELEVANCE = [(0.7, "critical"), (0.55, "high"), (0.4, "medium")]


def _rx(c: Column, p: str, g: int) -> Column:
    return F.nullif(F.regexp_extract(c, p, g), F.lit(""))


def _clean_operational(fn: Column) -> Column:
    snaked = N.snake_from_camel(F.regexp_replace(fn, r"(?i)^(handle|on)", ""))
    return F.when((F.length(snaked) >= 3) & ~F.regexp_replace(snaked, "_", "").isin(*OPERATIONAL_UTIL_NAMES), snaked)


def _pick_entity(ents: Column) -> Column:
    ok = F.filter(F.transform(F.coalesce(ents, F.array().cast("array<string>")), lambda e: F.lower(e)),
                  lambda e: (F.length(e) >= 3) & ~e.isin(*ENTITY_SKIP))
    return _at(ok, 1)


def _route_name(fn: Column) -> Column:
    meth = F.upper(_rx(fn, ROUTE_FN, 1))
    path = F.regexp_extract(fn, ROUTE_FN, 2)
    segs = F.filter(F.transform(F.split(path, "/"), lambda s: F.trim(s)),
                    lambda s: (s != "") & ~s.startswith(":") & ~s.rlike(r"(?i)^v\d+$") & (F.lower(s) != "api"))
    last = _at(segs, -1)
    res = F.regexp_replace(F.regexp_replace(last, "-", "_"), "s$", "")
    verb = _at(F.create_map(*[F.lit(x) for kv in ROUTE_VERBS.items() for x in kv]), meth)
    return F.when(meth.isNotNull() & last.isNotNull() & verb.isNotNull(), F.concat(res, F.lit("_"), verb))


def _mutation_name(fn: Column) -> Column:
    ge = _rx(fn, GENERIC_CRUD_FN, 1)
    gv = F.lower(F.regexp_extract(fn, GENERIC_CRUD_FN, 2))
    gv = F.when(gv == "insert", "create").when(gv.isin("destroy", "remove"), "delete").otherwise(gv)
    generic = F.concat(F.regexp_replace(ge, "s$", ""), F.lit("_"), N.past_tense(gv))
    pe = _rx(fn, PRISMA_FN, 1)
    prisma = F.concat(N.snake_from_camel(pe), F.lit("_"), N.past_tense(F.regexp_extract(fn, PRISMA_FN, 2)))
    se = _rx(fn, SUPABASE_FN, 1)
    sv = F.regexp_extract(fn, SUPABASE_FN, 2)
    supa = F.concat(F.regexp_replace(F.regexp_replace(se, "s$", ""), "-", "_"), F.lit("_"),
                    N.past_tense(F.when(sv == "insert", "create").otherwise(sv)))
    de = _rx(fn, DRIZZLE_FN, 2)
    dv = F.regexp_extract(fn, DRIZZLE_FN, 1)
    driz = F.concat(F.regexp_replace(de, "s$", ""), F.lit("_"), N.past_tense(F.when(dv == "insert", "create").otherwise(dv)))
    return (F.when(ge.isNotNull(), generic).when(pe.isNotNull(), prisma)
            .when(se.isNotNull(), supa).when(de.isNotNull(), driz))


def _ui_hint_name(hint: Column) -> Column:
    h = F.trim(F.coalesce(hint, F.lit("")))
    verb = _rx(h, UI_HINT_VERB, 1)
    obj_text = F.trim(F.regexp_replace(F.regexp_extract(h, UI_HINT_VERB, 2), r"\s+", " "))
    words = F.filter(F.transform(F.split(obj_text, " "), lambda w: F.trim(F.regexp_replace(w, "[^a-zA-Z0-9]", ""))),
                     lambda w: w != "")
    obj = N.snake_from_words(words)
    cand = let(F.concat(obj, F.lit("_"), N.past_tense(verb)), lambda c: F.when(N.is_valid_event_name(c), c))
    return F.when(verb.isNotNull() & (F.size(words) > 0) & (obj != ""), cand)


def _handler_name(fn: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(fn, "^handle", ""), "^on", ""), "^use", "")
    vo_v, vo_o = _rx(name, VERB_OBJECT, 1), F.regexp_extract(name, VERB_OBJECT, 2)
    ov_o, ov_v = _rx(name, OBJECT_VERB, 1), F.regexp_extract(name, OBJECT_VERB, 2)
    return (F.when(name == "", F.lit(None).cast("string"))
            .when(vo_v.isNotNull(), F.concat(N.snake_from_camel(vo_o), F.lit("_"), N.past_tense(vo_v)))
            .when(ov_o.isNotNull(), F.concat(N.snake_from_camel(ov_o), F.lit("_"), N.past_tense(ov_v))))


def guess_event_name(itype: Column, fn: Column, hint: Column, entities: Column) -> Column:
    """F12 + F13: event name of an interaction (null when none can be inferred)."""
    ent = _pick_entity(entities)
    op = _clean_operational(fn)
    err = F.coalesce(F.when(fn.isNotNull() & ~fn.isin("errorHandler", "catchHandler") & op.isNotNull(),
                            F.concat(op, F.lit("_failed"))), F.concat(ent, F.lit("_failed")))
    api = F.coalesce(F.concat(ent, F.lit("_fetched")),
                     F.when(fn.isNotNull() & (fn != "apiCall") & op.isNotNull(), F.concat(op, F.lit("_fetched"))))
    retry = F.coalesce(F.concat(ent, F.lit("_retried")),
                       F.when(fn.isNotNull() & (fn != "retryHandler") & op.isNotNull(), F.concat(op, F.lit("_retried"))))
    job_s = F.lower(F.regexp_replace(F.regexp_replace(fn, "-", "_"), r"\s+", "_"))
    job = F.coalesce(F.when(fn.isNotNull() & (fn != "jobHandler") & (F.length(job_s) >= 3)
                            & ~F.regexp_replace(job_s, "_", "").isin(*OPERATIONAL_UTIL_NAMES),
                            F.concat(job_s, F.lit("_processed"))), F.concat(ent, F.lit("_processed")))
    return (F.when(itype == "error_boundary", err).when(itype == "api_call", api)
            .when(itype == "retry_logic", retry).when(itype == "job_handler", job)
            .when(itype == "route_handler", _route_name(fn))
            .when(itype == "mutation", _mutation_name(fn))
            .otherwise(F.coalesce(_ui_hint_name(hint), _handler_name(fn))))


def _cut(df: DataFrame, links: DataFrame | None) -> DataFrame:
    """Events and links both read every pass, so with links a pass is written once."""
    return df if links is None else materialize(df)


def _follow(links: DataFrame | None, moves: DataFrame) -> DataFrame | None:
    """Links (repo, pos of the event, source) after events moved from ``pos`` to ``_to``: a row per source, joined."""
    if links is None:
        return None
    return links.join(moves.select("repo", "pos", "_to"), ["repo", "pos"]).withColumn("pos", F.col("_to")).drop("_to")


def _dedupe(ev: DataFrame, key: Column, links: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """One merge pass: per key the highest confidence wins (earliest on ties);
    the key keeps the position of its first member. The union of the source
    interactions is a table of its own, ``links``: no list is collected."""
    keyed = _cut(ev.withColumn("_key", key), links)
    g = keyed.groupBy("repo", "_key").agg(
        F.min_by(F.struct(*[c for c in ev.columns if c not in ("n_sources", "pos", "repo")]),
                 F.struct(-F.col("confidence"), F.col("pos"))).alias("w"),
        F.min("pos").alias("pos"),
        F.sum("n_sources").alias("n_sources"))
    g = _cut(g, links)
    moves = keyed.select("repo", "_key", "pos").join(g.select("repo", "_key", F.col("pos").alias("_to")), ["repo", "_key"])
    return g.select("repo", "w.*", "pos", "n_sources"), _follow(links, moves)


def dedupe_events(ev: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A8 (by lower-cased name) then A9 (by object + canonical verb)."""
    p1, links = _dedupe(ev, F.lower("name"), links)
    parts = F.split("name", "_")
    verb = _at(parts, -1)
    obj = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")
    canon = F.when(verb.isin(*CREATION_VERBS), "created").when(verb.isin(*DELETION_VERBS), "deleted").otherwise(verb)
    return _dedupe(p1, F.concat(obj, F.lit(":"), canon), links)


def group_business_edits(ev: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A10: two or more edit-like events on the same (file, object) become one
    ``<object>_edited`` event (high priority, includes the names)."""
    obj = N.object_of_synth(F.col("name"))
    editable = N.is_valid_event_name(F.col("name")) & ~F.col("name").rlike(CREATE_DELETE) & F.col("name").rlike(EDIT_LIKE)
    x = ev.withColumn("_obj", obj).withColumn("_edit", editable)
    w = Window.partitionBy("repo", "path", "_obj")
    x = x.withColumn("_n", F.sum(F.col("_edit").cast("int")).over(w))
    grouped_name = F.concat("_obj", F.lit("_edited"))
    to_group = F.col("_edit") & (F.col("_n") > 1) & N.is_valid_event_name(grouped_name)
    if links is not None:
        first = F.min(F.when(to_group, F.col("pos"))).over(w)
        x = materialize(x.withColumn("_to", F.when(to_group, first).otherwise(F.col("pos"))))
        links = _follow(links, x)
        x = x.drop("_to")
    passthrough = x.where(~to_group).drop("_obj", "_edit", "_n")
    g = (x.where(to_group).groupBy("repo", "path", "_obj").agg(
        F.min_by(F.struct("line_no", "context", "confidence", "hint"),
                 F.struct(-F.col("confidence"), F.col("pos"))).alias("best"),
        F.sum("n_sources").alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set("name")), ",").alias("includes"),
        F.min("pos").alias("pos")))
    grouped = g.select("repo", F.concat("_obj", F.lit("_edited")).alias("name"),
                       F.concat(F.lit("User edited "), "_obj", F.lit(" (grouped changes)")).alias("description"),
                       F.lit("high").alias("priority"), F.lit("action").alias("signal_type"),
                       "path", "best.line_no", "best.context", "best.confidence", "best.hint", "includes", "pos", "n_sources")
    return dedupe_events(passthrough.unionByName(grouped.select(*passthrough.columns)), links)


def _named_events(interactions: DataFrame) -> DataFrame:
    # through an array of one, so the name is a column of its own: its long expression would else stand in every use of it
    name = guess_event_name(F.col("type"), F.col("function_name"), F.col("ui_hint"), F.col("entities"))
    x = interactions.select("*", F.explode(F.array(name)).alias("name"))
    x = x.where(F.col("name").isNotNull() & N.is_valid_event_name(F.col("name")))
    return x.select("repo", "name", "function_name",
                  F.concat(F.col("type"), F.lit(": "), F.col("function_name")).alias("description"),
                  N.priority_heuristic(F.col("name"), F.col("type")).alias("priority"),
                  N.signal_type(F.col("type")).alias("signal_type"),
                  "path", "line_no", "context", "confidence", F.col("trigger").alias("hint"),
                  F.lit(None).cast("string").alias("includes"),
                  F.struct("path", "first_detector", "first_match_no").alias("pos"),
                  F.lit(1).cast("long").alias("n_sources"))


def synthesize(interactions: DataFrame, granular: bool = False) -> DataFrame:
    """Fast (rule-based) synthesis of business events from interactions."""
    d, _ = dedupe_events(_named_events(interactions).drop("function_name"))
    return d if granular else group_business_edits(stored(d))[0]  # written: a row per name, which the grouping reads twice


def synthesize_with_sources(interactions: DataFrame, granular: bool = False) -> tuple[DataFrame, DataFrame]:
    """The events and their sources: (repo, pos of the event, source_path, source_function), the last two naming one
    interaction of the repo."""
    ev = materialize(_named_events(interactions))
    links = ev.select("repo", "pos", F.col("path").alias("source_path"), F.col("function_name").alias("source_function"))
    d, links = dedupe_events(ev.drop("function_name"), links)
    return (d, links) if granular else group_business_edits(d, links)


def file_relevance(path: Column) -> Column:
    f = F.lower(path)
    expr = None
    for pat, score in FILE_RELEVANCE[:6]:
        cond = f.rlike(pat) if pat != r"/hooks?/" else (f.rlike(pat) | path.rlike(r"/use[A-Z]"))
        expr = F.when(cond, score) if expr is None else expr.when(cond, score)
    for pat, score in FILE_RELEVANCE[6:]:
        expr = expr.when(f.rlike(pat), score)
    return expr.otherwise(0.1)


def entity_quality(entity: Column) -> Column:
    parts = F.filter(F.split(entity, "_"), lambda p: p != "")
    bare = F.lower(F.regexp_replace(entity, "_", ""))
    all_infra = (F.size(parts) > 0) & F.forall(parts, lambda p: F.lower(p).isin(*INFRASTRUCTURE_ENTITIES))
    any_biz = F.exists(parts, lambda p: F.lower(p).isin(*BUSINESS_ENTITIES))
    return (F.when(F.coalesce(entity, F.lit("")) == "", 0.0).when(F.length(bare) <= 2, 0.0)
            .when(all_infra, 0.02).when(any_biz, 0.15).when(entity.contains("_"), 0.1)
            .when(F.length(bare) >= 5, 0.1).when(F.length(bare) >= 3, 0.08).otherwise(0.05))


# Fixed value: a call of an HTTP client method with a literal address.
HTTP_CALL = r"""\b(post|put|patch|delete)\s*\(\s*['"`]"""


def interaction_type_score(hint: Column, path: Column) -> Column:
    h = F.coalesce(hint, F.lit(""))
    return (F.when(h.rlike(r"(?i)\bonSubmit\b"), 0.15)
            .when(h.rlike(r"(?i)\bonClick\b") & h.rlike(r"handle[A-Z]"), 0.12)
            .when(h.rlike(r"\buseMutation\b"), 0.12)
            .when(h.rlike(r"\bexport\s+function\s+(POST|PUT|PATCH|DELETE)\b") | h.rlike(HTTP_CALL), 0.1)
            .when(h.rlike(r"\.(create|insert|update|delete|upsert|remove)\s*\("),
                  F.when(path.rlike(r"(?i)/(lib|utils?|helpers?)/"), 0.08).otherwise(0.1))
            .when(h.rlike(r"(?i)\bonClick\b"), 0.05)
            .when(h.rlike(r"(?i)\bon(Change|Toggle)\b"), 0.03)
            .otherwise(0.05))


def xref_score(n: Column) -> Column:
    return F.when(n >= 10, 0.2).when(n >= 5, 0.15).when(n >= 2, 0.1).when(n >= 1, 0.03).otherwise(0.0)


def _trigrams(c: Column) -> Column:
    """The distinct pieces of three characters of a text, empty for a shorter one."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))) \
        .otherwise(F.array().cast("array<string>"))


def schema_candidates(events: DataFrame, objects: DataFrame) -> DataFrame:
    """(repo, entity, _en, _on, _oo) for every entity and object of a repo that are equal, or one of which holds the other
    (three characters or more; compared in lower case without underscores).

    A text that holds another holds its first three characters: the holders' pieces meet the first piece of the held in an
    equi-join, and only those pairs are compared."""
    e = events.select("repo", "entity").distinct().withColumn("_en", F.lower(F.regexp_replace("entity", "_", ""))).where("_en IS NOT NULL")
    o = objects.select(F.col("repo").alias("_or"), F.lower(F.regexp_replace("name", "_", "")).alias("_on"), F.col("ord").alias("_oo"))
    out = ["repo", "entity", "_en", "_on", "_oo"]
    equal = e.join(o, (F.col("repo") == F.col("_or")) & (F.col("_en") == F.col("_on"))).select(*out)
    held_o = o.where(F.length("_on") >= 3).withColumn("_g", F.substring("_on", 1, 3))
    held_e = e.where(F.length("_en") >= 3).withColumn("_g", F.substring("_en", 1, 3))
    holds_o = e.withColumn("_h", F.explode(_trigrams(F.col("_en")))).join(
        held_o, (F.col("repo") == F.col("_or")) & (F.col("_h") == F.col("_g")) & F.col("_en").contains(F.col("_on"))).select(*out)
    holds_e = o.withColumn("_h", F.explode(_trigrams(F.col("_on")))).join(
        held_e, (F.col("repo") == F.col("_or")) & (F.col("_h") == F.col("_g")) & F.col("_on").contains(F.col("_en"))).select(*out)
    return equal.unionByName(holds_o).unionByName(holds_e)


def score(events: DataFrame, objects: DataFrame, xref: DataFrame) -> DataFrame:
    """relevance = schema .3 + file .2 + cross reference .2 + entity
    quality .15 + interaction type .15, capped at 1.

    Schema match takes the first object (in object order) that matches the
    entity exactly (.3) or partially (.2), as the reference does."""
    ev = events.withColumn("entity", N.entity_of_scored(F.col("name")))
    cand = schema_candidates(ev, objects)
    sm = cand.groupBy("repo", "entity").agg(
        F.min_by(F.when(F.col("_on") == F.col("_en"), 0.3).otherwise(0.2), F.col("_oo")).alias("schema_match"))
    x = (ev.join(sm, ["repo", "entity"], "left")
         .join(xref.select("repo", "entity", "n_files"), ["repo", "entity"], "left"))
    x = (x.withColumn("schema_match", F.coalesce("schema_match", F.lit(0.0)))
         .withColumn("file_relevance", file_relevance(F.coalesce(F.col("path"), F.lit(""))))
         .withColumn("cross_reference", F.when(F.coalesce(F.col("entity"), F.lit("")) == "", 0.03)
                     .otherwise(xref_score(F.coalesce("n_files", F.lit(0)))))
         .withColumn("entity_quality", entity_quality(F.col("entity")))
         .withColumn("interaction_type", interaction_type_score(F.col("hint"), F.coalesce(F.col("path"), F.lit("")))))
    total = (F.col("schema_match") + F.col("file_relevance") + F.col("cross_reference")
             + F.col("entity_quality") + F.col("interaction_type"))
    return x.withColumn("relevance", F.round(F.least(F.lit(1.0), total), 6)).drop("n_files")


def gaps(scored: DataFrame, existing_names: DataFrame) -> DataFrame:
    """A11 + P8 + J5: best-scored event per lower-cased name, relevance >=
    0.25, priority from relevance, minus names already tracked."""
    best = scored.groupBy("repo", F.lower("name").alias("_k")).agg(
        F.min_by(F.struct(*scored.columns), F.struct(-F.col("relevance"), F.col("pos"))).alias("w"))
    x = best.select("w.*").where(F.col("relevance") >= RELEVANCE_MIN)
    pr = F.when(F.col("relevance") >= 0.7, "critical").when(F.col("relevance") >= 0.55, "high") \
        .when(F.col("relevance") >= 0.4, "medium").otherwise("low")
    x = x.withColumn("priority", pr)
    ex = existing_names.select("repo", F.lower("name").alias("_k")).distinct()
    return x.withColumn("_k", F.lower("name")).join(ex, ["repo", "_k"], "left_anti").drop("_k")


def coverage_scan(existing: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """A4(b): tracked / (tracked + gaps) per repo."""
    t = existing.groupBy("repo").agg(F.count(F.lit(1)).alias("tracked"))
    g = gap_rows.groupBy("repo").agg(F.count(F.lit(1)).alias("missing"))
    j = t.join(g, "repo", "full_outer").select(
        "repo", F.coalesce("tracked", F.lit(0)).alias("tracked"), F.coalesce("missing", F.lit(0)).alias("missing"))
    tot = F.col("tracked") + F.col("missing")
    return j.withColumn("percentage", F.when(tot > 0, F.round(F.col("tracked").cast("double") / tot * 100))
                        .otherwise(0).cast("bigint"))


def gaps_topk(gap_rows: DataFrame, k: int = 20) -> DataFrame:
    """Gaps in (priority, discovery) order, first ``k`` shown, with the
    number not shown."""
    w = Window.partitionBy("repo").orderBy(N.priority_rank("priority"), "pos")
    x = gap_rows.withColumn("rank", F.row_number().over(w)).withColumn(
        "n_gaps", F.count(F.lit(1)).over(Window.partitionBy("repo")))
    return x.where(F.col("rank") <= k).withColumn("n_more", F.greatest(F.col("n_gaps") - k, F.lit(0)))


def interaction_batches(interactions: DataFrame, size: int = 30) -> DataFrame:
    """Fixed-size batches of interactions in discovery order, with the
    ``file::entity`` group hint of each interaction.

    The running index is a per-file rank plus the number of interactions in
    earlier files (a window over the per-file count table), so no window
    ever spans all interactions of a repo."""
    per_file = interactions.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("_n"))
    before = per_file.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy("repo").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("repo", "path").orderBy("first_detector", "first_match_no")
    base = _at(F.split("path", r"[\\/]"), -1)
    ent = F.coalesce(_at("entities", 1), N.object_from_path(F.col("path")), F.lit("unknown"))
    x = interactions.withColumn("_r", F.row_number().over(w) - 1).join(before.select("repo", "path", "_off"),
                                                                      ["repo", "path"])
    idx = (F.col("_off") + F.col("_r")).cast("long")
    return x.select("repo", F.floor(idx / size).cast("int").alias("batch"), idx.alias("index"),
                    "path", "function_name", F.concat(base, F.lit("::"), ent).alias("group_hint"))


PRIORITIES = ["critical", "high", "medium", "low"]


def merge_proposals(interactions: DataFrame, proposals: DataFrame, batch_size: int = 30,
                    granular: bool = False) -> DataFrame:
    """Merge externally proposed events with rule-based fallback names.

    ``interactions`` carry their discovery ``index`` (W8); ``proposals(repo,
    batch, ord, name, description, priority, includes, source_ids, skipped)``
    hold one row per proposed event (``skipped`` repeats the batch's skipped
    indexes). A proposal keeps only valid names and source ids inside its
    batch (first occurrences); its location is the source with the highest
    confidence (first on ties) and its signal type that of its first source.
    Interactions neither used nor skipped get the rule-based name. The union
    is deduplicated and grouped like ``synthesize``."""
    it = interactions.select("repo", "index", "type", "function_name", "path", "line_no", "context", "confidence",
                             F.col("trigger").alias("hint"), "entities", "ui_hint")
    p = proposals.where(N.is_valid_event_name(F.col("name")))
    lo = F.col("batch") * batch_size
    src = (p.select("repo", "batch", "ord", F.posexplode("source_ids").alias("_sp", "index"))
           .where((F.col("index") >= lo) & (F.col("index") < lo + batch_size)))
    src = src.groupBy("repo", "batch", "ord", "index").agg(F.min("_sp").alias("_sp"))
    js = src.join(it, ["repo", "index"])
    best = js.groupBy("repo", "batch", "ord").agg(
        F.min_by(F.struct("path", "line_no", "context", "confidence", "hint"),
                 F.struct(-F.col("confidence"), F.col("_sp"))).alias("loc"),
        F.min_by("type", "_sp").alias("_type"), F.count(F.lit(1)).alias("n_sources"))
    pe = p.join(best, ["repo", "batch", "ord"]).select(
        "repo", "name",
        F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.col("description"))
        .otherwise(F.concat(F.lit("Business interaction: "), "name")).alias("description"),
        F.when(F.col("priority").isin(*PRIORITIES), F.col("priority")).otherwise(F.lit("medium")).alias("priority"),
        N.signal_type(F.col("_type")).alias("signal_type"),
        "loc.path", "loc.line_no", "loc.context", "loc.confidence", "loc.hint",
        F.array_join("includes", ",").alias("includes"),
        F.struct(F.lit(0).alias("src"), F.col("batch").cast("long").alias("a"), F.col("ord").cast("long").alias("b")).alias("pos"),
        F.col("n_sources").cast("long").alias("n_sources"))
    covered = (src.select("repo", "index")
               .unionByName(p.select("repo", F.explode("skipped").alias("index")))).distinct()
    un = it.join(covered, ["repo", "index"], "left_anti")
    un = un.withColumn("name", guess_event_name(F.col("type"), F.col("function_name"), F.col("ui_hint"), F.col("entities")))
    ue = un.where(F.col("name").isNotNull() & N.is_valid_event_name(F.col("name"))).select(
        "repo", "name", F.concat(F.col("type"), F.lit(": "), F.col("function_name")).alias("description"),
        N.priority_heuristic(F.col("name"), F.col("type")).alias("priority"), N.signal_type(F.col("type")).alias("signal_type"),
        "path", "line_no", "context", "confidence", "hint", F.lit(None).cast("string").alias("includes"),
        F.struct(F.lit(1).alias("src"), F.col("index").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("pos"),
        F.lit(1).cast("long").alias("n_sources"))
    d, _ = dedupe_events(pe.unionByName(ue))
    return d if granular else group_business_edits(d)[0]
