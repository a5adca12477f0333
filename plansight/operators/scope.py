"""Scope variables at a line (C12) and property inference for events.

For each target line: the enclosing function start is the nearest line at or
above it that opens a function block (a forward fill per file); parameters
come from that line's first parenthesised list, split at top-level commas by
an ``aggregate`` fold over its characters; declarations come from the lines
between the start and the target whose brace depth does not exceed the
target's, joined through an exploded line range (bounded by the function's
length). Everything is per file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.util import LATER
from ..functions.util import at as _at
from .corpus import brace_depth

# Function-start, declaration and parameter patterns.
FUNC_START_DECL = r"\bfunction\s+\w+\s*\("
FUNC_START_ARROW = r"\bconst\s+\w+\s*=\s*(?:async\s*)?\(.*\)\s*=>"
FUNC_START_BLOCK = r"\)\s*=>\s*\{"
PARAMS = r"\(([\s\S]*?)\)"
DESTRUCTURED_PARAM = r"^\{\s*([^}]+)\s*\}\s*(?::\s*([^=]+))?"
USE_STATE = r"\bconst\s*\[\s*([A-Za-z_][A-Za-z0-9_]*)\s*,\s*set[A-Za-z0-9_]+\s*\]\s*=\s*useState(?:<([^>]+)>)?"
USE_CONTEXT_D = r"\bconst\s*\{\s*([^}]+)\s*\}\s*=\s*useContext\s*\("
USE_CONTEXT = r"\bconst\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*useContext\s*\("
USE_QUERY_D = r"\bconst\s*\{\s*([^}]+)\s*\}\s*=\s*use(Query|Mutation)\s*[(<]"
USE_QUERY = r"\bconst\s+([A-Za-z_][A-Za-z0-9_]*)\s*=\s*useQuery\s*[(<]"
USE_PARAMS = r"\bconst\s*\{\s*([^}]+)\s*\}\s*=\s*useParams\s*(?:<[^>]+>)?\s*\("
DESTRUCTURING = r"\bconst\s*\{\s*([^}]+)\s*\}\s*=\s*([A-Za-z_][A-Za-z0-9_\.]*)"
CONST_DECL = r"\b(?:const|let|var)\s+([A-Za-z_][A-Za-z0-9_]*)\b"
USER_VARS = ["user", "currentUser", "session"]

VAR = "struct<name:string,type:string,source:string>"


def function_start(text: Column) -> Column:
    return ((text.rlike(FUNC_START_DECL) & text.contains("{"))
            | (text.rlike(FUNC_START_ARROW) & text.contains("{"))
            | text.rlike(FUNC_START_BLOCK))


def clean_type_name(t: Column) -> Column:
    x = F.regexp_replace(F.trim(t), r"[\s=].*$", "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\|.*$", ""), r"&.*$", ""), r"\[\]$", "")
    return F.trim(x)


def split_top_level_commas(s: Column) -> Column:
    """Split at commas outside (), <> and {} (depths never below 0); a
    trailing blank piece is dropped."""
    init = F.struct(F.lit(0).alias("p"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("buf"),
                    F.array().cast("array<string>").alias("parts"))

    def step(acc, ch):
        p = F.when(ch == "(", acc["p"] + 1).when(ch == ")", F.greatest(acc["p"] - 1, F.lit(0))).otherwise(acc["p"])
        a = F.when(ch == "<", acc["a"] + 1).when(ch == ">", F.greatest(acc["a"] - 1, F.lit(0))).otherwise(acc["a"])
        b = F.when(ch == "{", acc["b"] + 1).when(ch == "}", F.greatest(acc["b"] - 1, F.lit(0))).otherwise(acc["b"])
        cut = (ch == ",") & (p == 0) & (a == 0) & (b == 0)
        return F.struct(p.alias("p"), a.alias("a"), b.alias("b"),
                        F.when(cut, F.lit("")).otherwise(F.concat(acc["buf"], ch)).alias("buf"),
                        F.when(cut, F.concat(acc["parts"], F.array(acc["buf"]))).otherwise(acc["parts"]).alias("parts"))

    return F.aggregate(F.split(s, ""), init, step,
                       lambda acc: F.when(F.trim(acc["buf"]) != "", F.concat(acc["parts"], F.array(acc["buf"])))
                       .otherwise(acc["parts"]))


def names_of(group: Column) -> Column:
    """``a, b: c`` -> [a, c] (a rename keeps the new name)."""
    items = F.filter(F.transform(F.split(group, ","), lambda s: F.trim(s)), lambda s: s != "")

    def pick(s):
        parts = F.transform(F.split(s, ":"), lambda x: F.trim(x))
        second = _at(parts, 2)
        return F.when(F.coalesce(second, F.lit("")) != "", second).otherwise(_at(parts, 1))
    return F.filter(F.transform(items, pick), lambda s: F.coalesce(s, F.lit("")) != "")


def _vars(names: Column, source, typ: Column | None = None) -> Column:
    src = source if isinstance(source, Column) else F.lit(source)
    return F.transform(names, lambda n: F.struct(n.alias("name"), (typ if typ is not None else F.lit(None).cast("string")).alias("type"),
                                                 src.alias("source")))


def _empty() -> Column:
    return F.array().cast(f"array<{VAR}>")


def line_declarations(text: Column) -> Column:
    """Variables declared on one line, in extractor order."""
    def rx(p, g=1):
        return F.regexp_extract(text, p, g)
    us = F.when(text.rlike(USE_STATE), F.array(F.struct(
        rx(USE_STATE).alias("name"),
        F.when(rx(USE_STATE, 2) != "", clean_type_name(rx(USE_STATE, 2))).alias("type"),
        F.lit("useState").alias("source")))).otherwise(_empty())
    uc = (F.when(text.rlike(USE_CONTEXT_D), _vars(names_of(rx(USE_CONTEXT_D)), "useContext"))
          .when(text.rlike(USE_CONTEXT), _vars(F.array(rx(USE_CONTEXT)), "useContext")).otherwise(_empty()))
    qsrc = F.when(rx(USE_QUERY_D, 2) == "Mutation", "useMutation").otherwise("useQuery")
    uq = (F.when(text.rlike(USE_QUERY_D), _vars(names_of(rx(USE_QUERY_D)), qsrc))
          .when(text.rlike(USE_QUERY), _vars(F.array(rx(USE_QUERY)), "useQuery")).otherwise(_empty()))
    up = F.when(text.rlike(USE_PARAMS), _vars(names_of(rx(USE_PARAMS)), "useParams")).otherwise(_empty())
    de = F.when(text.rlike(DESTRUCTURING), _vars(names_of(rx(DESTRUCTURING)), "destructured")).otherwise(_empty())
    co = F.when(text.rlike(CONST_DECL), _vars(F.array(rx(CONST_DECL)), "const")).otherwise(_empty())
    return F.concat(us, uc, uq, up, de, co)


def parameters(signature: Column) -> Column:
    """Parameters of the first parenthesised list of a function start line."""
    raw = F.trim(F.regexp_extract(signature, PARAMS, 1))
    params = F.when(signature.rlike(PARAMS) & (raw != ""), split_top_level_commas(raw)).otherwise(F.array().cast("array<string>"))

    def one(p):
        p = F.trim(p)
        d = F.regexp_extract(p, DESTRUCTURED_PARAM, 1)
        is_d = p.rlike(DESTRUCTURED_PARAM)
        parts = F.split(p, ":")
        name = F.trim(_at(F.split(F.coalesce(_at(parts, 1), F.lit("")), "="), 1))
        typ_raw = _at(parts, 2)
        typ = F.when(F.coalesce(typ_raw, F.lit("")) != "", clean_type_name(typ_raw))
        plain = F.when((p != "") & (name != ""), F.array(F.struct(name.alias("name"), typ.alias("type"),
                                                                  F.lit("parameter").alias("source"))))
        return F.when(p == "", _empty()).when(is_d, _vars(names_of(d), "parameter")).otherwise(F.coalesce(plain, _empty()))
    return F.flatten(F.transform(params, one))


def scope_variables(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Variables in scope at each target (repo, path, line_no)."""
    d = brace_depth(lines)
    w = Window.partitionBy("repo", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    info = d.withColumn("_start", F.last(F.when(function_start(F.col("text")), F.col("line_no")), ignorenulls=True).over(w))
    t = targets.select("repo", "path", "line_no").distinct().join(
        info.select("repo", "path", "line_no", "_start", F.col("depth").alias("_tdepth")).hint("merge"), ["repo", "path", "line_no"])
    sig = lines.select("repo", "path", F.col("line_no").alias("_start"), F.col("text").alias("_sig"))
    tp = t.join(sig, ["repo", "path", "_start"], "left")
    params = tp.where(F.col("_start").isNotNull()).select(
        "repo", "path", "line_no", F.posexplode(parameters(F.col("_sig"))).alias("_pos", "v"),
        F.col("_start").alias("decl_line")).withColumn("_pos", F.col("_pos").cast("long") - LATER)
    # every line lies in one segment, from a function start to the next, and a target sees only lines of its own:
    # declarations meet targets by an equi-join on the segment, without a row per line in between
    segment = F.coalesce("_start", F.lit(0)).alias("_segment")
    declared = info.select("repo", "path", segment, F.col("line_no").alias("decl_line"), F.col("depth").alias("_d"),
                           line_declarations(F.col("text")).alias("_vars")).where(F.size("_vars") > 0)
    decls = t.select("repo", "path", "line_no", segment, "_tdepth").join(declared.hint("merge"), ["repo", "path", "_segment"]).where(
        (F.col("decl_line") < F.col("line_no")) & (F.col("_d") <= F.col("_tdepth"))).select(
        "repo", "path", "line_no", F.posexplode("_vars").alias("_pos", "v"), "decl_line")
    allv = params.unionByName(decls).select("repo", "path", "line_no", "decl_line", "_pos", "v.*")
    typed = (F.coalesce(F.col("type"), F.lit("")) != "")
    key = Window.partitionBy("repo", "path", "line_no", "name")
    allv = (allv.withColumn("_maxl", F.max("decl_line").over(key))
            .withColumn("_first", F.min(F.struct("decl_line", "_pos")).over(key)))
    best = Window.partitionBy("repo", "path", "line_no", "name").orderBy(
        F.when(F.col("decl_line") == F.col("_maxl"), 0).otherwise(1), F.when(typed, 0).otherwise(1), "_pos")
    out = allv.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    # ``ord``: position of the name's first occurrence (the order scope lists keep)
    ordw = Window.partitionBy("repo", "path", "line_no").orderBy("_first.decl_line", "_first._pos")
    return out.withColumn("ord", F.row_number().over(ordw)).select(
        "repo", "path", "line_no", "ord", "name", F.when(typed, F.col("type")).alias("type"), "source",
        F.col("name").alias("access_path"), "decl_line")


def infer_properties(events: DataFrame, scope: DataFrame, rel: DataFrame, paths: DataFrame,
                     lifecycles: DataFrame | None = None, sequences: DataFrame | None = None) -> DataFrame:
    """Properties of each event (repo, name, path, line_no): ``<object>_id``,
    parent / grandparent ids, ``user_id`` and sequence properties; verified
    when a matching variable is in scope at the event's location."""
    parts = F.split("name", "_")
    obj = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")
    ev = events.select("repo", F.col("name").alias("event_name"), "path", "line_no",
                       F.when(obj != "", obj).otherwise(F.lit("unknown")).alias("_obj"))
    sv = scope.select("repo", "path", "line_no", "ord", F.col("name").alias("_v"), "access_path")

    def find_var(df, target: Column, loose: bool, alias: str):
        """First variable in scope order named like ``target`` (exactly, else,
        when ``loose``, containing it without underscores); one row per input row."""
        exact = F.lower(F.col("_v")) == F.lower(target)
        cond = exact if not loose else (exact | F.lower(F.col("_v")).contains(F.regexp_replace(target, "_", "")))
        rank = F.when(exact, 0).otherwise(1) if loose else F.lit(0)
        keys = [df[c] == sv[c] for c in ("repo", "path", "line_no")]
        j = df.join(sv, keys + [cond], "left").select(df["*"], "_v", "access_path", "ord")
        w = Window.partitionBy(*[F.col(c) for c in df.columns]).orderBy(rank, "ord")
        return (j.withColumn("_r", F.row_number().over(w)).where("_r = 1")
                .withColumn(alias, F.when(F.col("_v").isNotNull(), F.col("access_path"))).drop("_v", "access_path", "ord", "_r"))

    base = find_var(ev, F.col("_obj"), True, "_ovar")
    own = base.where(F.col("_obj") != "unknown").select(
        "repo", "event_name", F.concat("_obj", F.lit("_id")).alias("prop"), F.lit(True).alias("required"),
        F.coalesce(F.concat("_ovar", F.lit(".id")), F.concat("_obj", F.lit("?.id"))).alias("access_path"),
        F.col("_ovar").isNotNull().alias("verified"), F.lit(False).alias("todo"), F.lit(0).alias("ord"))
    # direct parents
    r = rel.select(F.col("repo").alias("_rr"), F.lower("child").alias("_c"), "parent", F.col("ord").alias("_po"))
    par = ev.join(r, (ev["repo"] == F.col("_rr")) & (F.lower("_obj") == F.col("_c"))).drop("_rr", "_c") \
        .withColumn("_ps", N.snake_from_camel("parent")).where(F.col("_ps") != F.col("_obj"))
    par = find_var(par, F.col("_ps"), True, "_pvar")
    direct = par.select("repo", "event_name", F.concat("_ps", F.lit("_id")).alias("prop"), F.lit(True).alias("required"),
                        F.coalesce(F.concat("_pvar", F.lit(".id")), F.concat("_ps", F.lit("?.id"))).alias("access_path"),
                        F.col("_pvar").isNotNull().alias("verified"), F.col("_pvar").isNull().alias("todo"),
                        (F.col("_po").cast("long") + LATER).alias("ord"))
    # grandparent from the first join path of two or more hops
    lp = paths.where(F.col("hops") >= 2).select(F.col("repo").alias("_pr"), F.lower("from").alias("_f"), "to", "hops", "ords")
    gp = ev.join(lp, (ev["repo"] == F.col("_pr")) & (F.lower(N.pascal_keep_tail(F.col("_obj"))) == F.col("_f")))
    gp = gp.groupBy("repo", "event_name", "path", "line_no", "_obj").agg(F.min_by("to", F.struct("hops", "ords")).alias("gp"))
    gp = gp.withColumn("_gs", N.snake_from_camel("gp"))
    dps = par.groupBy("repo", "event_name").agg(F.collect_set("_ps").alias("_dps"))
    gp = gp.join(dps, ["repo", "event_name"], "left").where(
        (F.col("_gs") != F.col("_obj")) & ~F.coalesce(F.array_contains("_dps", F.col("_gs")), F.lit(False))).drop("_dps")
    gp = find_var(gp, F.col("_gs"), False, "_gvar")
    grand = gp.select("repo", "event_name", F.concat("_gs", F.lit("_id")).alias("prop"), F.lit(False).alias("required"),
                      F.coalesce(F.concat("_gvar", F.lit(".id")), F.concat("_gs", F.lit("?.id"))).alias("access_path"),
                      F.col("_gvar").isNotNull().alias("verified"), F.col("_gvar").isNull().alias("todo"),
                      F.lit(2 * LATER).alias("ord"))
    # user_id
    us = sv.where(F.col("_v").isin(*USER_VARS)).groupBy("repo", "path", "line_no").agg(
        F.min_by(F.struct("_v", "access_path"), "ord").alias("_u"))
    uj = ev.join(us, ["repo", "path", "line_no"], "left")
    uacc = F.when(F.col("_u._v") == "session", F.concat("_u.access_path", F.lit("?.user?.id"))) \
        .when(F.col("_u").isNotNull(), F.concat("_u.access_path", F.lit("?.id"))).otherwise(F.lit("user?.id"))
    user = uj.select("repo", "event_name", F.lit("user_id").alias("prop"), F.lit(True).alias("required"),
                     uacc.alias("access_path"), F.col("_u").isNotNull().alias("verified"), F.lit(False).alias("todo"),
                     F.lit(3 * LATER).alias("ord"))
    parts_all = [own, direct, grand, user]
    if lifecycles is not None:
        lc = lifecycles.select(F.col("repo").alias("_lr"), N.snake_from_camel("object").alias("_lo")).distinct()
        done = ev.where(F.col("event_name").endswith("_completed")).withColumn(
            "_base", F.regexp_replace("event_name", "_completed$", ""))
        done = done.join(lc, (done["repo"] == F.col("_lr")) & (F.col("_base") == F.col("_lo")), "left_semi")
        parts_all.append(done.select("repo", "event_name", F.lit("time_to_complete_ms").alias("prop"),
                                     F.lit(False).alias("required"), F.lit(None).cast("string").alias("access_path"),
                                     F.lit(False).alias("verified"), F.lit(True).alias("todo"), F.lit(4 * LATER).alias("ord")))
    if sequences is not None:
        steps = sequences.select(F.col("event_name").alias("_step")).distinct()
        fail = ev.where(F.col("event_name").endswith("_failed")).withColumn(
            "_step", F.concat(F.regexp_replace("event_name", "_failed$", ""), F.lit("_tested")))
        fail = fail.join(steps, "_step", "left_semi")
        parts_all.append(fail.select("repo", "event_name", F.lit("attempt_number").alias("prop"),
                                     F.lit(False).alias("required"), F.lit(None).cast("string").alias("access_path"),
                                     F.lit(False).alias("verified"), F.lit(True).alias("todo"), F.lit(5 * LATER).alias("ord")))
    u = parts_all[0]
    for p in parts_all[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("repo", "event_name", "prop").orderBy("ord")
    return u.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# Property extraction from the code around an interaction.
TYPED_ARG = r"(?:mutationFn\s*:\s*)?async\s*\(\s*(\w+)\s*:\s*\{([^}]+)\}\s*\)\s*=>"
UNTYPED_ARG = r"(?:mutationFn\s*:\s*)?async\s*\(\s*(\w+)\s*\)\s*=>"
USE_MUTATION_CALL = r"\buseMutation\s*\("
DB_RETURN = r"const\s*\{\s*data\b[^}]*\}\s*=\s*await\s+\w+\."
SKIP_ARGS = ["e", "ev", "event", "req", "res", "ctx", "context", "err", "error"]
SKIP_PROPS = ["id", "then", "catch", "finally", "call", "apply"]


def normalize_property_type(t: Column) -> Column:
    x = F.regexp_replace(F.lower(F.trim(t)), r"\s+", "")
    return (F.when(x.isin("number", "int", "float", "bigint"), "number").when(x.isin("boolean", "bool"), "boolean")
            .when(x.endswith("[]") | x.startswith("array"), "array").otherwise("string"))


def code_properties(interactions: DataFrame, files: DataFrame) -> DataFrame:
    """Properties of each interaction's event read from its file: the
    fields of a typed inline parameter, else ``arg.prop`` uses of an untyped
    one, plus ``<entity>_id`` when the file destructures ``data`` from an
    awaited client call. First definition of a name wins."""
    f = files.select("repo", "path", "content")
    per_file = f.select(
        "repo", "path",
        F.regexp_extract("content", TYPED_ARG, 1).alias("_targ"), F.regexp_extract("content", TYPED_ARG, 2).alias("_tbody"),
        F.col("content").rlike(USE_MUTATION_CALL).alias("_mut"),
        F.regexp_extract("content", UNTYPED_ARG, 1).alias("_uarg"),
        F.col("content").rlike(DB_RETURN).alias("_db"), "content")
    typed = per_file.where(F.col("_targ") != "").select(
        "repo", "path", F.posexplode(F.split("_tbody", "[;,]")).alias("_i", "_field"), "_targ", "_mut")
    fm = r"^(\w+)\??\s*:\s*(.+)$"
    fld = F.trim("_field")
    prefix = F.when(F.col("_mut"), F.lit("variables")).otherwise(F.col("_targ"))
    typed = typed.where(fld.rlike(fm)).select(
        "repo", "path", F.col("_i").alias("ord"), F.trim(F.regexp_extract(fld, fm, 1)).alias("prop"),
        normalize_property_type(F.regexp_extract(fld, fm, 2)).alias("type"), (~fld.contains("?:")).alias("required"),
        F.concat(F.lit("from "), prefix, F.lit(" parameter")).alias("description"),
        F.concat(prefix, F.lit("."), F.trim(F.regexp_extract(fld, fm, 1))).alias("access_path")) \
        .where(F.length("prop") >= 2)
    untyped = per_file.where((F.col("_targ") == "") & (F.col("_uarg") != "") & ~F.col("_uarg").isin(*SKIP_ARGS))
    usage = F.regexp_extract_all(F.col("content"), F.concat(F.lit("\\b"), F.col("_uarg"), F.lit("\\.([a-zA-Z][a-zA-Z0-9_]*)")), 1)
    untyped = untyped.select("repo", "path", "_uarg", F.posexplode(usage).alias("ord", "prop")) \
        .where(~F.col("prop").isin(*SKIP_PROPS)).select(
            "repo", "path", (F.col("ord").cast("long") + LATER).alias("ord"), "prop", F.lit("string").alias("type"),
            F.lit(True).alias("required"), F.concat(F.lit("from "), "_uarg", F.lit(" usage")).alias("description"),
            F.concat("_uarg", F.lit("."), "prop").alias("access_path"))
    file_props = typed.unionByName(untyped)
    it = interactions.select("repo", "path", "function_name", F.col("line_no").alias("_line"),
                             _at(F.col("entities"), 1).alias("_entity"))
    a = it.join(file_props.hint("merge"), ["repo", "path"])  # as for ``stored`` tables; a union hides theirs
    db = it.join(per_file.where("_db").select("repo", "path"), ["repo", "path"]).where(F.col("_entity").isNotNull()).select(
        "repo", "path", "function_name", "_line", "_entity", F.lit(2 * LATER).alias("ord"),
        F.concat("_entity", F.lit("_id")).alias("prop"), F.lit("string").alias("type"), F.lit(False).alias("required"),
        F.lit("from insert return data").alias("description"), F.lit("data?.id").alias("access_path"))
    u = a.unionByName(db)
    w = Window.partitionBy("repo", "path", "function_name", "prop").orderBy("ord")
    return (u.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("repo", "path", "function_name", F.col("_line").alias("line_no"), "prop", "type", "required",
                    "description", "access_path", F.lit(True).alias("verified")))
