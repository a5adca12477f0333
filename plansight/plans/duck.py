"""DuckDB SQL text for the oracle side of the name functions.

These build expression strings only; they mirror ``plansight.functions.names``
so the oracle queries stay readable. Nothing here runs in Spark.
"""

from __future__ import annotations

from ..functions import names as N


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx_replace(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def snake_from_camel(x: str) -> str:
    s = rx_replace(x, r"([a-z0-9])([A-Z])", r"\1_\2")
    s = f"lower({rx_replace(s, r'[^a-zA-Z0-9_]+', '_')})"
    s = rx_replace(s, r"_+", "_")
    return rx_replace(s, r"^_+|_+$", "")


def snake_from_words(lst: str) -> str:
    w = f"list_filter(list_transform({lst}, lambda s: trim(s)), lambda s: s <> '')"
    joined = f"array_to_string({w}, '_')"
    return f"lower({rx_replace(joined, r'__+', '_')})"


def pascal_keep_tail(x: str) -> str:
    parts = f"list_filter(regexp_split_to_array({x}, {q(r'[_\-\s]+')}), lambda s: s <> '')"
    return f"array_to_string(list_transform({parts}, lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), '')"


def pascal_lower_tail(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {q(r'[\s_-]+')})"
    return (f"array_to_string(list_transform({parts}, "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')")


def singular(x: str) -> str:
    return f"regexp_replace({x}, 's$', '')"


def past_tense(x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in N.PAST_TENSE.items())
    return f"(CASE lower({x}) {whens} ELSE lower({x}) || 'ed' END)"


def event_id(x: str) -> str:
    return f"('evt_' || substr(sha256({x}), 1, 8))"


def fnv1a32_hex(x: str) -> str:
    codes = f"list_transform(range(1, length({x}) + 1), lambda i: CAST(unicode(substr({x}, i, 1)) AS BIGINT))"
    h = (f"list_reduce({codes}, lambda h, c: (xor(h, c) * 16777619) & 4294967295, "
         f"CAST(2166136261 AS BIGINT))")
    return f"lpad(lower(hex({h})), 8, '0')"


def metric_id(x: str) -> str:
    return f"('m_' || {fnv1a32_hex(x)})"


def _parts(x: str) -> str:
    return f"list_filter(string_split({x}, '_'), lambda s: s <> '')"


def _obj(parts: str) -> str:
    return f"array_to_string({parts}[1:greatest(len({parts}) - 1, 0)], '_')"


def is_valid_event_name(x: str) -> str:
    p = _parts(x)
    verb = f"{p}[-1]"
    obj = _obj(p)
    garbage = ", ".join(q(g) for g in N.GARBAGE_NAMES)
    return (f"coalesce(({x} NOT IN ({garbage}) AND regexp_matches({x}, '^[a-z][a-z0-9_]*$') "
            f"AND len({p}) >= 2 AND {obj} <> '' AND {obj} <> {verb} "
            f"AND {obj} <> regexp_replace({verb}, 'ed$', '') AND {obj} <> regexp_replace({verb}, 'd$', '') "
            f"AND length({obj}) >= 3 AND length({obj}) <= 30), false)")


def is_business_event(x: str) -> str:
    pat = "^(" + "|".join(N.IGNORED_PREFIXES) + ")"
    return f"(NOT regexp_matches({x}, {q(pat)}))"


def split_object_action(x: str) -> tuple[str, str]:
    p = f"string_split({x}, '_')"
    obj = f"array_to_string({p}[1:len({p}) - 1], '_')"
    return (f"(CASE WHEN {obj} <> '' THEN {obj} ELSE 'unknown' END)", f"coalesce({p}[-1], 'unknown')")


def object_of_synth(x: str) -> str:
    p = _parts(x)
    return f"(CASE WHEN len({p}) >= 2 AND {_obj(p)} <> '' THEN {_obj(p)} ELSE 'item' END)"


def entity_of_scored(x: str) -> str:
    p = _parts(x)
    return f"(CASE WHEN len({p}) >= 2 THEN {_obj(p)} ELSE {x} END)"


def signal_type(t: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in N.SIGNAL_OF_TYPE.items())
    return f"(CASE {t} {whens} ELSE 'action' END)"


def priority_heuristic(name: str, t: str) -> str:
    n = f"lower({name})"
    w = f"regexp_matches({n}, {q(N.WRITE_SUFFIX)})"
    return (f"(CASE WHEN regexp_matches({n}, {q(N.ACTIVATION_LIKE)}) THEN 'critical' "
            f"WHEN {w} AND {t} IN ('mutation', 'route_handler') THEN 'high' "
            f"WHEN {w} THEN 'medium' WHEN {t} IN ('toggle', 'click_handler') THEN 'low' "
            f"ELSE 'medium' END)")


def priority_rank(x: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in N.PRIORITY_RANK.items())
    return f"(CASE {x} {whens} ELSE {len(N.PRIORITY_RANK)} END)"


def object_from_path(x: str) -> str:
    base = f"coalesce(list_filter(regexp_split_to_array({x}, '[\\\\/]'), lambda s: s <> '')[-1], '')"
    cleaned = f"regexp_replace({base}, '\\.(ts|tsx|js|jsx)$', '')"
    snake = snake_from_camel(cleaned)
    bad_files = ", ".join(q(f) for f in N.NON_OBJECT_FILES)
    return (f"(CASE WHEN {cleaned} = '' OR lower({cleaned}) IN ({bad_files}) OR length({snake}) < 3 "
            f"THEN NULL ELSE {snake} END)")


def cnt(cond: str) -> str:
    """count_if that yields 0 (not NULL) when every input is NULL."""
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"
