"""Event-name functions as Spark Column expressions (JVM-side, codegen'd).

Every function maps Column -> Column, so it runs inside whole-stage codegen
wherever it is used; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from .util import at as _at

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Names that repeat their verb and are rejected as garbage.
GARBAGE_NAMES = [
    "save_saved", "add_added", "remove_removed", "remove_deleted", "delete_deleted",
    "update_updated", "change_changed", "click_clicked", "submit_submitted",
]

# Prefixes of UI-internal (non-business) event names.
IGNORED_PREFIXES = [
    "key_", "mouse_", "drag_", "scroll_", "focus_", "blur_", "hover_", "resize_",
    "toast", "sidebar_", "dialog_", "modal_",
]

# Irregular past tenses; any other verb takes "ed".
PAST_TENSE = {
    "create": "created", "add": "added", "delete": "deleted", "remove": "removed",
    "update": "updated", "save": "saved", "submit": "submitted", "start": "started",
    "stop": "stopped", "test": "tested", "select": "selected", "toggle": "toggled",
    "enable": "enabled", "disable": "disabled", "cancel": "cancelled", "close": "closed",
    "open": "opened", "change": "changed", "upsert": "upserted", "insert": "created",
    "upgrade": "upgraded", "invite": "invited",
}

# Interaction type -> signal type; unknown types are actions.
SIGNAL_OF_TYPE = {
    "click_handler": "action", "form_submit": "action", "toggle": "action",
    "route_handler": "action", "mutation": "action",
    "lifecycle": "state_change", "state_change": "state_change",
    "error_boundary": "error",
    "api_call": "operation", "retry_logic": "operation", "job_handler": "operation",
}

# Priority heuristic patterns (applied to the lower-cased name).
WRITE_SUFFIX = r"_(created|deleted|updated|saved|submitted|upgraded|invited)$"
ACTIVATION_LIKE = (
    r"(signup|signed_up|onboard|activated|upgrade|upgraded|subscribe|subscribed|purchase|"
    r"purchased|payment|paid|checkout|order_placed|listing_created|transaction|api_key|"
    r"deployed|integration_connected|session_started|published)"
)

# File names that never name an object.
NON_OBJECT_FILES = ["index", "route", "page", "app"]

PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


# --- F1 / F2 / F3 / F4 / F5 ------------------------------------------------

def snake_from_camel(c) -> Column:
    """``fooBar Baz`` -> ``foo_bar_baz``."""
    x = F.regexp_replace(_c(c), r"([a-z0-9])([A-Z])", "$1_$2")
    x = F.lower(F.regexp_replace(x, r"[^a-zA-Z0-9_]+", "_"))
    x = F.regexp_replace(x, r"_+", "_")
    return F.regexp_replace(x, r"^_+|_+$", "")


def snake_from_words(words) -> Column:
    """trim words, drop empty ones, join with ``_``, squeeze, lower."""
    w = F.filter(F.transform(_c(words), lambda s: F.trim(s)), lambda s: s != "")
    return F.lower(F.regexp_replace(F.array_join(w, "_"), r"__+", "_"))


def _cap(w: Column, lower_tail: bool) -> Column:
    tail = F.substring(w, 2, 1 << 30)
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(tail) if lower_tail else tail)


def pascal_keep_tail(c) -> Column:
    """F3 (context variant): split on ``_``/``-``/space runs, capitalise, keep tail case."""
    parts = F.filter(F.split(_c(c), r"[_\-\s]+"), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda w: _cap(w, False)), "")


def pascal_lower_tail(c) -> Column:
    """F3 (spec variant): capitalise first letter, lower-case the rest of each word."""
    parts = F.split(_c(c), r"[\s_-]+")
    return F.array_join(F.transform(parts, lambda w: _cap(w, True)), "")


def singular(c) -> Column:
    """strip one final ``s``."""
    return F.regexp_replace(_c(c), r"s$", "")


def past_tense(c) -> Column:
    """irregular map, else ``verb + ed`` (both lower-cased)."""
    v = F.lower(_c(c))
    return F.coalesce(_at(_map_lit(PAST_TENSE), v), F.concat(v, F.lit("ed")))


# --- F6 / F7 ------------------------------------------------------------------

def event_id(c) -> Column:
    """``evt_`` + first 8 hex digits of sha256(name)."""
    return F.concat(F.lit("evt_"), F.substring(F.sha2(_c(c), 256), 1, 8))


def fnv1a32_hex(c) -> Column:
    """FNV-1a 32-bit over the characters of ``c``, 8 lower-case hex digits."""
    s = _c(c)
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
                        lambda i: F.ascii(F.substring(s, i, 1)).cast("bigint"))
    codes = F.when(F.length(s) > 0, codes).otherwise(F.array().cast("array<bigint>"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"),
                    lambda acc, ch: ((acc.bitwiseXOR(ch)) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def metric_id(c) -> Column:
    return F.concat(F.lit("m_"), fnv1a32_hex(c))


# --- F8 -----------------------------------------------------------------------

def object_from_path(c) -> Column:
    """F8: last path segment without a JS/TS extension, snake-cased; null when
    it is an index/route/page/app file or shorter than 3 characters."""
    base = _at(F.filter(F.split(_c(c), r"[\\/]"), lambda s: s != ""), -1)
    cleaned = F.regexp_replace(F.coalesce(base, F.lit("")), r"\.(ts|tsx|js|jsx)$", "")
    snake = snake_from_camel(cleaned)
    bad = (cleaned == "") | F.lower(cleaned).isin(*NON_OBJECT_FILES) | (F.length(snake) < 3)
    return F.when(~bad, snake)


# --- P2 / P3 / P4 -----------------------------------------------------------------

def _parts(c) -> Column:
    return F.filter(F.split(_c(c), "_"), lambda s: s != "")


def _object_part(parts: Column) -> Column:
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "_")


def is_valid_event_name(c) -> Column:
    """Garbage list, charset, object_verb shape, object not the verb, 3..30 chars."""
    n = _c(c)
    parts = _parts(n)
    verb = _at(parts, -1)
    obj = _object_part(parts)
    return (F.coalesce(
        ~n.isin(*GARBAGE_NAMES)
        & n.rlike(r"^[a-z][a-z0-9_]*$")
        & (F.size(parts) >= 2)
        & (obj != "")
        & (obj != verb)
        & (obj != F.regexp_replace(verb, "ed$", ""))
        & (obj != F.regexp_replace(verb, "d$", ""))
        & (F.length(obj) >= 3)
        & (F.length(obj) <= 30), F.lit(False)))


def is_business_event(c) -> Column:
    """Not a UI-internal name."""
    pat = "^(" + "|".join(IGNORED_PREFIXES) + ")"
    return ~_c(c).rlike(pat)


def split_object_action(c) -> tuple[Column, Column]:
    """P4 (plan variant): action = last ``_`` part (``unknown`` if none), object =
    the rest joined (``unknown`` if empty). Empty parts are kept."""
    parts = F.split(_c(c), "_")
    action = _at(parts, -1)
    obj = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_")
    return (F.when(obj != "", obj).otherwise(F.lit("unknown")),
            F.coalesce(action, F.lit("unknown")))


def object_of_synth(c) -> Column:
    """P4 (synthesis variant): object part, ``item`` if fewer than two parts."""
    parts = _parts(c)
    obj = _object_part(parts)
    return F.when((F.size(parts) >= 2) & (obj != ""), obj).otherwise(F.lit("item"))


def entity_of_scored(c) -> Column:
    """P4 (scoring variant): object part, or the whole name if fewer than two parts."""
    parts = _parts(c)
    return F.when(F.size(parts) >= 2, _object_part(parts)).otherwise(_c(c))


# --- P5 / P7 ------------------------------------------------------------------------

def signal_type(interaction_type) -> Column:
    """P5: interaction type -> signal type (``action`` by default)."""
    return F.coalesce(_at(_map_lit(SIGNAL_OF_TYPE), _c(interaction_type)), F.lit("action"))


def priority_heuristic(name, interaction_type) -> Column:
    """Critical for activation-like names, high/medium for writes, low for UI-only."""
    n = F.lower(_c(name))
    t = _c(interaction_type)
    is_write = n.rlike(WRITE_SUFFIX)
    return (F.when(n.rlike(ACTIVATION_LIKE), "critical")
            .when(is_write & t.isin("mutation", "route_handler"), "high")
            .when(is_write, "medium")
            .when(t.isin("toggle", "click_handler"), "low")
            .otherwise("medium"))


def priority_rank(c) -> Column:
    return F.coalesce(_at(_map_lit(PRIORITY_RANK), _c(c)), F.lit(len(PRIORITY_RANK)))
