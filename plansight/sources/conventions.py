"""Convention source (S5): YAML convention files read once on the driver (a
small, bounded configuration) into three dimension tables."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

try:  # optional dependency
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

STATUSES = ["stable", "experimental", "deprecated"]
LIFECYCLES = ["attempt", "success", "fail", "start", "complete", "skip"]

EVENTS_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("domain", "name", "lifecycle", "description")]
                             + [T.StructField("ord", T.IntegerType())])
ATTRS_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()), T.StructField("event_name", T.StringType()),
    T.StructField("attr", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("required", T.BooleanType()), T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("ord", T.IntegerType())])


def _valid(raw) -> bool:
    if not isinstance(raw, dict):
        return False
    if not isinstance(raw.get("domain"), str) or not isinstance(raw.get("description"), str):
        return False
    if raw.get("status") not in STATUSES or not isinstance(raw.get("version"), str):
        return False
    if not isinstance(raw.get("events"), list):
        return False
    for e in raw["events"]:
        if not isinstance(e, dict) or not isinstance(e.get("name"), str) or not isinstance(e.get("description"), str):
            return False
        if e.get("lifecycle") not in LIFECYCLES or not isinstance(e.get("attributes"), dict):
            return False
        a = e["attributes"]
        if not isinstance(a.get("required"), list) or not isinstance(a.get("optional"), list):
            return False
    return True


def parse_conventions(texts: list[tuple[str, str]]):
    """(path, yaml text) pairs in load order -> (event rows, attribute rows).

    Invalid documents are skipped; the first document of a domain wins; an
    event name defined in several domains resolves to the last one loaded."""
    by_domain, events, attrs = set(), {}, {}
    for _path, text in texts:
        try:
            raw = yaml.safe_load(text)
        except Exception:  # noqa: BLE001
            continue
        if not _valid(raw) or raw["domain"] in by_domain:
            continue
        dom = raw["domain"]
        by_domain.add(dom)
        for i, e in enumerate(raw["events"], 1):
            events[e["name"]] = (dom, e["name"], e["lifecycle"], " ".join(str(e["description"]).split()), i)
            rows = []
            for req, key in ((True, "required"), (False, "optional")):
                for j, a in enumerate(e["attributes"][key] or [], 1):
                    vals = [str(v) for v in a["values"]] if isinstance(a.get("values"), list) else None
                    rows.append((dom, e["name"], str(a.get("name")), str(a.get("type") or "string"), req, vals,
                                 j if req else 1000 + j))
            attrs[e["name"]] = rows
    return list(events.values()), [r for rows in attrs.values() for r in rows]


def load_conventions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``conv_events`` and ``conv_attrs`` from every ``*.yaml``/``*.yml``
    below ``folder`` (sorted path order)."""
    paths = sorted(glob.glob(os.path.join(folder, "**", "*.y*ml"), recursive=True))
    texts = []
    for p in paths:
        try:
            with open(p, encoding="utf-8") as fh:
                texts.append((p, fh.read()))
        except OSError:
            continue
    ev, at = parse_conventions(texts)
    return spark.createDataFrame(ev, EVENTS_SCHEMA), spark.createDataFrame(at, ATTRS_SCHEMA)
