"""Registered queries. Importing this package loads every query family."""

from importlib import import_module

from .catalog import REGISTRY, QuerySpec, query  # noqa: F401

FAMILIES = ("q_events", "q_names", "q_plan", "q_metrics", "q_sequences", "q_ingest", "q_contracts", "q_corpus", "q_misc", "q_graph", "q_streaming", "q_scan", "q_patches", "q_more", "q_conventions", "q_summary", "q_scope", "q_live", "q_claims", "q_store", "q_lexer", "q_feedback_log", "q_extend")

for _m in FAMILIES:
    import_module(f"{__name__}.{_m}")
