"""Registry of named queries: a Spark builder plus, where SQL can say it, the
equivalent DuckDB SQL used as the correctness oracle.

Family modules (``plansight.plans.q_*``) register with ``@query``; importing
``plansight.plans`` loads them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Builder
    oracle: str | None
    family: str


REGISTRY: dict[str, QuerySpec] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = QuerySpec(name, fn, oracle, fn.__module__.rsplit(".", 1)[-1])
        return fn
    return deco
