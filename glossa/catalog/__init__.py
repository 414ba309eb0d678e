"""Registered queries: one Spark callable per operator, plus its DuckDB oracle.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole input tables. The oracle is the same result written in SQL for DuckDB
(None where the result is random, iterative or a file side effect).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

# The query ``entry()`` runs: the hierarchical preparation (clean ->
# vocabulary -> stratified split -> document id matrices).
FLAGSHIP = "prepare_hierarchical"

_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

_MODULES = ("text", "vocab", "labels", "splits", "encode", "metrics", "vectors",
            "explain", "models", "io", "streams", "lemmas", "staged", "epochs", "sentences", "leave_one_out")


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"glossa.catalog.{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    out = {k: v[0] for k, v in _REGISTRY.items()}
    return out


def flagship() -> QueryFn:
    return queries()[FLAGSHIP]


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in _REGISTRY.items() if v[1]}
