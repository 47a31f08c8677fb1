"""Registry of checked queries: ``key -> (spark, sf_dir) -> DataFrame`` plus the
DuckDB SQL that computes the same result over the driver tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinio.plans.oracle_model import with_model

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

# Modules whose import registers queries (order = listing order).
_MODULES = (
    "opinio.plans.registered.marts",
    "opinio.plans.registered.control",
    "opinio.plans.registered.ingest",
    "opinio.plans.registered.text",
    "opinio.plans.registered.sources",
    "opinio.plans.registered.streams",
)


def query(key: str, oracle: str | None = None):
    """Register ``fn`` under ``key``; ``oracle`` is DuckDB SQL over the model."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key!r}")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = with_model(oracle)
        return fn
    return deco


def _load() -> None:
    for mod in _MODULES:
        importlib.import_module(mod)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
