"""Registered queries of the engine and the SQL that each must equal."""

from __future__ import annotations

import importlib
from collections.abc import Callable

MODULES = ["retrieval", "aggregation", "evaluation", "statistics", "elementwise", "training"]
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, and the SQL for the same rows."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"ocellus.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
