"""All queries over the driver's tables with their oracles, and the model graph's evaluator."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("scalar_queries", "movement_queries", "balance_queries", "report_queries", "forecast_queries", "goal_queries", "quality_queries", "maintenance_queries", "planning_queries", "lake_queries", "window_queries")


def query(sql: str | None = None, name: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its function's name."""

    def put(f: Callable) -> Callable:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _ORACLES[key] = sql
        return f

    return put


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"ledgerlake.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def evaluate(models: Mapping[str, tuple[tuple[str, ...], Callable[..., DataFrame]]], sources: Mapping[str, DataFrame], wanted: str) -> DataFrame:
    """A model of a graph {name: (dependencies, function)}: dependencies are built first, each once."""
    built: dict[str, DataFrame] = dict(sources)

    def build(name: str, path: tuple[str, ...] = ()) -> DataFrame:
        if name in path:
            raise ValueError(f"cycle: {' -> '.join((*path, name))}")
        if name not in built:
            needs, make = models[name]
            built[name] = make(*(build(x, (*path, name)) for x in needs))
        return built[name]

    return build(wanted)
