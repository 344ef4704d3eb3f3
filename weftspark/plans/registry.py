"""The registered queries of the library: each a function of (spark, folder), with the SQL of the same result if there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("mtbench", "arena", "mixes", "chats", "packs", "preferences", "losses", "rollups", "pipelines")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name; ``{view}`` in the SQL stands for the view of plans.views with that name."""

    def register(run: Query) -> Query:
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"weftspark.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from weftspark.plans.views import with_views

    _load()
    return {name: with_views(sql) for name, sql in _SQL.items()}
