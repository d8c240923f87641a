"""The registry of queries: each has a callable (spark, sf_dir) -> DataFrame and, mostly, its DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries when imported.
MODULES = ("scans", "relational", "scalar", "documents", "changes", "extensions")

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def op(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its DuckDB SQL where SQL can express it."""

    def put(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = f
        if oracle is not None:
            _oracles[name] = oracle
        return f

    return put


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemark.operators.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
