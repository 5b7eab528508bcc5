"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

#: Modules whose import registers their queries.
MODULES = ("search", "catalogue", "documents", "timelines", "polls", "merging", "texts", "scripture", "basics", "shows", "formats", "streams")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL if SQL can express it."""

    def keep(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries are named {f.__name__}")
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quillon.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
