"""Registered queries: each operator on tables derived from the given ones.

``register`` binds a name to the Spark query and, where one can be written, to
the equivalent DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def bind(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return bind


def load_all() -> None:
    from catalog import (  # noqa: F401
        batches,
        documents,
        fuzzy,
        memory,
        pipelines,
        reports,
        requests,
        text,
    )
