"""Named queries over the driver's tables, each beside the DuckDB statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql is what DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from tallyspark.queries import aggregates, checks, combine, graphs, joins, manifests, nested, recipes, records, scores, storage, streams, texts, windows  # noqa: E402, F401
