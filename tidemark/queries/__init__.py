"""Every operator as a query over the star schema's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from tidemark.queries import forecasts, likeness, parts, products, sales

    modules = [sales, products, forecasts, likeness, parts]
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for m in modules:
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
