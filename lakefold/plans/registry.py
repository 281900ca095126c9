"""All queries of the core library and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakefold.plans import documents, fundamentals, prices, reference_data, screening, statements, streams, text, valuation, wide

_MODULES = [screening, prices, fundamentals, statements, valuation, reference_data, text, documents, streams, wide]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "SQL", {}).items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return screening.screen_funnel(spark, root)
