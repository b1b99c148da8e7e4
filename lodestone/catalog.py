"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import analytics, documents, graph, library, retrieval, sources, wiki

_PLANS = (retrieval, graph, library, sources, wiki, analytics, documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in _PLANS for k, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in _PLANS for k, q in p.SQL.items()}
