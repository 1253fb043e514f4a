"""Every registered query of the engine with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_queries, ingest_queries, retrieval_queries

_MODULES = (retrieval_queries, ingest_queries, chat_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.REGISTRY.sql.items()}
