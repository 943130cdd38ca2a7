"""Queries by name, with their oracle SQL; the query modules fill it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airside.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the fixture ``tables``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = oracle(sql, *tables) if tables else sql
        return f

    return add
