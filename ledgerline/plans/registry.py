"""Named queries over the tables of a folder, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def register(plan: Callable[[Tables], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return register
