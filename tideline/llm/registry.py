"""Queries of the operators in this folder and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(plan: Query) -> Query:
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return add
