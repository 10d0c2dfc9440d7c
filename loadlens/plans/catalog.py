"""Registry of named queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero, so that the order of sums doesn't show."""
    return F.round(c, digits) + F.lit(0.0)


def sql_r6(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0"
