"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def mean(c: str) -> Column:
    """The mean to six digits, in whole numbers of a millionth, so that no order of a sum decides the last digit."""
    n, s = F.count(c), F.sum(F.round(F.col(c) * 1e6).cast("bigint"))
    return F.floor((2 * s + n) / F.nullif(2 * n, F.lit(0)).cast("decimal(20,0)")).cast("double") / 1e6


def mean_sql(c: str) -> str:
    return f"(((2 * sum(round(({c}) * 1e6)::bigint) + count({c})) // nullif(2 * count({c}), 0))::double / 1e6)"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
