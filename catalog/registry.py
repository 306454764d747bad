"""A query is a Spark function and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under the name of its function, less a final underscore."""

    def keep(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        name = build.__name__.rstrip("_")
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](Views(spark, folder))


def r6(column: str | Column, alias: str | None = None) -> Column:
    """Six decimals, the precision at which two engines agree on sums of doubles."""
    rounded = F.round(column, 6)
    return rounded.alias(alias or column) if alias or isinstance(column, str) else rounded


def text(ts: str, alias: str | None = None) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(alias or ts)


def long(column: str) -> Column:
    return F.col(column).cast("long").alias(column)
