"""Registry of named queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without `sql` only its rows are checked."""

    def add(job: Query) -> Query:
        QUERIES[name] = job
        if sql:
            ORACLE[name] = sql
        return job

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; times are read and shown as UTC in any session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(ts: Column) -> Column:
    """Timestamps leave a query as text, so that no zone setting can change them."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def joined(a: Column, sep: str = "|") -> Column:
    """Arrays leave a query as one text."""
    return F.array_join(a, sep)


def big(c: Column) -> Column:
    return c.cast("bigint")
