"""The registry of queries: each takes (spark, sf_dir); most have equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.tables import micros, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """The events table with `t`, microseconds; of the given kinds only."""
    rows = table(spark, sf_dir, "events")
    if kinds:
        rows = rows.filter(F.col("event_type").isin(*kinds))
    return rows.withColumn("t", micros("ts"))
