"""Set operators: best of duplicates, conflicts, gaps, differences, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def duplicate_audit(rows: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Keys that stand several times: exact (one content) or conflict."""
    print_ = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in content]), 256)
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(print_).alias("contents")).filter("n > 1")
    return found.withColumn("kind", F.when(F.col("contents") == 1, "exact").otherwise("conflict"))


def reused_ids(rows: DataFrame, ident: str, scope: str) -> DataFrame:
    """Ids that stand in several scopes."""
    return rows.groupBy(ident).agg(F.countDistinct(scope).alias("scopes")).filter("scopes > 1")


def number_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers missing between the smallest and the largest of each key."""
    bounds = rows.groupBy(key).agg(F.min(number).alias("lo"), F.max(number).alias("hi"))
    return bounds.select(key, F.explode(F.sequence("lo", "hi")).alias(number)).join(rows.select(key, number), [key, number], "left_anti")


def expected_diff(expected: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: missing or unexpected."""
    missing = expected.select(key).distinct().join(supplied, key, "left_anti").withColumn("kind", F.lit("missing"))
    return missing.unionByName(supplied.select(key).distinct().join(expected, key, "left_anti").withColumn("kind", F.lit("unexpected")))


def fingerprint(values: Column) -> Column:
    """As an aggregate: 16 hexadecimal digits of SHA-256 of the sorted distinct values, one a line. For bounded sets."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(values)), "\n"), 256), 1, 16)
