"""Samplers: even subsets, time grids, one pick per stratum, and observation quality over covered time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evenly_spaced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """At most `most` rows of each key at evenly spaced places of the order, its first and last included. Place i of most
    is row i * (n - 1) / (most - 1), rounded half to even."""
    window = Window.partitionBy(*keys)
    placed = rows.withColumn("__i", F.row_number().over(window.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(window))
    step = (F.col("__n") - 1) / F.lit(float(most - 1))
    # Row i is chosen if some place rounds to it: only the two places about i / step can.
    near = F.floor(F.col("__i") / step)
    chosen = F.exists(F.array(near - 1, near, near + 1), lambda p: (p >= 0) & (p <= most - 1) & (F.bround(p * step) == F.col("__i")))
    return placed.filter((F.col("__n") <= most) | chosen).drop("__i", "__n")


def stratum_picks(rows: DataFrame, keys: Sequence[str], stratum: Column, *order: Column) -> DataFrame:
    """The first row, in the given order, of every stratum of each key."""
    window = Window.partitionBy(*keys, "__s").orderBy(*order)
    return rows.withColumn("__s", stratum).withColumn("__n", F.row_number().over(window)).filter("__n = 1").drop("__s", "__n")


def time_grid(windows: DataFrame, keys: Sequence[str], start: str, end: str, step: int, out: str) -> DataFrame:
    """The multiples of step within each window, each once for a key however many windows hold it."""
    first = (F.ceil(F.col(start) / step) * step).cast("long")
    last = (F.floor(F.col(end) / step) * step).cast("long")
    points = windows.filter(first <= last).select(*keys, F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias(out))
    return points.distinct()


def quality(rows: DataFrame, keys: Sequence[str], confidence: str, covered: str, span: str) -> DataFrame:
    """Median confidence times the covered share of the span, per key."""
    share = F.try_divide(F.max(covered).cast("double"), F.max(span))
    return rows.groupBy(*keys).agg(F.median(confidence).alias("median"), share.alias("share")).withColumn("quality", F.col("median") * F.least(F.lit(1.0), F.col("share")))
