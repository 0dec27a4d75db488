"""Runs of the same observations in several modes, held against each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tagged(runs: Mapping[str, DataFrame], keys: Sequence[str], sample: str, value: str) -> DataFrame:
    parts = [rows.select(*keys, sample, F.col(value).alias("value"), F.lit(mode).alias("mode")) for mode, rows in runs.items()]
    return reduce(DataFrame.unionByName, parts)


def run_coverage(runs: Mapping[str, DataFrame], keys: Sequence[str], sample: str, value: str) -> DataFrame:
    """mode, keys, samples, known (not null) and states (value and its count, in order of value) of each run."""
    counted = _tagged(runs, keys, sample, value).groupBy("mode", *keys, "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    states = F.array_sort(F.collect_list(F.when(known, F.struct("value", "n"))))  # a row for each state
    return counted.groupBy("mode", *keys).agg(F.sum("n").alias("samples"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("known"), states.alias("states"))


def run_differences(runs: Mapping[str, DataFrame], keys: Sequence[str], sample: str, value: str) -> DataFrame:
    """keys, sample and one column for each mode, of samples on whose value the modes don't agree (a sample that a run lacks is null there)."""
    each = [F.max(F.when(F.col("mode") == mode, F.col("value"))).alias(mode) for mode in runs]
    wide = _tagged(runs, keys, sample, value).groupBy(*keys, sample).agg(*each)
    first = next(iter(runs))
    differ = reduce(lambda a, b: a | b, [~F.col(first).eqNullSafe(F.col(mode)) for mode in runs], F.lit(False))
    return wide.filter(differ)
