"""Provenance: closures over parent edges, leakage, journals, incremental work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.tables import cut


def closure(edges: DataFrame, most: int = 30) -> DataFrame:
    """(child, ancestor) pairs over parent edges (child, parent). A round joins the pairs that the last one found, not all, with all pairs: those reach twice as
    far, so a chain of 2**k edges takes k rounds. Each round's new pairs are written to the shared folder; raises if `most` rounds still find some."""
    pairs = fresh = cut(edges.select("child", F.col("parent").alias("ancestor")).distinct())
    for _ in range(most):
        longer = fresh.alias("a").join(pairs.alias("b"), F.col("a.ancestor") == F.col("b.child")).select("a.child", "b.ancestor").distinct()
        fresh = cut(longer.join(pairs, ["child", "ancestor"], "left_anti"))
        if fresh.isEmpty():
            return pairs
        pairs = pairs.unionByName(fresh)
    raise ValueError(f"pairs still grow after {most} rounds: the edges hold a chain of over 2 ** {most} edges")


def split_of(bucket: Column, ratios: list[tuple[str, float]]) -> Column:
    """The split whose cumulative share the bucket falls in; the last takes the rest."""
    edge, out = 0.0, F
    for name, share in ratios[:-1]:
        edge += share
        out = out.when(bucket < edge, name)
    return out.otherwise(ratios[-1][0])


def split_violations(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that span several splits."""
    return rows.groupBy(group).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def unprocessed(sources: DataFrame, done: DataFrame, key: str, producer: str) -> DataFrame:
    """Sources that the producer hasn't processed."""
    return sources.join(done.filter(F.col("producer") == producer).select(key).distinct(), key, "left_anti")


def latest_state(journal: DataFrame, key: str, seq: str, *values: str) -> DataFrame:
    """Latest-wins fold of a journal."""
    return journal.groupBy(key).agg(*[F.max_by(v, seq).alias(v) for v in values], F.max(seq).alias(seq), F.count("*").alias("entries"))


def chain_breaks(journal: DataFrame, keys: list[str], seq: str, prev: str, line: str) -> DataFrame:
    """Journal rows whose prev isn't the hash of the line before in the same journal, or whose seq doesn't follow on."""
    order = Window.partitionBy(*keys).orderBy(seq)
    before = F.lag(F.sha2(line, 256)).over(order)
    step = F.col(seq) - F.lag(seq).over(order)
    rows = journal.withColumn("__h", before).withColumn("__s", step)
    return rows.filter((F.col("__h").isNotNull() & (F.coalesce(prev, F.lit("")) != F.col("__h"))) | (F.col("__s") != 1)).drop("__h", "__s")
