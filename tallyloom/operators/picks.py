"""Greedy picks whose next choice depends on what was chosen before, without a task that holds a key's rows.

Each round is an aggregate (the best row of every key) and one update of what a row keeps of the choices so far: its distance to the nearest
of them, or the counts and codes of its key. A budget of picks is as many rounds, each written to the shared folder; rows of all keys
go together, a key with a third of the rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.tables import cut


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def farthest_first(rows: DataFrame, keys: Sequence[str], ident: str, at: Sequence[str], k: int, priority: str | None = None, given: DataFrame | None = None) -> DataFrame:
    """Up to k rows of each key with their place (from 1): always the one of the highest priority, of equal ones the one farthest from
    everything chosen before, then with the smallest ident. `given`: rows (keys and `at`) that count as chosen. Without given rows the first is
    the smallest ident of the highest priority. Without priority the largest gap left is at most twice the smallest possible."""
    names = [f"__{c}" for c in [*keys, *at]]
    chosen_key, chosen_at = names[: len(keys)], names[len(keys) :]
    # Differences are taken in the columns' own type and squared as doubles: the square of an hour in microseconds is no long.
    gap = lambda a, b: (F.col(a) - F.col(b)).cast("double")
    away = lambda: F.sqrt(sum((gap(a, b) * gap(a, b) for a, b in zip(at, chosen_at, strict=True)), F.lit(0.0)))

    def nearer(left: DataFrame, chosen: DataFrame) -> DataFrame:
        new = chosen.select(*[F.col(c).alias(n) for c, n in zip([*keys, *at], names, strict=True)])
        return left.join(new, _same(keys, chosen_key), "left").withColumn("__near", F.least("__near", F.coalesce(away(), F.lit(float("inf"))))).drop(*names)

    order = F.struct((-F.col(priority) if priority else F.lit(0)).alias("p"), (-F.col("__near")).alias("d"), F.col(ident).alias("i"))
    left = rows.withColumn("__near", F.lit(float("inf")))
    if given is not None:
        least = given.select(*[F.col(c).alias(n) for c, n in zip([*keys, *at], names, strict=True)])
        one = rows.join(least, _same(keys, chosen_key), "left").groupBy(*rows.columns).agg(F.min(F.coalesce(away(), F.lit(float("inf")))).alias("__near"))
        left = one
    left = cut(left)
    out: DataFrame | None = None
    for place in range(1, k + 1):
        best = left.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("x"))
        best = cut(best.select("x.*").withColumn("place", F.lit(place)))
        if best.isEmpty():
            break
        out = best if out is None else out.unionByName(best)
        taken = best.select(*[F.col(c).alias(f"__{c}") for c in keys], F.col(ident).alias("__ident"))
        left = left.join(taken, _same([*keys, ident], [*[f"__{c}" for c in keys], "__ident"]), "left_anti")
        left = cut(nearer(left, best))
    return rows.withColumn("place", F.lit(0)).limit(0) if out is None else out


def balanced(rows: DataFrame, keys: Sequence[str], ident: str, time: str, start: str, end: str, priority: str, slots: int) -> DataFrame:
    """Up to `slots` rows of each key, place from 1: first the best of every equal stretch of time between the key's start and end
    (highest priority, then nearest to the stretch's middle, then earliest), then, while places are left, the rows of the highest priority that are
    farthest from those chosen, the earliest of equals."""
    n = Window.partitionBy(*keys)
    counted = rows.withColumn("__slots", F.least(F.lit(slots), F.count(F.lit(1)).over(n)))
    span = F.greatest(F.col(end) - F.col(start), F.lit(1))
    bucket = F.greatest(F.lit(0), F.least(F.col("__slots") - 1, F.floor((F.col(time) - F.col(start)) * F.col("__slots") / span)))
    middle = F.col(start) + span * (2 * F.col("__bucket") + 1) / (2 * F.col("__slots"))
    order = Window.partitionBy(*keys, "__bucket").orderBy(F.desc(priority), F.abs(F.col(time) - middle), time, ident)
    marked = cut(counted.withColumn("__bucket", bucket).withColumn("__n", F.row_number().over(order)))
    strata = marked.filter("__n = 1")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__bucket"))
    first = cut(strata.withColumn("place", place).drop("__n", "__bucket"))
    filled = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("__have"))
    rest = marked.filter("__n > 1").drop("__n", "__bucket")
    have = filled.select(*[F.col(c).alias(f"__{c}") for c in keys], "__have")
    rest = rest.join(have, _same(keys, [f"__{c}" for c in keys])).filter("__have < __slots").drop(*[f"__{c}" for c in keys])
    order_id = rest.withColumn("__order", F.struct(time, ident))
    more = farthest_first(order_id, keys, "__order", [time], slots - 1, priority, first)
    more = more.filter(F.col("place") <= F.col("__slots") - F.col("__have")).withColumn("place", F.col("place") + F.col("__have"))
    return first.select(*rows.columns, "place").unionByName(more.select(*rows.columns, F.col("place").cast("int").alias("place")))


@dataclass(frozen=True)
class Bonus:
    """What a row gains: for each of its codes that nothing chosen has, for the first of a group, for the first of a bucket."""

    code: int = 15
    group: int = 30
    bucket: int = 20


def representatives(rows: DataFrame, ident: str, score: str, group: str, cluster: str, bucket: str, codes: str, start: str, end: str, budget: int, most_of_cluster: int = 3, overlap: float = 3.0, bonus: Bonus | None = None) -> DataFrame:
    """Up to `budget` rows of the whole table with place and gain: each time the row with the highest score and bonus, of equals the
    largest ident, whose group, bucket (an equal share of the budget each, rounded up) and cluster have places left, and whose window does not
    overlap a chosen one of its group by more than `overlap`. The budget is a report's length; chosen rows (budget at most) are the only ones
    that come to the driver, as the conditions of the next round."""
    gain = bonus or Bonus()
    sizes = rows.agg(F.count_distinct(group).alias("g"), F.count_distinct(bucket).alias("b")).first()
    per_group, per_bucket = (max(1, -(-budget // max(1, n))) for n in (sizes.g, sizes.b))
    left = cut(rows.select(ident, score, group, cluster, bucket, codes, start, end))
    chosen: list = []
    out = []
    for place in range(1, budget + 1):
        groups, clusters, buckets = ([r[c] for r in chosen] for c in (group, cluster, bucket))
        full = lambda names, most: [n for n in set(names) if names.count(n) >= most]
        free = ~F.col(group).isin(full(groups, per_group)) & ~F.col(bucket).isin(full(buckets, per_bucket)) & ~F.col(cluster).isin(full(clusters, most_of_cluster)) & ~F.col(ident).isin([r[ident] for r in chosen])
        for r in chosen:
            free = free & ~((F.col(group) == r[group]) & (F.least(F.lit(r[end]), F.col(end)) - F.greatest(F.lit(r[start]), F.col(start)) > overlap))
        known = sorted({c for r in chosen for c in r[codes] or ()})
        new = F.size(F.array_except(codes, F.array(*map(F.lit, known)).cast("array<string>")))
        total = F.col(score) + gain.code * new + F.when(F.col(group).isin(groups), 0).otherwise(gain.group) + F.when(F.col(bucket).isin(buckets), 0).otherwise(gain.bucket)
        best = left.filter(free).select("*", total.alias("__gain")).orderBy(F.desc("__gain"), F.desc(ident)).first()
        if best is None:
            break
        chosen.append(best)
        out.append((best[ident], place, float(best["__gain"])))
    return rows.sparkSession.createDataFrame(out, f"{ident} {rows.schema[ident].dataType.simpleString()}, place int, gain double")
