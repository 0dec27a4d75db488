"""Local rules repeated in both directions until nothing changes.

A rule looks at a row and its neighbours and gives new values. Each round applies the rules forwards, then backwards; keys without
a change in a round are done and leave, so that what is left costs. One job works several rounds, twice as many as the one before
up to SPAN, over rows that are dealt once; its result is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyloom.sources.tables import cut

#: Rounds that one job works at most.
SPAN = 8

#: new values by column, from the window over a key's rows in the direction of the pass; `lag` is the neighbour behind.
Rule = Callable[[WindowSpec], dict[str, Column]]


@dataclass(frozen=True)
class Settled:
    """rows: all rows with their final values; sizes: rows that each job worked on; done: whether all keys came to rest."""

    rows: DataFrame
    sizes: list[int]
    done: bool


def to_fixpoint(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], rules: Sequence[Rule], most: int, both: bool = True) -> Settled:
    """Rows with values changed by rules until no rule changes any, or for `most` rounds; forwards only, if not both."""
    forwards = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    backwards = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    whole = Window.partitionBy(*keys)
    before = [f"__{v}" for v in values]
    left, resting, sizes = cut(rows), [], []
    worked, span = 0, 1
    while worked < most:
        n = left.count()
        if not n:
            break
        sizes.append(n)
        span = min(span, most - worked)
        now = left
        for last in [False] * (span - 1) + [True]:
            if last:  # a key that the last round leaves as it is stays so
                now = now.withColumns({b: F.col(v) for b, v in zip(before, values, strict=True)})
            for window in (forwards, backwards) if both else (forwards,):
                for rule in rules:
                    now = now.withColumns(rule(window))
        worked, span = worked + span, min(2 * span, SPAN)
        moved = F.lit(False)
        for b, v in zip(before, values, strict=True):
            moved = moved | ~F.col(b).eqNullSafe(F.col(v))
        now = cut(now.withColumn("__moved", F.max(moved).over(whole)).drop(*before))
        resting.append(now.filter(~F.col("__moved")).drop("__moved"))
        left = now.filter("__moved").drop("__moved")
    out = left
    for part in resting:
        out = out.unionByName(part)
    return Settled(out, sizes, left.isEmpty())
