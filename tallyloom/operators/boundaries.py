"""Boundaries of rounds promoted from candidates, with every gate, or from two observed states, or not at all.

seconds: keys, second (whole, one row each), value (of the round's phase), status (OBSERVED, INFERRED, UNKNOWN) and number (or null). transitions: keys, id, kind, lower and upper (seconds), before, after
and membership (numbers, or null). rounds: keys, number, low and high (the seconds in which a boundary may lie), first and last (of the round's own stretch). A boundary is told only if one candidate is left; two that are apart
are competing evidence. Everything is windows and equi-joins by key and second."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import interval_join


@dataclass(frozen=True)
class Gates:
    """kind: of transitions. before, after: the values on both sides. bracket: the widest, in seconds. lookup: seconds in which a side's value must be seen. merge: how far apart candidates may be and still be one.
    quiet: seconds after a start in which `before` must not be observed again (null: an end, which asks instead for play before it and for no other round between its stretch and itself)."""

    kind: str
    before: str
    after: str
    bracket: float
    lookup: int
    merge: float
    quiet: int | None
    play: str = "ACTIVE"
    preparation: str = "BUY"


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(i).eqNullSafe(F.col(j)) for i, j in zip(a, b, strict=True)])


def _other(number: Column, own: Column) -> Column:
    return number.isNotNull() & (number != own)


def judged_candidates(seconds: DataFrame, transitions: DataFrame, rounds: DataFrame, keys: Sequence[str], gates: Gates, bucket: int = 64) -> DataFrame:
    """keys, number, id, lower, upper, bracket and reason (null: admitted) of every candidate of every round; the reason is the first gate that it fails."""
    keys = list(keys)
    points = transitions.filter(F.col("kind") == gates.kind).withColumns({"up": F.floor("upper"), "down": F.floor("lower"), "bracket": F.col("upper") - F.col("lower")})
    mine = interval_join(points, rounds.filter("low <= high"), keys, "up", "low", "high", bucket)
    mine = mine.filter(F.col("membership").isNull() | (F.size("membership") == 0) | F.array_contains("membership", F.col("number")))
    order = Window.partitionBy(*keys).orderBy("second")
    ahead, back = order.rangeBetween(0, gates.lookup), order.rangeBetween(-gates.lookup, 0)
    seen = F.when(F.col("status") == "OBSERVED", F.struct("value", F.col("number").alias("of")))
    ended = F.when((F.col("value") == gates.after) & (F.col("status") != "UNKNOWN"), F.struct("value", F.col("number").alias("of")))
    looks = seconds.select(*keys, "second", F.first(seen, ignorenulls=True).over(ahead).alias("ahead"), F.last(seen, ignorenulls=True).over(back).alias("back"), F.first(ended, ignorenulls=True).over(ahead).alias("ended"))
    sides = mine.join(looks.select(*keys, F.col("second").alias("up"), "ahead", "ended"), [*keys, "up"], "left").join(looks.select(*keys, F.col("second").alias("down"), "back"), [*keys, "down"], "left")
    own = F.col("number")
    wide = F.when(F.col("bracket") > gates.bracket, "bracket_too_wide")
    turned = lambda c, wanted: F.coalesce(F.col(c) != wanted, F.lit(False))
    if gates.quiet is not None:
        again = seconds.filter((F.col("value") == gates.before) & (F.col("status") == "OBSERVED")).select(*keys, F.col("second").alias("__s"), F.col("number").alias("__n"))
        later = sides.select(*keys, "id", "number", F.explode(F.sequence(F.col("up") + 1, F.col("up") + gates.quiet)).alias("__s")) if gates.quiet else sides.select(*keys, "id", "number", F.col("up").alias("__s")).limit(0)
        bad = later.join(again, [*keys, "__s"]).filter(~_other(F.col("__n"), own)).select(*keys, "id", "number", F.lit(True).alias("__again")).distinct()
        rows = sides.join(bad, [*keys, "id", "number"], "left")
        reasons = [
            wide, F.when(turned("after", gates.after) | turned("before", gates.before), "not_from_before_to_after"),
            F.when(F.col("ahead").isNull() | F.col("back").isNull() | (F.col("ahead.value") != gates.after) | (F.col("back.value") != gates.before), "phase_not_corroborated"),
            F.when(F.col("__again"), "before_observed_after"), F.when(_other(F.col("back.of"), own) | _other(F.col("ahead.of"), own), "round_number_mismatch"),
        ]
    else:
        foreign = seconds.select(*keys, "second", F.col("number").alias("__n"), ((F.col("value") == gates.preparation) & (F.col("status") == "OBSERVED")).alias("__prepares"))
        between = sides.select(*keys, "id", "number", F.greatest(F.lit(0), F.col("last")).alias("__lo"), F.greatest(F.lit(0), F.col("down")).alias("__hi")).filter("__lo < __hi")
        gap = interval_join(foreign, between, keys, "second", "__lo", "__hi", bucket, closed=False).filter(_other(F.col("__n"), own) | F.col("__prepares")).select(*keys, "id", "number", F.lit(True).alias("__gap")).distinct()
        played = seconds.filter((F.col("value") == gates.play) & (F.col("status") != "UNKNOWN")).select(*keys, "second")
        stretch = sides.select(*keys, "id", "number", F.col("first").alias("__lo"), F.col("up").alias("__hi")).filter("__lo < __hi")
        play = interval_join(played, stretch, keys, "second", "__lo", "__hi", bucket, closed=False).select(*keys, "id", "number", F.lit(True).alias("__play")).distinct()
        rows = sides.join(gap, [*keys, "id", "number"], "left").join(play, [*keys, "id", "number"], "left")
        reasons = [
            wide, F.when(turned("after", gates.after), "not_to_after"), F.when(F.col("ended").isNull(), "phase_not_corroborated"), F.when(_other(F.col("ended.of"), own), "round_number_mismatch"),
            F.when(F.col("__gap"), "other_round_in_gap"), F.when(F.col("__play").isNull(), "no_play_before"),
        ]
    return rows.select(*keys, "number", "id", "lower", "upper", "bracket", F.coalesce(*reasons).alias("reason"))


def state_pairs(seconds: DataFrame, rounds: DataFrame, keys: Sequence[str], gates: Gates, bucket: int = 64) -> DataFrame:
    """keys, number, lower, upper: every step from an observed `before` to an observed `after` in a round's seconds with only unresolved or inferred `before` ones between, at most `bracket` apart, of which one side
    at least reads the round's number and none another."""
    keys = list(keys)
    inside = interval_join(seconds.withColumnRenamed("number", "__n"), rounds.filter("low <= high"), keys, "second", "low", "high", bucket)
    observed = F.col("status") == "OBSERVED"
    mark = F.when(observed & (F.col("value") == gates.before), "before").when(observed & (F.col("value") == gates.after), "after").when(~F.col("value").isin("UNKNOWN", gates.before), "other")
    marked = inside.withColumn("__mark", mark).filter(F.col("__mark").isNotNull())
    last = F.lag(F.struct("__mark", "second", "__n")).over(Window.partitionBy(*keys, "number").orderBy("second"))
    steps = marked.withColumn("__last", last).filter((F.col("__mark") == "after") & (F.col("__last.__mark") == "before") & (F.col("second") - F.col("__last.second") <= gates.bracket))
    own, a, b = F.col("number"), F.col("__last.__n"), F.col("__n")
    fits = ~_other(a, own) & ~_other(b, own) & (F.coalesce(a == own, F.lit(False)) | F.coalesce(b == own, F.lit(False)))
    return steps.filter(fits).select(*keys, "number", F.col("__last.second").alias("lower"), F.col("second").alias("upper"))


def promoted(seconds: DataFrame, transitions: DataFrame, rounds: DataFrame, keys: Sequence[str], gates: Gates) -> DataFrame:
    """keys, number, time, lower, upper, id, basis (`transition`, `state_pair`, or null: none) and abstained (why none) of every round. State pairs count only for rounds without any candidate."""
    keys = list(keys)
    judged = judged_candidates(seconds, transitions, rounds, keys, gates)
    admitted = F.col("reason").isNull()
    found = judged.groupBy(*keys, "number").agg(F.count(F.lit(1)).alias("__all"), F.min(F.when(admitted, F.struct("upper", "bracket", "lower", "id"))).alias("__first"), F.max(F.when(admitted, F.col("upper"))).alias("__last"))
    pairs = state_pairs(seconds, rounds, keys, gates).groupBy(*keys, "number").agg(F.count(F.lit(1)).alias("__pairs"), F.min(F.struct("upper", "lower")).alias("__pair"))
    renamed = lambda df: df.select(*[F.col(c).alias(f"r_{c}") if c in (*keys, "number") else F.col(c) for c in df.columns])
    names = [*keys, "number"]
    own = rounds.select(*names).distinct()
    rows = own.join(renamed(found), _same(names, [f"r_{c}" for c in names]), "left").drop(*[f"r_{c}" for c in names]).join(renamed(pairs), _same(names, [f"r_{c}" for c in names]), "left")
    competing = F.col("__last") - F.col("__first.upper") > gates.merge
    by_candidate = F.col("__first").isNotNull() & ~F.coalesce(competing, F.lit(False))
    by_pair = F.col("__all").isNull() & (F.col("__pairs") == 1)
    pick = lambda c, p: F.when(by_candidate, c).when(by_pair, p)
    why = F.when(by_candidate | by_pair, None).when(F.coalesce(competing, F.lit(False)), "competing_candidates").when(F.col("__all").isNull() & (F.col("__pairs") > 1), "competing_state_pairs").otherwise("no_admitted_candidate")
    return rows.select(
        *names, pick(F.floor("__first.upper"), F.col("__pair.upper")).cast("long").alias("time"), pick(F.col("__first.lower"), F.col("__pair.lower").cast("double")).alias("lower"), pick(F.col("__first.upper"), F.col("__pair.upper").cast("double")).alias("upper"),
        F.when(by_candidate, F.col("__first.id")).alias("id"), F.when(by_candidate, "transition").when(by_pair, "state_pair").alias("basis"), why.alias("abstained"),
    )
