"""Operators on time-ordered rows: sessions, islands, interval unions, as-of and interval joins, change detection.

Times are integers (microseconds or seconds), so comparisons and RANGE frames are exact. Every operator partitions by
`keys`; rows of one key meet in one task, sorted by Spark with spilling, and nothing is gathered into arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import free_of, grouped_fold

Keys = Sequence[str]


def _by(keys: Keys, *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def sessionize(rows: DataFrame, keys: Keys, time: str, gap: int, tie: str, out: str = "session") -> DataFrame:
    """Number rows' sessions from 1: a new one begins where the step from the row before exceeds gap."""
    order = _by(keys, time, tie)
    step = F.col(time) - F.lag(time).over(order)
    begins = F.when(step.isNull() | (step > gap), 1).otherwise(0)
    return rows.withColumn("__b", begins).withColumn(out, F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def session_bounds(rows: DataFrame, keys: Keys, time: str, gap: int, tie: str) -> DataFrame:
    return sessionize(rows, keys, time, gap, tie).groupBy(*keys, "session").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


def islands(rows: DataFrame, keys: Keys, place: str) -> DataFrame:
    """Runs [lo, hi) of consecutive integers among the distinct places of each key."""
    distinct = rows.select(*keys, place).distinct()
    run = F.col(place) - F.row_number().over(_by(keys, place))
    return distinct.withColumn("__r", run).groupBy(*keys, "__r").agg(F.min(place).alias("lo"), (F.max(place) + 1).alias("hi")).drop("__r")


def interval_union(rows: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Merged intervals: touching and overlapping ones become one."""
    order = _by(keys, start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    run = F.sum("__b").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, start, end).withColumn("__b", begins).withColumn("__r", run).groupBy(*keys, "__r").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__r")


def coverage(rows: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """Length that the intervals of each key cover together, and their hull."""
    union = interval_union(rows, keys, start, end)
    return union.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.min(start).alias("first"), F.max(end).alias("last"))


def coverage_gaps(rows: DataFrame, keys: Keys, start: str, end: str, least: int) -> DataFrame:
    """Gaps of at least `least` between merged intervals."""
    union = interval_union(rows, keys, start, end)
    following = F.lead(start).over(_by(keys, start))
    return union.select(*keys, F.col(end).alias("gap_start"), following.alias("gap_end")).filter(F.col("gap_end") - F.col("gap_start") >= least)


def asof_backward(left: DataFrame, right: DataFrame, keys: Keys, time: str, value: str, tolerance: int | None = None) -> DataFrame:
    """left with the latest right row at or before its time (of equal times the largest value): `value` and `matched`, null beyond tolerance."""
    latest = right.groupBy(*keys, time).agg(F.max(value).alias("__v"))
    both = left.withColumns({"__k": F.lit(1), "__v": F.lit(None).cast(latest.schema["__v"].dataType)}).unionByName(latest.withColumn("__k", F.lit(0)), allowMissingColumns=True)
    order = _by(keys, time, "__k").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("__k") == 0, F.struct(F.col(time).alias("t"), F.col("__v").alias("v"))), ignorenulls=True).over(order)
    out = both.withColumn("__f", found).filter("__k = 1")
    near = F.lit(True) if tolerance is None else F.col(time) - F.col("__f.t") <= tolerance
    return out.select(*left.columns, F.when(near, F.col("__f.t")).alias("matched"), F.when(near, F.col("__f.v")).alias(value))


def asof_stable(left: DataFrame, right: DataFrame, keys: Keys, time: str, value: str, hold: int) -> DataFrame:
    """The latest value at or before each left row; valid if the next reading is equal, else for `hold` only."""
    order = _by(keys, time)
    readings = right.groupBy(*keys, time).agg(F.max(value).alias(value))
    readings = readings.select(*keys, time, F.struct(F.col(value).alias("v"), (F.lead(value).over(order)).alias("next")).alias("r"))
    out = asof_backward(left, readings, keys, time, "r")
    known = (F.col("r.v") == F.col("r.next")) | (F.col(time) - F.col("matched") <= hold)
    return out.select(*left.columns, F.when(known, F.col("r.v")).alias(value))


def interval_join(points: DataFrame, intervals: DataFrame, keys: Keys, time: str, start: str, end: str, bucket: int, closed: bool = True) -> DataFrame:
    """Points with the intervals that contain them. Both sides are bucketed on time, so the join is an equi-join with a
    residual; bucket should be near the usual interval length."""
    spread = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    within = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end)))
    return points.withColumn("__b", F.floor(F.col(time) / bucket)).join(spread, [*keys, "__b"]).filter(within).drop("__b")


def overlap_join(a: DataFrame, b: DataFrame, keys: Keys, bucket: int, a_start: str, a_end: str, b_start: str, b_end: str) -> DataFrame:
    """Pairs of closed intervals that overlap; each pair once, in the first bucket that both cover."""
    spread = lambda rows, s, e: rows.withColumn("__b", F.explode(F.sequence(F.floor(F.col(s) / bucket), F.floor(F.col(e) / bucket))))
    joined = spread(a, a_start, a_end).join(spread(b, b_start, b_end), [*keys, "__b"])
    first = F.col("__b") == F.floor(F.greatest(a_start, b_start) / bucket)
    return joined.filter((F.col(a_start) <= F.col(b_end)) & (F.col(a_end) >= F.col(b_start)) & first).drop("__b")


def change_points(rows: DataFrame, keys: Keys, order: Sequence[str], state: Sequence[str], usable: Column | None = None) -> DataFrame:
    """Rows whose state differs from that of the row before. Rows that aren't usable give nothing and reset the state."""
    usable = F.lit(True) if usable is None else usable
    window = _by(keys, *order)
    rows = rows.withColumn("__u", F.coalesce(usable, F.lit(False))).withColumn("__s", F.struct(*state))
    same = F.lag("__u").over(window) & (F.lag("__s").over(window).eqNullSafe(F.col("__s")))
    return rows.withColumn("__same", F.coalesce(same, F.lit(False))).filter("__u AND NOT __same").drop("__u", "__s", "__same")


def state_flips(rows: DataFrame, keys: Keys, order: Sequence[str], flag: Column) -> DataFrame:
    """Rows whose flag differs from the last known one: `flip` up or down."""
    window = _by(keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__f", flag).withColumn("__p", F.last("__f", ignorenulls=True).over(window))
    return rows.filter("__f <> __p").withColumn("flip", F.when(F.col("__f"), "up").otherwise("down")).drop("__f", "__p")


def repeat_suppressed(rows: DataFrame, keys: Keys, time: str, tie: str, quiet: int) -> DataFrame:
    """Rows whose key was not seen in the `quiet` before."""
    before = F.lag(time).over(_by(keys, time, tie))
    return rows.withColumn("__p", before).filter(F.col("__p").isNull() | (F.col(time) - F.col("__p") > quiet)).drop("__p")


def multiplicity_arrivals(counts: DataFrame, keys: Keys, time: str, count: str, trailing: int) -> DataFrame:
    """How far each count rises above the largest of the trailing range before it: `arrived`."""
    window = Window.partitionBy(*keys).orderBy(time).rangeBetween(-trailing, -1)
    rise = F.col(count) - F.coalesce(F.max(count).over(window), F.lit(0))
    return counts.withColumn("arrived", F.greatest(rise, F.lit(0))).filter("arrived > 0")


def classify_steps(rows: DataFrame, keys: Keys, order: Sequence[str], value: str, cases: Sequence[tuple[str, Column]], other: str) -> DataFrame:
    """Each row with a known value and one before: `kind`, the first case that holds of `before` and the value."""
    window = _by(keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.filter(F.col(value).isNotNull()).withColumn("before", F.last(value, ignorenulls=True).over(window)).filter("before IS NOT NULL")
    kind = F.when(cases[0][1], cases[0][0])
    for name, condition in cases[1:]:
        kind = kind.when(condition, name)
    return rows.withColumn("kind", kind.otherwise(other))


def first_after_pause(rows: DataFrame, keys: Keys, time: str, tie: str, pause: int) -> DataFrame:
    return repeat_suppressed(rows, keys, time, tie, pause)


def confirmed_by_neighbour(rows: DataFrame, keys: Keys, time: str, tie: str, value: str, within: int) -> DataFrame:
    """Readings whose previous or next reading is equal and at most `within` away."""
    order = _by(keys, time, tie)
    back = (F.lag(value).over(order) == F.col(value)) & (F.col(time) - F.lag(time).over(order) <= within)
    ahead = (F.lead(value).over(order) == F.col(value)) & (F.lead(time).over(order) - F.col(time) <= within)
    return rows.filter(F.col(value).isNotNull()).withColumn("__c", F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))).filter("__c").drop("__c")


def held_drops(rows: DataFrame, keys: Keys, order: Sequence[str], value: str, frames: int) -> DataFrame:
    """Rows whose value is below the one before and no higher for `frames` rows on."""
    window = _by(keys, *order)
    drop = F.lag(value).over(window) > F.col(value)
    for k in range(1, frames):
        drop &= F.lead(value, k).over(window) <= F.col(value)
    return rows.withColumn("__d", F.coalesce(drop, F.lit(False))).filter("__d").drop("__d")


def pattern3(rows: DataFrame, keys: Keys, order: Sequence[str], kind: str, pattern: tuple[str, str, str]) -> DataFrame:
    """Rows that begin the pattern of three kinds in a row."""
    window = _by(keys, *order)
    hit = (F.col(kind) == pattern[0]) & (F.lead(kind, 1).over(window) == pattern[1]) & (F.lead(kind, 2).over(window) == pattern[2])
    return rows.withColumn("__h", F.coalesce(hit, F.lit(False))).filter("__h").drop("__h")


def bracket_fill(rows: DataFrame, keys: Keys, time: str, tie: str, value: str, most: int) -> DataFrame:
    """Unknown values between equal known ones, at most `most` apart, take that value: `filled`."""
    order = _by(keys, time, tie)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(time).alias("t")))
    rows = rows.withColumn("__k", known)
    rows = rows.withColumn("__b", F.last("__k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__a", F.first("__k", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    agree = (F.col("__b.v") == F.col("__a.v")) & (F.col("__a.t") - F.col("__b.t") <= most)
    return rows.withColumn("filled", F.coalesce(F.col(value), F.when(agree, F.col("__b.v")))).drop("__k", "__a", "__b")


def trailing_median(rows: DataFrame, keys: Keys, row_id: str, time: str, value: str, trailing: int) -> DataFrame:
    """Median of the values in the range [time - trailing, time] of each row, by a bucketed self join."""
    probe = rows.select(*keys, row_id, F.col(time).alias("__t"), F.explode(F.array_distinct(F.array(F.floor(F.col(time) / trailing), F.floor(F.col(time) / trailing) - 1))).alias("__b"))
    build = rows.select(*keys, F.col(time).alias("__u"), F.col(value).alias("__v"), F.floor(F.col(time) / trailing).alias("__b"))
    near = probe.join(build, [*keys, "__b"]).filter((F.col("__u") <= F.col("__t")) & (F.col("__u") >= F.col("__t") - trailing))
    return near.groupBy(*keys, row_id).agg(F.median("__v").alias("median"), F.count("*").alias("n"))


def next_of_kind(rows: DataFrame, keys: Keys, order: Sequence[str], kind: str, of: str, following: Sequence[str], take: str) -> DataFrame:
    """Rows of one kind with `take` of the first later row of the following kinds: `next`."""
    window = _by(keys, *order).rowsBetween(1, Window.unboundedFollowing)
    ahead = F.first(F.when(F.col(kind).isin(*following), F.col(take)), ignorenulls=True).over(window)
    return rows.withColumn("next", ahead).filter(F.col(kind) == of)


def nearest(left: DataFrame, right: DataFrame, keys: Keys, left_id: str, time: str, right_id: str, within: int) -> DataFrame:
    """The right row nearest in time to each left row, at most `within` away; ties to the smaller id."""
    a = left.select(*keys, left_id, F.col(time).alias("__t"), F.explode(F.sequence(F.floor((F.col(time) - within) / within), F.floor((F.col(time) + within) / within))).alias("__b"))
    b = right.select(*keys, F.col(right_id).alias("__id"), F.col(time).alias("__u"), F.floor(F.col(time) / within).alias("__b"))
    pairs = a.join(b, [*keys, "__b"]).withColumn("distance", F.abs(F.col("__u") - F.col("__t"))).filter(F.col("distance") <= within)
    best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct("distance", "__id")).alias("m"))
    return best.select(*keys, left_id, F.col("m.__id").alias("nearest"), F.col("m.distance").alias("distance"))


def mutually_unique(left: DataFrame, right: DataFrame, keys: Keys, left_id: str, right_id: str, time: str, within: int) -> DataFrame:
    """Pairs within the distance in time where neither side has another candidate."""
    a = left.select(*keys, F.col(left_id).alias("left_id"), F.col(time).alias("__t"), F.explode(F.sequence(F.floor((F.col(time) - within) / within), F.floor((F.col(time) + within) / within))).alias("__b"))
    b = right.select(*keys, F.col(right_id).alias("right_id"), F.col(time).alias("__u"), F.floor(F.col(time) / within).alias("__b"))
    pairs = a.join(b, [*keys, "__b"]).filter(F.abs(F.col("__u") - F.col("__t")) <= within)
    n = lambda side: F.count("*").over(Window.partitionBy(*keys, side))
    return pairs.withColumns({"__l": n("left_id"), "__r": n("right_id")}).filter("__l = 1 AND __r = 1").select(*keys, "left_id", "right_id")


def segments(rows: DataFrame, keys: Keys, order: Sequence[str], breaks: Column, out: str = "segment") -> DataFrame:
    """Number segments from 0; a row where breaks holds begins a new one."""
    window = _by(keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__b", F.when(breaks, 1).otherwise(0)).withColumn(out, F.sum("__b").over(window)).drop("__b")


def spine(bounds: DataFrame, keys: Keys, first: str, last: str, out: str) -> DataFrame:
    """One row per integer from first to last."""
    return bounds.select(*keys, F.explode(F.sequence(first, last)).alias(out))


def added_if_free(existing: DataFrame, added: DataFrame, keys: Keys, ident: str, start: str, end: str, slack: int, bucket: int, key_schema: str) -> DataFrame:
    """keys and ident of the added brackets that lie farther than `slack` from every existing one of their key, and from every added one that was taken before
    them (in order of start, then ident)."""
    wide = existing.select(*keys, (F.col(start) - slack).alias("__s"), (F.col(end) + slack).alias("__f"))
    met = overlap_join(added, wide, keys, bucket, start, end, "__s", "__f").select(*keys, ident).distinct()
    left = added.join(met, [*keys, ident], "left_anti")
    return grouped_fold(left, list(keys), [start, ident], [ident, start, end], free_of(slack), f"{key_schema}, {ident} long")


def fused_sources(first: DataFrame, second: DataFrame, keys: Keys, ident: str, time: str, confidence: str, attributes: str, within: int, tolerance: float, prefer_first: bool, bucket: int) -> DataFrame:
    """keys, ident, source (1 or 2), confidence, members and resolved of the events of two sources; keys name kind and actor too. An event of the second source belongs to
    the earliest of the first source's at most `within` from it; events of one source are never one. The surest member stands for its event (of equals the preferred
    source's, then the earlier), unless the next one differs in attributes and is less than `tolerance` less sure: such an event is not resolved."""
    columns = [*keys, F.col(ident).alias("__i"), F.col(time).alias("__t"), F.col(confidence).alias("__c"), F.col(attributes).alias("__a")]
    one, two = first.select(*columns, F.lit(1).alias("__n")), second.select(*columns, F.lit(2).alias("__n"))
    heads = first.select(*keys, F.col(ident).alias("__head"), F.col(time).alias("__ht"), (F.col(time) - within).alias("__lo"), (F.col(time) + within).alias("__hi"))
    met = interval_join(two, heads, keys, "__t", "__lo", "__hi", bucket).groupBy(*keys, "__i").agg(F.min(F.struct("__ht", "__head")).alias("__m"))
    joined = two.join(met.select(*keys, "__i", F.col("__m.__head").alias("__head")), [*keys, "__i"], "left")
    rows = one.withColumn("__head", F.col("__i")).unionByName(joined)
    alone = F.when(F.col("__head").isNull(), F.struct(F.lit(2).alias("s"), F.col("__i").alias("i"))).otherwise(F.struct(F.lit(1).alias("s"), F.col("__head").alias("i")))
    group = Window.partitionBy(*keys, "__g")
    order = group.orderBy(F.desc("__c"), F.desc(F.col("__n") == (1 if prefer_first else 2)), "__t", "__i")
    ranked = rows.withColumn("__g", alone).withColumn("__place", F.row_number().over(order)).withColumn("members", F.count(F.lit(1)).over(group))
    ranked = ranked.withColumn("__next", F.lead(F.struct("__c", "__a")).over(order)).filter(F.col("__place") == 1)
    doubt = ~F.col("__a").eqNullSafe(F.col("__next.__a")) & (F.col("__c") - F.col("__next.__c") < tolerance)
    return ranked.select(*keys, F.col("__i").alias(ident), F.col("__n").alias("source"), F.col("__c").alias(confidence), "members", (~F.coalesce(F.col("__next").isNotNull() & doubt, F.lit(False))).alias("resolved"))
