"""Nearest anchors through grid cells of growing size, for anchors and points of any number.

Points (id, x, y) and anchors (anchor, ax, ay) meet in cells. A round looks at the block of three by three cells about a point; what
lies nearer than the block's border is known then. Only points whose k-th anchor lies beyond that border go on, with cells of twice
the size, so that rounds grow with the logarithm of the distances. Points of one place have the same anchors, so places go through the
rounds and points come back at the end; of the anchors of one place only those go along that can be an answer. The first cells are halved
until anchors share them with few others, so that more anchors mean smaller cells, not more candidates. Nothing is collected or broadcast by hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.tables import cut


def _squared(x: str, y: str, ax: str, ay: str) -> Column:
    return (F.col(x) - F.col(ax)) * (F.col(x) - F.col(ax)) + (F.col(y) - F.col(ay)) * (F.col(y) - F.col(ay))


def _finite(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def _start(known: DataFrame, cell: float, few: int, halvings: int = 24) -> int:
    """How often cell is to be halved until an anchor has `few` anchors or less in its cell, itself included, on average."""
    side = lambda c: F.floor(F.col(c) / (F.lit(cell) / F.pow(F.lit(2.0), "level")))
    levels = known.select("ax", "ay", F.explode(F.sequence(F.lit(0), F.lit(halvings))).alias("level"))
    counts = levels.groupBy("level", side("ax").alias("cx"), side("ay").alias("cy")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowds = counts.groupBy("level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd"))
    return crowds.agg(F.coalesce(F.min(F.when(F.col("crowd") <= few, F.col("level"))), F.lit(halvings)).alias("level")).first()["level"]


def _met(left: DataFrame, known: DataFrame, cell: float) -> tuple[DataFrame, Column]:
    """Places (x, y) with the anchors of the three by three cells about them and their squared distance d; and how far those cells reach."""
    own = lambda c: F.floor(F.col(c) / cell)
    around = lambda c: F.explode(F.sequence(own(c) - 1, own(c) + 1))
    spread = left.withColumn("cx", around("x")).withColumn("cy", around("y"))
    placed = known.withColumn("cx", own("ax")).withColumn("cy", own("ay"))
    # Nearer than the border: the block reaches one whole cell beyond the point's own on every side.
    border = lambda c: F.least(F.col(c) - (own(c) - 1) * cell, (own(c) + 2) * cell - F.col(c))
    return spread.join(placed, ["cx", "cy"]).withColumn("d", _squared("x", "y", "ax", "ay")), F.least(border("x"), border("y"))


def _places(points: DataFrame, *columns: str) -> DataFrame:
    """points with finite coordinates as x and y; minus zero is zero, as it is for joins."""
    return points.filter(_finite("x", "y")).select(*columns, *[(F.col(c).cast("double") + F.lit(0.0)).alias(c) for c in ("x", "y")]).distinct()


def nearest(points: DataFrame, anchors: DataFrame, point_id: str, k: int, cell: float, most: int = 60) -> DataFrame:
    """point_id, anchor, distance and rank (from 1) of each point's k nearest anchors, ties to the smaller anchor; all of them if
    there are fewer. Points and anchors with null or non-finite coordinates take no part; a repeated point or anchor counts once.
    cell: the largest first size; where anchors are dense, rounds begin with a smaller one."""
    every = anchors.filter(_finite("ax", "ay")).select("anchor", (F.col("ax").cast("double") + F.lit(0.0)).alias("ax"), (F.col("ay").cast("double") + F.lit(0.0)).alias("ay")).distinct()
    # All anchors of a place are equally far, so the k smallest are the only ones that can be among a point's k nearest.
    nth = F.row_number().over(Window.partitionBy("ax", "ay").orderBy("anchor"))
    known = cut(every.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth"))
    rows = cut(_places(points, F.col(point_id).alias("id")))
    left = cut(rows.select("x", "y").distinct())
    total = known.count()
    order = F.struct("d", "anchor")
    done: list[DataFrame] = []
    halved = _start(known, cell, 2 * k) if total else 0
    cell /= 2**halved
    for _ in range(most + halved):
        if not total or left.isEmpty():
            break
        found, safe = _met(left, known, cell)
        best = Window.partitionBy("x", "y").orderBy(order)
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        lists = ranked.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("rank", "anchor", "d"))).alias("best"))
        last = F.element_at("best", -1)["d"]
        closed = (F.size("best") >= min(k, total)) & ((last < safe * safe) | (F.size("best") >= total))
        judged = cut(left.join(lists, ["x", "y"], "left").withColumn("closed", F.coalesce(closed, F.lit(False))))
        done.append(judged.filter("closed").select("x", "y", "best"))
        left = judged.filter(~F.col("closed")).select("x", "y")
        cell *= 2
    else:
        raise ValueError(f"points without {k} anchors after {most} doublings of the cell")
    if not done:
        return rows.select(F.col("id").alias(point_id), F.lit(None).cast(known.schema["anchor"].dataType).alias("anchor"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    told = rows.join(reduce(DataFrame.unionByName, done), ["x", "y"]).select("id", F.explode("best").alias("b"))
    return told.select(F.col("id").alias(point_id), "b.anchor", F.sqrt("b.d").alias("distance"), F.col("b.rank").cast("int").alias("rank"))


def unique_nearest(points: DataFrame, anchors: DataFrame, point_id: str, radius: float, margin: float) -> DataFrame:
    """points with `label`: that of the nearest anchor (label, ax, ay; of several anchors of a label the nearest counts), if it lies
    within the radius less the margin and every other label's anchor is farther by more than twice the margin; else null."""
    reach = max(radius + margin, margin)
    known = cut(anchors.filter(_finite("ax", "ay") & F.col("label").isNotNull()).select("label", "ax", "ay").distinct())
    left = cut(_places(points))
    done: list[DataFrame] = []
    cell = reach if known.isEmpty() else reach / 2 ** _start(known, reach, 4)
    order = Window.partitionBy("x", "y").orderBy("d", "label")
    while not left.isEmpty():
        found, safe = _met(left, known, cell)
        by_label = found.groupBy("x", "y", "label").agg(F.sqrt(F.min("d")).alias("d"))
        first = by_label.withColumn("next", F.lead("d").over(order)).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")
        # Known once nothing beyond the block can be the nearest or within twice the margin of it. With blocks that reach radius + margin all is: a
        # label farther than that can't be within twice the margin of one that is nearer than radius - margin.
        beyond = (F.col("d") < safe) & ((F.col("d") + margin > radius) | (F.col("next") - F.col("d") <= 2 * margin) | (safe - F.col("d") > 2 * margin))
        closed = F.lit(cell >= reach) | F.coalesce(beyond, F.lit(False))
        sure = (F.col("d") + margin <= radius) & (F.col("next").isNull() | (F.col("next") - F.col("d") > 2 * margin))
        judged = cut(left.join(first, ["x", "y"], "left").select("x", "y", F.when(sure, F.col("label")).alias("label"), closed.alias("closed")))
        done.append(judged.filter(F.col("closed") & F.col("label").isNotNull()).select("x", "y", "label"))
        left = judged.filter(~F.col("closed")).select("x", "y")
        cell = min(2 * cell, reach)
    if not done:
        return points.withColumn("label", F.lit(None).cast(known.schema["label"].dataType))
    told = reduce(DataFrame.unionByName, done).select(F.col("x").alias("__x"), F.col("y").alias("__y"), "label")
    same = (F.col("x").cast("double") == F.col("__x")) & (F.col("y").cast("double") == F.col("__y"))
    return points.join(told, same, "left").select(*points.columns, "label")
