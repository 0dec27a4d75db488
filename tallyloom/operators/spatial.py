"""Points, polygons and anchors. Polygons and anchors are tables; they are joined by grid cells, so no side is broadcast
unless Spark finds it small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: is (x, y) inside the ring, an array of (x, y) structs?"""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.when(i + 2 > n, 1).otherwise(i + 2))
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, c: s + c) % 2 == 1


def boundary_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance from (x, y) to the nearest edge of the ring."""
    n = F.size(ring)

    def distance(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.when(i + 2 > n, 1).otherwise(i + 2))
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / length)))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.array_min(F.transform(F.sequence(F.lit(0), n - 1), distance))


def locate(points: DataFrame, zones: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """points (x, y, ...) with `zone`, the only zone that holds them farther than margin from its boundary; null if none or
    several do. zones: zone, ring. Both sides go by the grid cells that a zone's hull covers."""
    hull = lambda agg, c: agg(F.transform("ring", lambda p: p[c]))
    span = lambda c: F.sequence(F.floor(hull(F.array_min, c) / cell), F.floor(hull(F.array_max, c) / cell))
    spread = zones.withColumn("__cx", F.explode(span("x"))).withColumn("__cy", F.explode(span("y")))
    rows = points.withColumn("__id", F.monotonically_increasing_id())
    near = rows.withColumn("__cx", F.floor(F.col("x") / cell)).withColumn("__cy", F.floor(F.col("y") / cell)).join(spread, ["__cx", "__cy"], "left")
    held = F.when(inside(F.col("x"), F.col("y"), F.col("ring")) & (boundary_distance(F.col("x"), F.col("y"), F.col("ring")) > margin), F.col("zone"))
    others = [c for c in points.columns]
    found = near.groupBy("__id", *others).agg(F.count(held).alias("__n"), F.min(held).alias("__z"))
    return found.select(*others, F.when(F.col("__n") == 1, F.col("__z")).alias("zone"))


def unique_anchor(points: DataFrame, anchors: DataFrame, point_id: str, radius: float) -> DataFrame:
    """Points with exactly one anchor (anchor, ax, ay) within radius."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    a = points.withColumn("__cx", around("x")).withColumn("__cy", around("y"))
    b = anchors.withColumn("__cx", cell("ax")).withColumn("__cy", cell("ay"))
    near = a.join(b, ["__cx", "__cy"]).filter((F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")) <= radius * radius)
    return near.groupBy(point_id).agg(F.count("*").alias("n"), F.min("anchor").alias("anchor")).filter("n = 1").drop("n")


def nearest_anchors(points: DataFrame, anchors: DataFrame, k: int, most_anchors: int = 1_000) -> DataFrame:
    """points (x, y, ...) with `nearest`, the k nearest anchors (anchor, ax, ay) in order, ties to the smaller anchor. The
    anchors are a dimension whose size is checked; they go along as one literal array."""
    known = anchors.select("anchor", "ax", "ay").limit(most_anchors + 1).collect()
    if len(known) > most_anchors:
        raise ValueError(f"more than {most_anchors} anchors")
    squares = [F.struct(((F.col("x") - r["ax"]) * (F.col("x") - r["ax"]) + (F.col("y") - r["ay"]) * (F.col("y") - r["ay"])).alias("d"), F.lit(r["anchor"]).alias("anchor")) for r in known]
    return points.withColumn("nearest", F.transform(F.slice(F.array_sort(F.array(*squares)), 1, k), lambda s: s["anchor"]))


def to_map(x: Column, y: Column, scale_x: float, scale_y: float, shift_x: float, shift_y: float) -> tuple[Column, Column]:
    """World to map coordinates: axes swap."""
    return y * scale_x + shift_x, x * scale_y + shift_y
