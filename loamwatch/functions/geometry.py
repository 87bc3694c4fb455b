"""Plane geometry as column expressions on rings (array of struct<x, y>), one metric reference system.

Point in ring: half-open even-odd rule (an edge counts if exactly one end lies above the point), so points on a
left or lower edge are inside and those on a right or upper edge outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rectangle(minx, miny, maxx, maxy) -> Column:
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy))


def edges(ring: Column) -> Column:
    """(x1, y1, x2, y2) of each edge; the ring closes itself."""
    behind = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.zip_with(ring, behind, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    safe = F.filter(edges(ring), lambda e: e["y1"] != e["y2"])
    return F.size(F.filter(safe, crossed)) % 2 == 1


def area(ring: Column) -> Column:
    """Shoelace area."""
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def edge_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the ring's line."""

    def far(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.greatest(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))

    return F.array_min(F.transform(edges(ring), far))


def bounds(ring: Column) -> dict[str, Column]:
    side = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return {"minx": side(F.array_min, "x"), "miny": side(F.array_min, "y"), "maxx": side(F.array_max, "x"), "maxy": side(F.array_max, "y")}


def with_bounds(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    return polygons.withColumns(bounds(F.col(ring)))


def within(inner: Column, outer: Column) -> Column:
    """All vertices of a ring in a convex ring, borders included."""
    return F.forall(inner, lambda p: contains(outer, p["x"], p["y"]) | (edge_distance(outer, p["x"], p["y"]) == 0))
