"""Spatial joins: equi-joins on a grid cell, then the exact test.

Catalyst would plan a nested loop for a box predicate. Points have one cell each; polygons are covered by inner and
edge cells (see ``covering``), small rings by the cells that their boxes touch, and the exact predicate runs on what
shares a cell.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.functions import geometry as G
from loamwatch.operators import covering as C


def cells_of(polygons: DataFrame, size: float) -> DataFrame:
    """One row for each grid cell that a polygon's box touches."""
    at = lambda c: F.floor(F.col(c) / size)
    wide = G.with_bounds(polygons)
    return wide.withColumn("cx", F.explode(F.sequence(at("minx"), at("maxx")))).withColumn("cy", F.explode(F.sequence(at("miny"), at("maxy"))))


def point_pairs(points: DataFrame, polygons: DataFrame, size: float, x: str = "x", y: str = "y", border: float | None = None) -> DataFrame:
    """Points with the polygons that contain them (inner; a point may be in several), without the rings.

    Polygons have ``ring``, or ``rings`` with holes or parts. With ``border`` a column of that name tells whether the
    point is less than so far from the polygon's line. What meets the points are cells with their own edges alone.
    """
    p = points.withColumn("cx", F.floor(F.col(x) / size)).withColumn("cy", F.floor(F.col(y) / size))
    cells = C.covering(polygons, size, border or 0.0).withColumnsRenamed({"base": "_base", "edges": "_edges"})
    at = [F.col(c).cast("double") for c in (x, y)]
    hit = p.join(cells, ["cx", "cy"]).where(C.inside(F.col("_base"), F.col("_edges"), *at, F.col("cx"), size))
    if border is not None:
        hit = hit.withColumn("border", C.near(F.col("_edges"), *at, border))
    return hit.drop("cx", "cy", "_base", "_edges")


def in_region(points: DataFrame, polygons: DataFrame, key: list[str], size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points in any of the polygons (semi-join)."""
    hit = point_pairs(points.select(*key, x, y) if {x, y}.isdisjoint(key) else points.select(*key), _shapes(polygons), size, x, y)
    return points.join(hit.select(*key).distinct(), key, "left_semi")


def attributes_at(points: DataFrame, polygons: DataFrame, fields: list[str], key: list[str], size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Points with the fields of each polygon that contains them; points in none are kept with nulls."""
    hit = point_pairs(points.select(*key), _shapes(polygons, *fields), size, x, y).select(*key, *fields)
    return points.join(hit, key, "left")


def _shapes(polygons: DataFrame, *fields: str) -> DataFrame:
    return polygons.select("rings" if "rings" in polygons.columns else "ring", *fields)


def rings_within(inner: DataFrame, outer: DataFrame, size: float, inner_key: str, outer_key: str) -> DataFrame:
    """(inner_key, outer_key) of rings that lie within convex rings of the other table."""
    a = cells_of(inner.select(inner_key, F.col("ring")), size).groupBy(inner_key).agg(F.first("ring").alias("ring"), F.min("cx").alias("cx"), F.min("cy").alias("cy"))
    b = cells_of(outer.select(outer_key, F.col("ring").alias("ring")), size).select(outer_key, F.col("ring").alias("outer"), "cx", "cy")
    return a.join(b, ["cx", "cy"]).where(G.within(F.col("ring"), F.col("outer"))).select(inner_key, outer_key)


def assign_tile(boxes: DataFrame, tiles: DataFrame, size: float, key: str, tile: str = "tile") -> DataFrame:
    """Each ring with the first tile that contains it, else the first that its box meets, else null."""
    a = cells_of(boxes.select(key, "ring"), size)
    b = cells_of(tiles.select(tile, F.col("ring")), size).select(tile, F.col("ring").alias("outer"), "cx", "cy", F.col("minx").alias("ox"), F.col("miny").alias("oy"), F.col("maxx").alias("px"), F.col("maxy").alias("py"))
    met = a.join(b, ["cx", "cy"]).where((F.col("minx") <= F.col("px")) & (F.col("maxx") >= F.col("ox")) & (F.col("miny") <= F.col("py")) & (F.col("maxy") >= F.col("oy")))
    ranked = met.select(key, tile, G.within(F.col("ring"), F.col("outer")).alias("full")).distinct()
    first = ranked.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(F.desc("full"), tile))).where("n = 1").select(key, tile)
    return boxes.join(first, key, "left")


def _meetings(a: DataFrame, b: DataFrame | None, distance: float, span: float | None) -> DataFrame:
    """Pairs of rows (id, x, y, day) in the same or touching cells of place, and of time if there is a span: (i, j, gap, days).

    Pairs within one table (b is None) come once: a row goes to its own cell and to half of the touching ones.
    """
    sides = [c for c in ("x", "y", "day") if c != "day" or span is not None]
    width = {"x": distance, "y": distance, "day": span}
    cell = {c: F.floor(F.col(c) / width[c]) for c in sides}
    steps = [s for s in product((-1, 0, 1), repeat=len(sides)) if b is not None or s >= (0,) * len(sides)]
    put = lambda t, n: t.select(F.col("id").alias(f"i{n}"), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("day").alias(f"d{n}"), *[cell[c].alias(f"c{c}") for c in sides])
    here = put(a, 1)
    moved = F.explode(F.array(*[F.struct(*[(F.col(f"c{c}") + k).alias(f"n{c}") for c, k in zip(sides, s, strict=True)], F.lit(not any(s)).alias("own")) for s in steps])).alias("_to")
    there = put(a if b is None else b, 2).select("i2", "x2", "y2", "d2", moved).select("i2", "x2", "y2", "d2", *[F.col(f"_to.n{c}").alias(f"c{c}") for c in sides], F.col("_to.own").alias("own"))
    met = here.join(there, [f"c{c}" for c in sides])
    met = met.where(F.col("i1") != F.col("i2")) if b is not None else met.where(~F.col("own") | (F.col("i1") < F.col("i2")))
    gap = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))
    return met.select(F.least("i1", "i2").alias("i"), F.greatest("i1", "i2").alias("j"), gap.alias("gap"), F.abs(F.col("d1") - F.col("d2")).alias("days"))


def neighbour_candidates(nodes: DataFrame, distance: float, theta_days: int, x: str = "x", y: str = "y") -> tuple[DataFrame, DataFrame]:
    """Pairs to be tested: of two breaks, which must be near in time too, and of a break and a segment without one."""
    n = nodes.select("id", F.col(x).alias("x"), F.col(y).alias("y"), "day", "is_break")
    breaks, others = n.where("is_break"), n.where("NOT is_break")
    return _meetings(breaks, None, distance, theta_days), _meetings(breaks, others, distance, None)


def neighbour_pairs(nodes: DataFrame, distance: float, theta_days: int, x: str = "x", y: str = "y") -> DataFrame:
    """(i, j, distance), i < j, of segments near in space and time.

    Nodes: (id, x, y, day, is_break). An edge needs exactly one break, or two breaks less than ``theta_days`` apart; the
    distance is inclusive. Breaks meet in cells of place and time, so a crowded place isn't paired over all its years; two
    segments without a break never meet.
    """
    both, one = neighbour_candidates(nodes, distance, theta_days, x, y)
    pairs = both.where(F.col("days") < theta_days).unionByName(one)
    return pairs.where(F.col("gap") <= distance).select("i", "j", F.col("gap").alias("distance"))
