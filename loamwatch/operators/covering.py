"""Coverings of polygons by grid cells: inner cells need no test, edge cells carry their own edges alone.

A polygon is a list of rings; a point is inside if the rays to its right cross the rings an odd number of times, so rings
within rings are holes. For a point of an edge cell whose right border is at xr, the rays split there:

* crossings between the point and xr belong to edges of the cell;
* the crossings beyond xr are known (``base``) at one height of the cell, its middle. They change with the height only by
  edges with one end beyond xr and one before it; chains of edges beyond xr count by their ends, which are those edges' ends.

An edge that doesn't touch the cell contributes the same at all heights of the cell, which is in ``base`` already. All crossings are
computed by one expression, so results equal the plain test over all edges bit by bit.

The rows of a polygon are its cells, and each edge stands in the cells that it touches: bytes grow with the length of
the line, not with vertices times cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamwatch.schemas import RING

EDGES = "array<struct<x1:double,y1:double,x2:double,y2:double>>"
_EDGE = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])


def _edges_of(rings: list) -> np.ndarray:
    """(x1, y1, x2, y2) of all rings, which close themselves."""
    out = [np.zeros((0, 4))]
    for ring in rings:
        if ring:
            v = np.array([(q["x"], q["y"]) for q in ring], float)
            out.append(np.hstack([v, np.roll(v, -1, axis=0)]))
    return np.concatenate(out)


def _crossing(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x at which edges cross heights, in the order of operations that ``_contributions`` has."""
    return (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from first to last of each row: (row, number)."""
    counts = last - first + 1
    rows = np.repeat(np.arange(len(first)), counts)
    return rows, first[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)


def cover(rings: list, size: float, width: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(cx, cy, base, edges) of the cells that a polygon or the ``width`` around its line touches; edges is None for inner cells."""
    e = _edges_of(rings)
    none = np.zeros(0, np.int64)
    if not len(e):
        return none, none, none.astype(bool), []
    slack = width + 1e-6 * size + 1e-9 * float(np.abs(e).max())
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    cell = lambda v: np.floor(v / size).astype(np.int64)
    # the rows that an edge touches, and in each the columns between its ends within the row
    k, row = _spans(cell(low - slack), cell(high + slack))
    d = e[k]
    rise = d[:, 3] - d[:, 1]
    flat = rise == 0
    at = lambda y: np.where(flat, d[:, 0], d[:, 0] + (d[:, 2] - d[:, 0]) * np.clip((y - d[:, 1]) / np.where(flat, 1, rise), 0, 1))
    a, b = at(row * size - slack), at((row + 1) * size + slack)
    a, b = np.where(flat, d[:, 0], a), np.where(flat, d[:, 2], b)
    m, column = _spans(cell(np.minimum(a, b) - slack), cell(np.maximum(a, b) + slack))
    k, row = k[m], row[m]
    order = np.lexsort((column, row))
    k, row, column = k[order], row[order], column[order]
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (column[1:] != column[:-1])])
    groups = np.split(k, starts[1:])
    edge_row, edge_column = row[starts], column[starts]
    # crossings of each row's middle, by row and x
    q, mid = _spans(cell(low), cell(high))
    y = (mid + 0.5) * size
    meets = (e[q, 1] > y) != (e[q, 3] > y)
    q, mid, y = q[meets], mid[meets], y[meets]
    x = _crossing(e[q], y)
    order = np.lexsort((x, mid))
    mid, x = mid[order], x[order]
    cx, cy, base, edges = [], [], [], []
    bounds = np.searchsorted(edge_row, np.arange(edge_row[0], edge_row[-1] + 2))
    for r in range(edge_row[0], edge_row[-1] + 1):
        i, j = bounds[r - edge_row[0]], bounds[r - edge_row[0] + 1]
        line = x[np.searchsorted(mid, r) : np.searchsorted(mid, r, side="right")]
        beyond = lambda v, line=line: (len(line) - np.searchsorted(line, v, side="right")) % 2 == 1
        columns = edge_column[i:j]
        right = (columns + 1) * size
        known = beyond(right)
        height = (r + 0.5) * size
        for c, xr, g, start in zip(columns.tolist(), right.tolist(), groups[i:j], known.tolist(), strict=True):
            mine = e[g]
            astride = (mine[:, 0] > xr) != (mine[:, 2] > xr)
            s = mine[astride]
            with np.errstate(divide="ignore", invalid="ignore"):
                crosses = ((s[:, 1] > height) != (s[:, 3] > height)) & (xr < _crossing(s, np.full(len(s), height)))
            end = np.where(s[:, 0] > xr, s[:, 1], s[:, 3]) > height
            cx.append(c)
            cy.append(r)
            base.append(bool(start) ^ bool((crosses.sum() + end.sum()) % 2))
            edges.append(mine)
        if len(columns) > 1:  # cells between those of the line: all in or all out
            between = np.setdiff1d(np.arange(columns[0], columns[-1] + 1), columns, assume_unique=True)
            inner = between[beyond((between + 0.5) * size)]
            cx += inner.tolist()
            cy += [r] * len(inner)
            base += [True] * len(inner)
            edges += [None] * len(inner)
    return np.array(cx, np.int64), np.array(cy, np.int64), np.array(base, bool), edges


def covering(polygons: DataFrame, size: float, width: float = 0.0) -> DataFrame:
    """A row for each cell (cx, cy) of each polygon, with the polygon's other columns, ``base`` and ``edges``.

    Polygons have ``ring``, or ``rings`` if there are holes or parts. Null and empty ones have no cells.
    """
    shape = "rings" if "rings" in polygons.columns else "ring"
    source = polygons.withColumn("_rings", F.col("rings") if shape == "rings" else F.array("ring")).drop("ring", "rings")
    source = source.withColumn("_rings", F.col("_rings").cast(f"array<{RING}>"))
    keep = source.columns[:-1]
    kind = T.StructType([source.schema[c] for c in keep] + T.StructType.fromDDL(f"cx long, cy long, base boolean, edges {EDGES}").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, rings in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                cx, cy, base, edges = cover(rings or [], size, width)
                flat = np.concatenate([np.zeros((0, 4)), *[g for g in edges if g is not None]])
                ends = np.cumsum([0, *[0 if g is None else len(g) for g in edges]]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], fields=list(_EDGE))
                lists = pa.ListArray.from_arrays(pa.array(ends), items, mask=pa.array([g is None for g in edges], pa.bool_()))
                same = [batch.column(k).take(pa.array(np.full(len(cx), i))) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(cx), pa.array(cy), pa.array(base), lists], names=[f.name for f in kind])

    return source.mapInArrow(run, kind)


def _contributions(e: Column, x: Column, y: Column, xr: Column) -> Column:
    """How often an edge of the cell counts for a point."""
    meets = (e["y1"] > y) != (e["y2"] > y)
    at = F.when(e["y1"] != e["y2"], (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    beyond = meets & (xr < at)
    before = meets & (x < at) & ~(xr < at)
    astride = (e["x1"] > xr) != (e["x2"] > xr)
    end = F.when(e["x1"] > xr, e["y1"]).otherwise(e["y2"]) > y
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return one(before) + F.when(astride, one(beyond) + one(end)).otherwise(0)


def inside(base: Column, edges: Column, x: Column, y: Column, cx: Column, size: float) -> Column:
    """Whether a point of the cell is in the polygon."""
    xr = (cx + 1) * F.lit(float(size))
    total = F.aggregate(edges, base.cast("int"), lambda s, e: s + _contributions(e, x, y, xr))
    return F.when(edges.isNull(), base).otherwise(total % 2 == 1)


def near(edges: Column, x: Column, y: Column, width: float) -> Column:
    """Whether the line is less than ``width`` from a point of the cell; the covering must be as wide."""

    def far(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        n = dx * dx + dy * dy
        t = F.when(n > 0, F.least(F.greatest(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))

    return F.coalesce(F.exists(edges, lambda e: far(e) < width), F.lit(False))
