"""Coverings against a plain even-odd test over all edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwatch.operators import covering as C
from loamwatch.operators import spatial as P


def plain(rings, x, y):
    odd, least = np.zeros(len(x), bool), np.full(len(x), np.inf)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            dx, dy = x2 - x1, y2 - y1
            t = np.clip(((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
            least = np.minimum(least, np.hypot(x - x1 - t * dx, y - y1 - t * dy))
    return odd, least


def star(n, seed, centre, radius, whole=False):
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = radius * rng.uniform(0.5, 1, n)
    ring = [(centre[0] + a * np.cos(t), centre[1] + a * np.sin(t)) for a, t in zip(r, angle, strict=True)]
    return [(float(round(a)), float(round(b))) for a, b in ring] if whole else [(float(a), float(b)) for a, b in ring]


SHAPES = {
    1: [star(10_000, 1, (300, 300), 280), star(500, 2, (300, 300), 90)],  # many vertices, a hole
    2: [star(40, 3, (350, 320), 250, True)],  # vertices on the lattice of the points
    3: [star(12, 4, (100, 480), 90), star(9, 5, (480, 90), 80)],  # two parts
    4: [[(40.0, 40.0), (400.0, 40.0), (400.0, 440.0), (40.0, 440.0)]],  # edges along cells and points
    5: [[(0.0, 0.0), (600.0, 600.0), (0.0, 600.0)]],  # an edge through the points
    6: [],
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, [[(a, b) for a, b in ring] for ring in rings]) for k, rings in SHAPES.items()] + [(7, None)]
    return spark.createDataFrame(rows, "k int, rings array<array<struct<x:double,y:double>>>")


@pytest.mark.parametrize("size", [7.0, 40.0, 1000.0])
def test_points_equal_the_plain_test(spark, table, size):
    rng = np.random.default_rng(9)
    whole = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(-20, 620, (2500, 2)))]
    points = whole + [(i + 2500, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-20, 620, (1500, 2)))]
    got = {(r.i, r.k): r.border for r in P.point_pairs(spark.createDataFrame(points, "i int, x double, y double"), table, size, border=5.0).collect()}
    x, y = np.array([p[1] for p in points]), np.array([p[2] for p in points])
    want = {}
    for k, rings in SHAPES.items():
        odd, far = plain(rings, x, y)
        want |= {(int(i), k): bool(far[i] < 5.0) for i in np.flatnonzero(odd)}
    assert set(got) == set(want) and sum(got[q] != want[q] for q in want) == 0


def test_edges_are_carried_by_the_cells_that_they_touch(spark, table):
    cells = C.covering(table, 10.0)
    big = cells.where("k = 1").agg(F.sum(F.size("edges")).alias("edges"), F.count_if(F.col("edges").isNull()).alias("inner"), F.count("*").alias("cells")).first()
    assert big.inner > 100 and big.edges < 20 * 10_500 < 10_500 * big.cells / 100
