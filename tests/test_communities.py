"""Communities against known optima; outlines against the points that they must hold."""

import numpy as np
import pytest

from loamwatch.operators import communities as C


def best_of_path(n: int) -> float:
    """Modularity of the best cut of a path into runs, by dynamic programming over exact values."""
    m = n - 1
    degree = np.array([1, *[2] * (n - 2), 1])
    total = np.r_[0, np.cumsum(degree)]
    best = np.full(n + 1, -np.inf)
    best[0] = 0
    for j in range(1, n + 1):
        i = np.arange(j)
        best[j] = (best[i] + (j - i - 1) / m - ((total[j] - total[i]) / (2 * m)) ** 2).max()
    return best[n]


def grid(n):
    return [(i * n + j, (i + 1) * n + j) for i in range(n - 1) for j in range(n)] + [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)]


def plain_modularity(edges, label):
    m = len(edges)
    degree, inner = {}, 0
    for u, v in edges:
        inner += label[u] == label[v]
        for x in (u, v):
            degree[label[x]] = degree.get(label[x], 0) + 1
    return inner / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def squares_of_grid(n, k):
    return plain_modularity(grid(n), {i * n + j: (i // k, j // k) for i in range(n) for j in range(n)})


def cliques(n):
    return [(a + o, b + o) for o in (0, n) for a in range(n) for b in range(a)] + [(0, n)]


CASES = {"path": ([(i, i + 1) for i in range(200)], best_of_path(201)), "grid": (grid(12), squares_of_grid(12, 4)), "cliques": (cliques(12), plain_modularity(cliques(12), {i: i // 12 for i in range(24)}))}


@pytest.mark.parametrize("name", sorted(CASES))
def test_modularity_is_near_the_optimum(spark, name):
    edges, best = CASES[name]
    rows = [*edges, *[(v, u) for u, v in edges[:5]], (3, 3), (None, 1)]  # repeated, loop, null
    found = C.louvain(spark.createDataFrame(rows, "u int, v int"))
    label = {r.node: r.community for r in found.rows.collect()}
    assert sorted(label) == sorted({x for e in edges for x in e})
    assert all(label[c] == c and min(n for n in label if label[n] == c) == c for c in set(label.values()))
    q = plain_modularity(edges, label)
    assert q > best - 0.02 and abs(q - found.modularity[-1]) < 1e-9
    assert all(b >= a - 1e-12 for a, b in zip(found.modularity, found.modularity[1:], strict=False))


def test_a_star_and_an_empty_graph(spark):
    star = C.louvain(spark.createDataFrame([("hub", f"n{i}") for i in range(300)], "u string, v string"))
    assert star.rows.count() == 301
    assert C.louvain(spark.createDataFrame([], "u int, v int")).rows.count() == 0


def held(ring, points):
    """Even-odd rule, the line itself included."""
    x, y = points.T
    inside, on = np.zeros(len(points), bool), np.zeros(len(points), bool)
    for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        on |= (np.abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) < 1e-6) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside | on


def area(ring):
    x, y = ring.T
    return abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2


def blob(seed, n=60):
    rng = np.random.default_rng(seed)
    f, k = rng.normal(size=(n, n)), np.exp(-(np.arange(-9, 10) ** 2) / 18)
    for axis in (0, 1):
        f = np.apply_along_axis(lambda v: np.convolve(v, k, "same"), axis, f)
    return np.argwhere(f > 0.2) * 10.0


def test_outline_holds_all_points_and_follows_a_bay():
    p = np.random.default_rng(1).random((120_000, 2)) * 1000
    p = p[np.abs(p[:, 0] - 500) > (p[:, 1] - 400) / 2]
    ring = C.hull(p)
    assert len(p) > 90_000 and held(ring, p).all()
    assert 0.9 * 820_000 < area(ring) < 840_000


def test_rim_gives_the_same_outline(spark):
    rows = [(str(s), float(x), float(y)) for s in range(4) for x, y in blob(s)]
    members = spark.createDataFrame(rows + rows[:50], "community string, x double, y double")
    assert C.rim(members, "community", 10.0).count() < 0.75 * len(rows)
    for r in C.outlines(members).collect():
        points = blob(int(r.community))
        ring = np.array([(q.x, q.y) for q in r.ring])
        assert r.points == len(points) and (ring == C.hull(points)).all() and held(ring, points).all()


def test_outline_of_few_points():
    line = np.array([(float(i), 2.0 * i) for i in range(9)])
    assert len(C.hull(line)) == 2 and len(C.hull(line[:3])) == 3 and len(C.hull(np.array([[1.0, 1.0]] * 5))) == 1
