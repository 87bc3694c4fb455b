import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loamwatch.operators import communities as C
from loamwatch.operators import detection as D
from loamwatch.operators import masks as M
from loamwatch.operators import relations as R
from loamwatch.operators import spatial as P
from loamwatch.operators import validation as V
from loamwatch.operators import windows as W
from loamwatch.operators.components import connected_components
from loamwatch.streaming.append import start_append


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 400)] + [(5000, 5000), (None, 3)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent: dict = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = top(a), top(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: top(x) for x in parent}


def test_communities_of_two_cliques(spark):
    cliques = [(a, b) for base in (0, 100) for a in range(base, base + 6) for b in range(a + 1, base + 6)]
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in [*cliques, (0, 100), (500, 501)]]
    got = {r.node: r.community for r in C.communities(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert len(got) == 14 and len({got[f"n{k:03}"] for k in range(6)}) == 1 and len({got[f"n{k:03}"] for k in range(100, 106)}) == 1
    assert got["n000"] != got["n100"] and got["n500"] not in (got["n000"], got["n100"])


def test_hull_holds_all_points():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 30, (200, 2)).astype(float)
    ring = C.hull(p)
    assert set(map(tuple, ring)) <= set(map(tuple, p)) and len(ring) >= 4
    assert (ring.min(axis=0) == p.min(axis=0)).all() and (ring.max(axis=0) == p.max(axis=0)).all()


def test_surrogate_keys_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = R.surrogate_keys(df, ["k"], "n").collect()
    assert sorted((r.k, r.n) for r in rows) == [(i, i + 1) for i in range(1000)]


def test_detection_does_not_depend_on_row_order(spark):
    t = pd.date_range("2017-01-01", periods=120, freq="16D")
    step = np.where(np.arange(120) < 60, 0, 900)
    frame = pd.DataFrame({"tile": "a", "x": 1, "y": 2, "obs_date": t.date, "green": 500 + step, "red": 400 + step, "nir": 3000 - step, "swir2": 1500 + 2 * step + np.arange(120) % 7})
    short = frame.head(5).assign(x=2)
    bad = frame.head(30).assign(x=3, green=65535)
    every = spark.createDataFrame(pd.concat([frame, short, bad]))
    run = lambda df: sorted(map(str, D.detect_segments(df, order=["green", "red", "nir", "swir2"]).collect()))
    first = run(every)
    assert first == run(every.orderBy(F.rand(3)).repartition(5))
    got = {(r.x_coord, r.changeProb) for r in D.detect_segments(every).collect()}
    assert (2, None) in got and (3, None) in got and (1, 100) in got


def test_stream_appends_known_pixels(spark, tmp_path):
    t = pd.date_range("2017-01-01", periods=60, freq="16D")
    frame = pd.DataFrame({"tile": "a", "x": 1, "y": 2, "obs_date": t.date, "green": 500, "red": 400, "nir": 3000, "swir2": 1500}).astype({"x": "int32", "y": "int32", "green": "int32", "red": "int32", "nir": "int32", "swir2": "int32"})
    store, incoming = str(tmp_path / "store"), str(tmp_path / "in")
    schema = "tile string, x int, y int, obs_date date, green int, red int, nir int, swir2 int"
    spark.createDataFrame(frame, schema).write.parquet(f"{store}/batch=start")
    late = frame.tail(1).assign(obs_date=pd.Timestamp("2020-01-01").date())
    early = frame.tail(1).assign(obs_date=pd.Timestamp("2019-12-01").date())
    spark.createDataFrame(pd.concat([late, late.assign(x=9), early, frame.tail(2)]), schema).write.parquet(incoming)
    for _ in range(2):  # the same file again brings nothing
        start_append(spark, incoming, store, str(tmp_path / "cp")).awaitTermination(120)
        spark.createDataFrame(late, schema).write.mode("append").parquet(incoming)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(store)
    assert rows.count() == 61 and rows.where("x = 9").count() == 0


def test_classification(spark):
    rows = [
        (1, 1, "a", 0, None, None, "x"),  # no date, no break: VN
        (2, 1, "a", 1, 10**12, 5, "x"),  # near break: VP
        (3, 1, "a", 1, 10**12, 400, "x"),  # far break: FP and FN
        (4, 1, "a", 0, 10**12, None, "x"),  # break without a date: FP
        (5, 1, "a", 1, None, None, "x"),  # date without a break: FN
        (6, 1, "a", 1, 10**12, 5, "Agua"),
    ]
    df = spark.createDataFrame([(x, y, 1, n, "s", an, b, None, d, t) for x, y, n, an, b, d, t in rows], "x_coord int, y_coord int, buffer_id int, nome string, id string, analysts int, tBreak long, data date, delta_min int, tipo string")
    got = {r.x_coord: (r.VP, r.FP, r.FN, r.VN) for r in V.classify(df).collect()}
    assert got == {1: (0, 0, 0, 1), 2: (1, 0, 0, 0), 3: (0, 1, 1, 0), 4: (0, 1, 0, 0), 5: (0, 0, 1, 0)}


def test_each_break_gets_one_date(spark):
    """Two breaks and two dates of a point: the nearest pair stays, and the other break with the other date."""
    rows = [(1, 1, 10, "a", 5), (1, 1, 10, "b", 90), (1, 1, 20, "a", 70), (1, 1, 20, "b", 80), (2, 2, 10, "a", None)]
    df = spark.createDataFrame(rows, "x_coord int, y_coord int, tBreak int, data string, d int")
    got = {(r.x_coord, r.tBreak, r.data) for r in V.drop_conflicts(df, ["x_coord", "y_coord"], "d", "tBreak", "data", ["data"]).collect()}
    assert got == {(1, 10, "a"), (1, 20, "b"), (2, 10, "a")}


def test_rows_without_a_distance_are_neither_near_nor_far(spark):
    """Two dates that are nearest to the same break: the point's rows are set anew, and those without a break get nothing."""
    a, b = "2000-03-01", "2001-08-01"
    rows = [  # breaks 5 and 100 days from a and b, 200 and 150 days from them, and a row without a break
        (1, "p1_1", 2, 10, a, 5), (1, "p1_2", 2, 10, b, 100), (1, "p1_1", 2, 20, a, 200), (1, "p1_2", 2, 20, b, 150), (1, "p1_1", 2, None, a, None),
        (1, "p2_1", 0, 10, None, None),  # the same point in a polygon without dates
    ]
    df = spark.createDataFrame([(7, 7, p, n, f"s{t}", an, t, d, m, "x") for p, n, an, t, d, m in rows], "x_coord int, y_coord int, buffer_id int, nome string, id string, analysts int, tBreak long, data string, delta_min int, tipo string")
    got = {(r.nome, r.tBreak): (r.VP, r.FP, r.FN, r.VN) for r in V.classify(df).collect()}
    assert got[("p1_1", 10)] == (1, 0, 0, 0)
    assert ("p1_1", None) not in got or got[("p1_1", None)] == (0, 0, 1, 0)
    assert all(v != (0, 1, 1, 0) for (_, t), v in got.items() if t is None)


def test_cells_near_others(spark):
    """Squares by runs against all pairs, on scattered and on dense cells."""
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.9):
        here = [(k, int(x), int(y)) for k in range(2) for x, y in np.argwhere(rng.random((40, 30)) < max(share, 0.3))]
        there = [(k, int(x), int(y)) for k in range(2) for x, y in np.argwhere(rng.random((40, 30)) < share)]
        for reach in (0, 2, 5):
            got = {(r.image, r.cx, r.cy): r.hit for r in M.covered(spark.createDataFrame(here, "image int, cx int, cy int"), spark.createDataFrame(there, "image int, cx int, cy int"), "image", reach, "hit").collect()}
            want = {a: any(a[0] == b[0] and abs(a[1] - b[1]) <= reach and abs(a[2] - b[2]) <= reach for b in there) for a in here}
            assert got == want


def test_neighbours_equal_all_pairs(spark):
    rng = random.Random(5)
    nodes = [(f"n{i:03}", rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 200), rng.random() < 0.6) for i in range(200)]
    nodes += [(f"m{i:03}", 7, 7, 9 * i, True) for i in range(150)]  # a crowded place over years
    nodes += [("z", 7, 7, None, False)]
    table = spark.createDataFrame(nodes, "id string, x int, y int, day int, is_break boolean")
    got = {(r.i, r.j) for r in P.neighbour_pairs(table, 12.0, 30).collect()}
    near = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 144 and (a[4] != b[4] or (a[4] and b[4] and abs(a[3] - b[3]) < 30))
    want = {(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(nodes) for b in nodes[:k] if near(a, b)}
    assert got == want and P.neighbour_pairs(table, 12.0, 30).count() == len(want)
    crowd = table.where("id LIKE 'm%'")
    assert P.neighbour_candidates(crowd, 12.0, 30)[0].count() < 150 * 149 / 2 / 10


def test_anchored_intervals_equal_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(0, 9000)) for k in range(40) for _ in range(rng.randint(1, 60))] + [(99, i // 11) for i in range(100_000)] + [(7, None), (None, 5), (None, 900)]
    days = lambda v: date(1990, 1, 1) + timedelta(v)
    table = spark.createDataFrame([(k, None if v is None else days(v)) for k, v in rows], "id int, day date").repartition(5)
    got = {(r.id, r.seq): (r.start, r.end) for r in W.anchored_intervals(table, "id", "day").collect()}
    want, last = {}, {}
    for k, v in sorted([r for r in rows if r[1] is not None], key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if k not in last or v - last[k][1] > 730:
            last[k] = (last[k][0] + 1 if k in last else 1, v)
        want[k, last[k][0]] = (days(last[k][1]), days(v))
    assert got == want
