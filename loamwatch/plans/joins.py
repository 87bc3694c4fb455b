"""Joins (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwatch.operators import relations as R
from loamwatch.operators import spatial as P
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query
from loamwatch.session import table

PX = ["tile", "x", "y"]
_IN = "p.x >= minx AND p.x < maxx AND p.y >= miny AND p.y < maxy"
CELL = 40.0


@query("c01_c06_region_mask", X.with_sql("obs pixels polys", f"SELECT tile, x, y FROM pixels p WHERE EXISTS (SELECT 1 FROM polys WHERE region = 2 AND {_IN})"))
def region(spark, d):
    return P.in_region(X.pixels(spark, d), X.polygons(spark, d).where("region = 2"), PX, CELL)


@query("c02_polygon_within_tile", X.with_sql("parcels parcel_tiles", "SELECT id_gleba, tile_no FROM (SELECT *, minx + 7 AS maxx, miny + 5 AS maxy FROM parcels) p JOIN parcel_tiles t ON p.minx >= t.minx AND p.maxx <= t.maxx AND p.miny >= t.miny AND p.maxy <= t.maxy"))
def within(spark, d):
    return P.rings_within(X.parcels(spark, d), X.parcel_tiles(spark, d), CELL, "id_gleba", "tile_no")


@query("c03_tile_assignment", X.with_sql("parcels parcel_tiles", """
SELECT id_gleba, tile_no FROM (SELECT p.id_gleba, t.tile_no, row_number() OVER (PARTITION BY p.id_gleba ORDER BY (p.minx >= t.minx AND p.maxx <= t.maxx AND p.miny >= t.miny AND p.maxy <= t.maxy) DESC, t.tile_no) AS r
FROM (SELECT *, minx + 7 AS maxx, miny + 5 AS maxy FROM parcels) p LEFT JOIN parcel_tiles t ON p.minx <= t.maxx AND p.maxx >= t.minx AND p.miny <= t.maxy AND p.maxy >= t.miny) WHERE r = 1"""))
def assignment(spark, d):
    return P.assign_tile(X.parcels(spark, d).select("id_gleba", "ring"), X.parcel_tiles(spark, d).select("tile_no", "ring"), CELL, "id_gleba", "tile_no").select("id_gleba", "tile_no")


@query("c04_c05_polygon_join_border", X.with_sql("obs pixels polys", f"SELECT tile, x, y, buffer_id, least(p.x - minx, maxx - p.x, p.y - miny, maxy - p.y) < 10 AS border FROM pixels p JOIN polys ON {_IN}"))
def border(spark, d):
    return P.point_pairs(X.pixels(spark, d), X.polygons(spark, d), CELL, border=10.0).select(*PX, "buffer_id", "border")


@query("c07_attributes_by_location", X.with_sql("obs pixels polys", f"SELECT tile, x, y, name FROM pixels p LEFT JOIN polys ON {_IN} AND region < 3"))
def attributes(spark, d):
    return P.attributes_at(X.pixels(spark, d), X.polygons(spark, d).where("region < 3"), ["name"], PX, CELL)


@query("c08_first_match", X.with_sql("acts parcels", "SELECT id_gleba, ocupacao, activity FROM parcels LEFT JOIN (SELECT id_gleba AS k, activity FROM acts QUALIFY row_number() OVER (PARTITION BY id_gleba ORDER BY day, o_orderkey) = 1) ON id_gleba = k"))
def first_match(spark, d):
    return R.first_match(X.parcels(spark, d).select("id_gleba", "ocupacao"), X.activities(spark, d), "id_gleba", "id_gleba", ["activity"], ["day", "o_orderkey"])


@query("c09_three_way_merge", X.with_sql("acts parcels", """
SELECT id_gleba, ocupacao, cuts, plants FROM parcels LEFT JOIN (SELECT id_gleba, count(*) AS cuts FROM acts WHERE activity LIKE 'CORTE%' GROUP BY 1) USING (id_gleba) LEFT JOIN (SELECT id_gleba, count(*) AS plants FROM acts WHERE activity = 'PLANT' GROUP BY 1) USING (id_gleba)"""))
def merge(spark, d):
    a = X.activities(spark, d)
    count = lambda cond, name: a.where(cond).groupBy("id_gleba").agg(F.count("*").alias(name))
    return R.merge_three(X.parcels(spark, d).select("id_gleba", "ocupacao"), count("activity LIKE 'CORTE%'", "cuts"), count("activity = 'PLANT'", "plants"), "id_gleba")


@query("c10_inner_merge", X.with_sql("acts ndvi", "SELECT id, acts.day, activity, round(med, 6) AS med FROM acts JOIN ndvi ON id_gleba = id AND acts.day = ndvi.day"), dates="day")
def inner(spark, d):
    a = X.activities(spark, d).withColumnRenamed("id_gleba", "id")
    return a.join(X.ndvi_median(spark, d), ["id", "day"]).select("id", "day", "activity", F.round("med", 6).alias("med"))


@query("c11_left_merge", X.with_sql("parcels", "SELECT id_gleba, n_name FROM parcels LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey"))
def left(spark, d):
    n = table(spark, d, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return X.parcels(spark, d).join(n, "c_nationkey", "left").select("id_gleba", "n_name")


@query("c12_semi_join", X.with_sql("acts parcels", "SELECT id_gleba FROM parcels WHERE id_gleba IN (SELECT id_gleba FROM acts WHERE activity LIKE 'CORTE1%')"))
def semi(spark, d):
    return X.parcels(spark, d).join(X.activities(spark, d).where("activity LIKE 'CORTE1%'"), "id_gleba", "left_semi").select("id_gleba")


@query("c13_anti_join", X.with_sql("acts parcels", "SELECT id_gleba FROM parcels WHERE id_gleba NOT IN (SELECT id_gleba FROM acts WHERE activity LIKE 'CORTE1%')"))
def anti(spark, d):
    return X.parcels(spark, d).join(X.activities(spark, d).where("activity LIKE 'CORTE1%'"), "id_gleba", "left_anti").select("id_gleba")


@query("c14_as_of_before", X.with_sql("acts labels_px", """
SELECT id, l_linenumber, id_gleba, drop_date, (SELECT max(day) FROM acts WHERE acts.id_gleba = l.id_gleba AND day < drop_date) AS cut FROM labels_px l WHERE drop_date IS NOT NULL"""), dates="drop_date cut")
def as_of(spark, d):
    t = X.pixel_labels(spark, d).where("drop_date IS NOT NULL").select("id", "l_linenumber", "id_gleba", "drop_date")
    return R.last_before(t, X.activities(spark, d), "id_gleba", "drop_date", "day", "cut")


@query("c15_interval_match", X.with_sql("acts labels_px", """
SELECT id, l_linenumber, (SELECT min(day) FROM acts WHERE acts.id_gleba = l.id_gleba AND day BETWEEN start_date AND end_date) AS hit FROM labels_px l"""), dates="hit")
def interval(spark, d):
    t = X.pixel_labels(spark, d).select("id", "l_linenumber", "id_gleba", "start_date", "end_date")
    return R.first_within(t, X.activities(spark, d), "id_gleba", "start_date", "end_date", "day", "hit").select("id", "l_linenumber", "hit")


@query("c16_space_time_neighbours", X.with_sql("obs seg", """
SELECT a.id AS i, b.id AS j, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM nodes a JOIN nodes b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 144
WHERE a.brk <> b.brk OR (a.brk AND b.brk AND abs(a.day - b.day) < 30)""").replace("\nSELECT a.id", """,
nodes AS (SELECT x_coord || '_' || y_coord || '_' || flag AS id, x_coord AS x, y_coord AS y, tBreak // 86400000 AS day, lead(tStart) OVER (PARTITION BY x_coord, y_coord ORDER BY tStart, flag) IS NOT NULL AS brk FROM seg)
SELECT a.id""", 1))
def neighbours(spark, d):
    from loamwatch.plans.graphs import nodes

    return P.neighbour_pairs(nodes(spark, d), 12.0, 30).withColumn("distance", F.round("distance", 6))


@query("c17_first_saved_match", X.with_sql("images", "SELECT a.seq, b.prob FROM images a JOIN (SELECT l_orderkey, round(arg_min(l_discount * 100, {'a': l_linenumber, 'b': l_discount}))::INT AS prob FROM lineitem GROUP BY 1) b ON a.seq = b.l_orderkey"))
def saved(spark, d):
    prob = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.round(F.col("l_discount") * 100).cast("int").alias("prob"))
    return R.first_match(X.images(spark, d), prob, "seq", "l_orderkey", ["prob"], ["l_linenumber", "l_discount"], "inner").select("seq", "prob")


@query("c18_cloud_score_mask", X.with_sql("obs", "SELECT x, y, obs_date, l_orderkey, l_linenumber FROM obs JOIN (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS score FROM lineitem) USING (l_orderkey, l_linenumber) WHERE score >= 0.6"), dates="obs_date")
def score(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("score")).where("score >= 0.6")
    return X.observations(spark, d).join(s, ["l_orderkey", "l_linenumber"]).select("x", "y", "obs_date", "l_orderkey", "l_linenumber")


@query("c19_point_samples", X.with_sql("obs", "SELECT x, y, o.l_orderkey, o.l_linenumber, nir FROM obs o JOIN (SELECT DISTINCT x AS px, y AS py FROM obs WHERE x % 20 = 0) ON x = px AND y = py"))
def samples(spark, d):
    points = X.pixels(spark, d).where("x % 20 = 0").select(F.bround(F.col("x") + 0.3).cast("int").alias("x"), F.bround(F.col("y") - 0.3).cast("int").alias("y")).distinct()
    return X.observations(spark, d).join(points, ["x", "y"]).select("x", "y", "l_orderkey", "l_linenumber", "nir")
