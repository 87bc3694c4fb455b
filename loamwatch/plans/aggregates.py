"""Aggregations (D)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.functions import scalars as S
from loamwatch.operators import aggregates as A
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query
from loamwatch.session import table

OBS_ORDER = ["l_orderkey", "l_linenumber", "nir", "red"]


@query("d01_median_per_date", X.with_sql("ndvi", "SELECT id, day, round(med, 6) AS med FROM ndvi"), dates="day")
def medians(spark, d):
    return X.ndvi_median(spark, d).withColumn("med", F.round("med", 6))


YEARS = range(1995, 2002)  # those of the table
_YEARS = ", ".join(f"round(arg_min(med, day) FILTER (WHERE year(day) = {y}), 6) AS y{y}" for y in YEARS)


@query("d02_pivot_dates", X.with_sql("ndvi", f"SELECT id, {_YEARS} FROM ndvi WHERE med IS NOT NULL GROUP BY id"))
def pivot(spark, d):
    n = X.ndvi_median(spark, d).where("med IS NOT NULL").withColumn("y", F.concat(F.lit("y"), F.year("day")))
    return n.groupBy("id").pivot("y", [f"y{y}" for y in YEARS]).agg(F.round(F.min_by("med", "day"), 6))


@query("d03_ordered_collect", X.with_sql("acts", """
SELECT id_gleba, (count(*) OVER (PARTITION BY id_gleba))::INT AS n, (row_number() OVER (PARTITION BY id_gleba ORDER BY day, o_orderkey))::INT AS seq, day, activity FROM acts"""), dates="day")
def ordered(spark, d):
    """Every activity of an id with its number in order of time."""
    t = A.ordered_events(X.activities(spark, d), "id_gleba", "day", "activity", ["o_orderkey"])
    t = t.select("id_gleba", "n", F.posexplode(F.arrays_zip("days", "activities")).alias("k", "e"))
    return t.select("id_gleba", "n", (F.col("k") + 1).alias("seq"), F.col("e.days").alias("day"), F.col("e.activities").alias("activity"))


@query("d04_d06_coverage", X.with_sql("ndvi", "SELECT id, count(*) AS total, count(*) FILTER (WHERE med IS NULL) AS empty, count(med) AS filled FROM ndvi GROUP BY 1 HAVING count(med) > 0"))
def coverage(spark, d):
    t = X.ndvi_median(spark, d).withColumn("some", F.count("med").over(W.partitionBy("id")) > 0).where("some")
    return t.groupBy("id").agg(F.count("*").alias("total"), F.count_if(F.col("med").isNull()).alias("empty"), F.count("med").alias("filled"))


@query("d05_d09_d10_cuts", X.with_sql("acts", """
SELECT id_gleba, count(*) FILTER (WHERE activity LIKE 'CORTE%') AS cuts, floor(avg(date_diff('day', DATE '1970-01-01', day)) FILTER (WHERE activity LIKE 'CORTE%'))::INT AS mean_day,
       month(DATE '1970-01-01' + floor(avg(date_diff('day', DATE '1970-01-01', day)) FILTER (WHERE activity LIKE 'CORTE%'))::INT)::INT AS mean_month, count(*) FILTER (WHERE day(day) <= 10) AS early FROM acts GROUP BY 1"""))
def cuts(spark, d):
    cut = F.col("activity").startswith("CORTE")
    mean = F.floor(F.avg(F.when(cut, F.unix_date("day")))).cast("int")
    t = X.activities(spark, d).groupBy("id_gleba").agg(F.count_if(cut).alias("cuts"), mean.alias("mean_day"), F.count_if(F.dayofmonth("day") <= 10).alias("early"))
    return t.withColumn("mean_month", F.month(F.date_from_unix_date("mean_day")))


@query("d07_d08_category_statistics", X.with_sql("parcels", """
SELECT ocupacao, count(*) AS n, round(sum(area_ha), 4) AS total, round(avg(area_ha), 4) AS mean, round(min(area_ha), 4) AS least, round(max(area_ha), 4) AS most, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM parcels GROUP BY 1"""))
def categories(spark, d):
    a = F.col("area_ha")
    g = X.parcels(spark, d).groupBy("ocupacao").agg(F.count("*").alias("n"), *[F.round(f(a), 4).alias(n) for f, n in ((F.sum, "total"), (F.avg, "mean"), (F.min, "least"), (F.max, "most"))])
    whole = g.agg(F.sum("n").alias("whole"))  # one row
    return g.crossJoin(F.broadcast(whole)).select("ocupacao", "n", "total", "mean", "least", "most", F.round(A.share(F.col("n"), F.col("whole")), 6).alias("pct"))


@query("d11_shares_by_month", X.with_sql("ndvi", """
SELECT m, season, empty, filled, round(100.0 * empty / (empty + filled), 6) AS pct FROM (SELECT month(day)::INT AS m, CASE WHEN month(day) IN (1, 2, 11, 12) THEN 'winter' WHEN month(day) IN (3, 4, 9, 10) THEN 'between' ELSE 'summer' END AS season,
count(*) FILTER (WHERE med IS NULL) AS empty, count(med) AS filled FROM ndvi GROUP BY 1, 2)"""))
def by_month(spark, d):
    m = F.month("day")
    g = X.ndvi_median(spark, d).groupBy(m.alias("m"), S.month_class(m).alias("season")).agg(F.count_if(F.col("med").isNull()).alias("empty"), F.count("med").alias("filled"))
    return g.withColumn("pct", F.round(A.share(F.col("empty"), F.col("empty") + F.col("filled")), 6))


@query("d12_d13_d14_conditional_counts", X.with_sql("acts parcels", """
SELECT ocupacao, count(*) FILTER (WHERE c > p) AS more_cuts, count(*) FILTER (WHERE c = p) AS equal, count(*) FILTER (WHERE c < p) AS fewer, round(sum(area_ha) FILTER (WHERE c > p), 4) AS area_more, count(*) FILTER (WHERE c IS NULL) AS missing,
       count(DISTINCT c_nationkey) FILTER (WHERE ocupacao LIKE '%U%') AS nations FROM parcels LEFT JOIN (SELECT id_gleba, count(*) FILTER (WHERE activity LIKE 'CORTE%') AS c, count(*) FILTER (WHERE activity = 'PLANT') AS p FROM acts GROUP BY 1) USING (id_gleba) GROUP BY 1"""))
def conditional(spark, d):
    a = X.activities(spark, d).groupBy("id_gleba").agg(F.count_if(F.col("activity").startswith("CORTE")).alias("c"), F.count_if(F.col("activity") == "PLANT").alias("p"))
    t, c, p = X.parcels(spark, d).join(a, "id_gleba", "left"), F.col("c"), F.col("p")
    return t.groupBy("ocupacao").agg(
        F.count_if(c > p).alias("more_cuts"), F.count_if(c == p).alias("equal"), F.count_if(c < p).alias("fewer"), F.round(F.sum(F.when(c > p, F.col("area_ha"))), 4).alias("area_more"), F.count_if(c.isNull()).alias("missing"),
        F.countDistinct(F.when(F.contains("ocupacao", F.lit("U")), F.col("c_nationkey"))).alias("nations"),
    )


_OK = "(drop_date IS NOT NULL AND drop_date BETWEEN start_date AND end_date AND NC IS NOT NULL)"


@query("d15_d16_d17_d18_label_totals", X.with_sql("labels_px", f"""
SELECT count(*) AS pixels, count(DISTINCT id_gleba) AS parcels, count(DISTINCT id) AS subparcels, count(DISTINCT id) FILTER (WHERE {_OK}) AS correct, round(100.0 * count(DISTINCT id) FILTER (WHERE {_OK}) / count(DISTINCT id), 6) AS correct_pct,
       count(*) FILTER (WHERE drop_date IS NULL) AS nulls, count(*) FILTER (WHERE drop_date IS NULL AND NC IS NULL) AS isolated, round(100.0 * count(*) FILTER (WHERE drop_date IS NULL) / count(*), 6) AS null_pct,
       count(*) FILTER (WHERE drop_date IS NULL AND NC = 1) AS nc_one, count(*) FILTER (WHERE drop_date IS NULL AND NC >= 0.2 AND NC < 1) AS nc_part, count(*) FILTER (WHERE drop_date IS NULL AND NC IS NULL) AS nc_null FROM labels_px"""))
def totals(spark, d):
    t = X.pixel_labels(spark, d)
    drop, nc = F.col("drop_date"), F.col("NC")
    good = F.when(drop.isNotNull() & drop.between(F.col("start_date"), F.col("end_date")) & nc.isNotNull(), F.col("id"))
    null = drop.isNull()
    g = t.agg(
        F.count("*").alias("pixels"), F.countDistinct("id_gleba").alias("parcels"), F.countDistinct("id").alias("subparcels"), F.countDistinct(good).alias("correct"),
        F.count_if(null).alias("nulls"), F.count_if(null & nc.isNull()).alias("isolated"), F.count_if(null & (nc == 1)).alias("nc_one"), F.count_if(null & (nc >= 0.2) & (nc < 1)).alias("nc_part"), F.count_if(null & nc.isNull()).alias("nc_null"),
    )
    return g.withColumns({"correct_pct": F.round(A.share(F.col("correct"), F.col("subparcels")), 6), "null_pct": F.round(A.share(F.col("nulls"), F.col("pixels")), 6)})


@query("d19_isolated_per_subparcel", X.with_sql("labels_px", """
SELECT id_gleba, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, round(max(share), 6) AS max_share, arg_max(id, {'a': share, 'b': -id}) AS at FROM (
SELECT id_gleba, id, count(*) FILTER (WHERE drop_date IS NULL) AS n, 100.0 * count(*) FILTER (WHERE drop_date IS NULL) / count(*) AS share FROM labels_px GROUP BY 1, 2) GROUP BY 1"""))
def isolated(spark, d):
    null = F.count_if(F.col("drop_date").isNull())
    g = X.pixel_labels(spark, d).groupBy("id_gleba", "id").agg(null.alias("n"), (100.0 * null / F.count("*")).alias("share"))
    return g.groupBy("id_gleba").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.max("share"), 6).alias("max_share"), F.max_by("id", F.struct("share", -F.col("id"))).alias("at"))


@query("d20_difference_classes", X.with_sql("labels_px", """
SELECT count(*) FILTER (WHERE n = 10) AS ten, count(*) FILTER (WHERE n < 10) AS under, count(*) FILTER (WHERE n > 10 AND n <= 30) AS month, count(*) FILTER (WHERE n > 30 AND n <= 60) AS two_months, count(*) FILTER (WHERE n > 60) AS more, round(100.0 * count(*) FILTER (WHERE n > 60) / count(*), 6) AS more_pct
FROM (SELECT abs((l_quantity * 3)::INT - 20) AS n FROM labels_px WHERE drop_date IS NOT NULL)"""))
def difference_classes(spark, d):
    n = F.col("n")
    t = X.pixel_labels(spark, d).where("drop_date IS NOT NULL").select(F.abs(F.datediff(F.date_add("drop_date", (F.col("l_quantity") * 3).cast("int")), F.date_add("drop_date", 20))).alias("n"))
    g = t.agg(F.count_if(n == 10).alias("ten"), F.count_if(n < 10).alias("under"), F.count_if((n > 10) & (n <= 30)).alias("month"), F.count_if((n > 30) & (n <= 60)).alias("two_months"), F.count_if(n > 60).alias("more"), F.count("*").alias("all"))
    return g.withColumn("more_pct", F.round(A.share(F.col("more"), F.col("all")), 6)).drop("all")


@query("d21_histogram", "SELECT CASE WHEN l_quantity = 50 THEN 7 ELSE floor((l_quantity - 1) / 7)::INT + 1 END AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1")
def bins(spark, d):
    return A.histogram(table(spark, d, "lineitem"), "l_quantity", 1, 50, 7)


@query("d22_raster_extent", X.with_sql("obs pixels", "SELECT min(x) - 5.0 AS minx, max(x) + 5.0 AS maxx, min(y) - 5.0 AS miny, max(y) + 5.0 AS maxy, ceil((max(x) - min(x) + 10) / 10.0)::INT AS cols, ceil((max(y) - min(y) + 10) / 10.0)::INT AS rows FROM pixels"))
def extent(spark, d):
    t = X.pixels(spark, d).agg((F.min("x") - 5.0).alias("minx"), (F.max("x") + 5.0).alias("maxx"), (F.min("y") - 5.0).alias("miny"), (F.max("y") + 5.0).alias("maxy"))
    return t.withColumns({"cols": F.ceil((F.col("maxx") - F.col("minx")) / 10).cast("int"), "rows": F.ceil((F.col("maxy") - F.col("miny")) / 10).cast("int")})


@query("d23_mosaic", X.with_sql("obs", "SELECT x, y, obs_date, arg_min(green, {'a': l_orderkey, 'b': l_linenumber, 'c': green}) AS green FROM obs WHERE green <> 65535 GROUP BY ALL"), dates="obs_date")
def mosaic(spark, d):
    o = X.observations(spark, d).withColumn("part", F.struct("l_orderkey", "l_linenumber", "green"))
    return A.mosaic(o, ["x", "y", "obs_date"], ["green"], "part", 65535)


@query("d24_first_variogram", X.with_sql("obs", """
SELECT x, y, median(dn) AS nir, median(dr) AS red FROM (SELECT x, y, abs(nir - lag(nir) OVER w) AS dn, abs(red - lag(red) OVER w) AS dr FROM obs WINDOW w AS (PARTITION BY x, y ORDER BY obs_date, l_orderkey, l_linenumber, nir, red)) GROUP BY x, y"""))
def variogram(spark, d):
    return A.first_variogram(X.observations(spark, d), ["x", "y"], "obs_date", ["nir", "red"], OBS_ORDER)


@query("d25_adjusted_variogram", X.with_sql("obs", """,
o AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY obs_date, l_orderkey, l_linenumber, nir, red) AS i FROM obs),
lags(x, y, k, mode) AS (SELECT DISTINCT x, y, 0::BIGINT, 0::BIGINT FROM o UNION ALL
 SELECT x, y, k, arg_max(gap, {'a': n, 'b': -gap}) FROM (SELECT r.x, r.y, r.k + 1 AS k, date_diff('day', b.obs_date, a.obs_date) AS gap, count(*) AS n FROM lags r JOIN o a USING (x, y) JOIN o b ON b.x = a.x AND b.y = a.y AND b.i = a.i - r.k - 1 WHERE r.mode <= 30 GROUP BY ALL) GROUP BY ALL),
chosen AS (SELECT x, y, k FROM lags WHERE mode > 30),
pairs AS (SELECT a.x, a.y, c.k, date_diff('day', b.obs_date, a.obs_date) AS gap, abs(a.nir - b.nir) AS v FROM (FROM chosen UNION SELECT DISTINCT x, y, 1 FROM o) c JOIN o a USING (x, y) JOIN o b ON b.x = a.x AND b.y = a.y AND b.i = a.i - c.k)
SELECT f.x, f.y, coalesce(w.v, f.v) AS nir FROM (SELECT x, y, median(v) AS v FROM pairs WHERE k = 1 GROUP BY x, y) f LEFT JOIN (SELECT x, y, median(v) AS v FROM pairs JOIN chosen USING (x, y, k) WHERE gap > 30 GROUP BY x, y) w ON f.x = w.x AND f.y = w.y""").replace("WITH obs", "WITH RECURSIVE obs").replace("\n,\n", ",\n"))
def adjusted(spark, d):
    return A.adjusted_variogram(X.observations(spark, d), ["x", "y"], "obs_date", ["nir"], OBS_ORDER)


@query("d26_peek_size", X.with_sql("obs", """
SELECT x, y, greatest(6, CASE WHEN m > 0 THEN round_even(96 / m, 0) ELSE 6 END)::INT AS peek FROM (SELECT x, y, median(g) AS m FROM (SELECT x, y, date_diff('day', lag(obs_date) OVER (PARTITION BY x, y ORDER BY obs_date, l_orderkey, l_linenumber), obs_date) AS g FROM obs) GROUP BY x, y)"""))
def peek(spark, d):
    return A.peek_size(X.observations(spark, d), ["x", "y"], "obs_date", OBS_ORDER)


@query("d27_accuracy", """
SELECT vp AS VP, fp AS FP, fn AS FN, fp / (fp + vp) AS cm, fn / (fn + vp) AS om, 2 * (1 - fn / (fn + vp)) * (1 - fp / (fp + vp)) / (2 - fn / (fn + vp) - fp / (fp + vp)) AS f1
FROM (SELECT count(*) FILTER (WHERE l_returnflag = 'A') AS vp, count(*) FILTER (WHERE l_returnflag = 'R') AS fp, count(*) FILTER (WHERE l_linestatus = 'O') AS fn FROM lineitem)""")
def accuracy(spark, d):
    one = lambda c, v, n: F.when(F.col(c) == v, 1).otherwise(0).alias(n)
    return A.scores(table(spark, d, "lineitem").select(one("l_returnflag", "A", "VP"), one("l_returnflag", "R", "FP"), one("l_linestatus", "O", "FN")))


@query("d29_region_union", X.with_sql("obs pixels polys", """
SELECT tile, count(*) AS n FROM pixels p WHERE EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY buffer_id) AS r, count(*) OVER (PARTITION BY region) AS c FROM polys) q WHERE r <= floor(c * 0.5) AND p.x >= minx AND p.x < maxx AND p.y >= miny AND p.y < maxy) GROUP BY 1"""))
def union_region(spark, d):
    from loamwatch.operators.spatial import in_region

    # the first half of each region's polygons
    w = W.partitionBy("region")
    ranked = X.polygons(spark, d).withColumns({"r": F.row_number().over(w.orderBy("buffer_id")), "c": F.count("*").over(w)})
    half = ranked.where(F.col("r") <= F.floor(F.col("c") * 0.5)).select("ring")
    return in_region(X.pixels(spark, d), half, ["tile", "x", "y"], 40.0).groupBy("tile").agg(F.count("*").alias("n"))


@query("d30_d31_distinct_and_value_counts", X.with_sql("obs", "SELECT tile, x, y, count(*) FILTER (WHERE green = 65535) AS nodata FROM obs GROUP BY ALL"))
def value_counts(spark, d):
    return X.observations(spark, d).groupBy("tile", "x", "y").agg(F.count_if(F.col("green") == 65535).alias("nodata"))
