"""Sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwatch.functions import scalars as S
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query
from loamwatch.sources.series import read_series, write_series
from loamwatch.staging import stage_path
from loamwatch.sources import catalogue as C
from loamwatch.sources import tables as T


@query("a01_observation_scan", X.with_sql("obs", "SELECT tile, x, y, count(*) AS n, min(obs_date) AS first, max(obs_date) AS last FROM obs WHERE tile = 'T1' GROUP BY ALL"), dates="first last")
def scan(spark, d):
    folder = stage_path(spark, "observations")
    T.write_observations(X.observations(spark, d).select("tile", "x", "y", "obs_date", "green", "red", "nir", "swir2"), folder)
    return T.read_observations(spark, folder).where("tile = 'T1'").groupBy("tile", "x", "y").agg(F.count("*").alias("n"), F.min("obs_date").alias("first"), F.max("obs_date").alias("last"))


@query("a02_cube_to_long", X.with_sql("obs", "SELECT tile, x, y, obs_date, green, red, nir, swir2 FROM obs"), dates="obs_date")
def cube(spark, d):
    o = X.observations(spark, d)
    return T.cube_to_long(o.select("tile", "x", "y", "obs_date", F.array("green", "red", "nir", "swir2").alias("bands")), ["green", "red", "nir", "swir2"])


@query("a03_dated_images", "SELECT o_orderkey AS seq, o_orderdate::DATE AS acq_date FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998", dates="acq_date")
def dated(spark, d):
    files = X.images(spark, d).select("seq", F.concat(F.lit("SENTINEL2_"), F.date_format("acq_date", "yyyyMMdd"), F.lit("-112_L2A.tif")).alias("path"))
    return C.by_year(files, 1996, "1998-03-01").select("seq", "acq_date")


@query("a04_epoch_images", X.with_sql("images", "SELECT seq, acq_date FROM images WHERE acq_date <= DATE '1998-03-01'"), dates="acq_date")
def epoch(spark, d):
    return C.by_ms(X.images(spark, d).select("seq", "path"), "1998-03-01").select("seq", "acq_date")


@query("a05_most_recent", X.with_sql("images", "SELECT max_by(path, seq) AS path FROM images WHERE path NOT LIKE '%tile\\_3%' ESCAPE '\\'"))
def recent(spark, d):
    return C.most_recent(X.images(spark, d), "tile_3", "seq")


@query("a06_largest_image", X.with_sql("images", "SELECT path, width, height FROM images ORDER BY width::BIGINT * height DESC, seq LIMIT 1"))
def largest(spark, d):
    return C.largest(X.images(spark, d)).select("path", "width", "height")


@query("a07_first_last_image", X.with_sql("images", "SELECT min(acq_date) AS first, max(acq_date) AS last FROM images WHERE acq_date BETWEEN DATE '1997-02-03' AND DATE '1997-11-05'"), dates="first last")
def first_last(spark, d):
    return C.first_last(X.images(spark, d), "1997-02-03", "1997-11-05")


@query("a08_dated_names", X.with_sql("images", "SELECT seq, 'S2SR_image_' || strftime(acq_date, '%Y%m%d') || '_tile_' || tile[2:] || '.tif' AS name FROM images"))
def names(spark, d):
    return X.images(spark, d).select("seq", C.dated_name(F.col("path")).alias("name"))


@query("a09_a10_segment_table", X.with_sql("obs seg", "SELECT tile, x_coord, y_coord, tBreak FROM seg WHERE changeProb = 100"))
def segment_table(spark, d):
    folder = stage_path(spark, "segments")
    s = X.segments(spark, d)
    rest = {c: F.lit(None).cast("double") for c in ["intercept_values", *[f"{b}{e}" for b in ("green", "red", "nir", "swir2") for e in ("Start", "Start2", "End", "End2")]]}
    T.write_segments(s.withColumns({"coeficientes": F.lit(None).cast("array<double>")} | rest).drop("flag", "start_date", "end_date"), folder)
    return T.read_segments(spark, folder, columns=["tile", "x_coord", "y_coord", "tBreak", "changeProb"]).where("changeProb = 100").drop("changeProb")


@query("a11_end_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE END AS end_date FROM orders", dates="end_date")
def ends(spark, d):
    t = X.images(spark, d).select(F.col("seq").alias("o_orderkey"), F.when(F.col("seq") % 4 != 0, F.concat(F.lit("segments_END"), F.date_format("acq_date", "yyyyMMdd"), F.lit(".parquet"))).otherwise("segments.parquet").alias("p"))
    return t.select("o_orderkey", C.end_date(F.col("p")).alias("end_date"))


@query("a12_a14_csv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def csv(spark, d):
    from loamwatch.session import table

    path = stage_path(spark, "parts-csv")
    T.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), path, ";")
    return T.read_csv(spark, path, "p_partkey long, p_name string, p_size int")


@query("a13_list_columns", X.with_sql("obs seg", "SELECT x_coord, y_coord, tBreak, changeProb FROM seg"))
def list_columns(spark, d):
    s = X.segments(spark, d).groupBy("x_coord", "y_coord").agg(F.sort_array(F.collect_list(F.struct("tBreak", "changeProb"))).alias("l"))
    text = lambda c: F.to_json(F.transform("l", lambda v: v[c].cast("double")))
    t = s.select("x_coord", "y_coord", text("tBreak").alias("tBreak"), text("changeProb").alias("changeProb"))
    return T.list_rows(t, ["tBreak", "changeProb"], ["x_coord", "y_coord"]).select("x_coord", "y_coord", F.col("tBreak").cast("long"), F.col("changeProb").cast("int"))


@query("a15_break_raster", X.with_sql("obs seg", """
SELECT r::INT AS row, c::INT AS col, coalesce(yyyymmdd, -9999) AS yyyymmdd
FROM (SELECT unnest(range(0, (SELECT (max(y_coord) - min(y_coord)) // 10 + 1 FROM seg))) AS r) CROSS JOIN (SELECT unnest(range(0, (SELECT (max(x_coord) - min(x_coord)) // 10 + 1 FROM seg))) AS c)
LEFT JOIN (SELECT ((SELECT max(y_coord) FROM seg) - y_coord) // 10 AS r, (x_coord - (SELECT min(x_coord) FROM seg)) // 10 AS c, arg_max(strftime(end_date, '%Y%m%d')::INT, {'a': end_date, 'b': flag}) AS yyyymmdd FROM seg GROUP BY 1, 2) USING (r, c)"""))
def raster(spark, d):
    s = X.segments(spark, d).withColumn("yyyymmdd", S.date_to_int(F.col("end_date")))
    return T.dense(T.raster_cells(s, "yyyymmdd", order=["end_date", "flag"]), "yyyymmdd")


@query("a01_series_store", X.with_sql("obs", """
SELECT tile, x, y, (count(*) FILTER (WHERE clean))::INT AS n, (min(t) FILTER (WHERE clean))::INT AS first_day, (max(t) FILTER (WHERE clean))::INT AS last_day, coalesce(sum(green) FILTER (WHERE clean), 0)::BIGINT AS green
FROM (SELECT *, green <> 65535 AND nir + red > 0 AS clean, date_diff('day', DATE '1970-01-01', obs_date) + 719163 AS t FROM obs) GROUP BY ALL"""))
def series_store(spark, d):
    """Series written to a store that is clustered in space, and read back."""
    path = stage_path(spark, "series")
    write_series(X.observations(spark, d), path, ["l_orderkey", "l_linenumber"])
    total = F.aggregate("green", F.lit(0).cast("long"), lambda s, v: s + v)
    return read_series(spark, path).select("tile", "x", "y", F.size("ordinal").alias("n"), F.get("ordinal", 0).alias("first_day"), F.try_element_at("ordinal", F.lit(-1)).alias("last_day"), total.alias("green"))
