"""Inputs of the queries, derived from the given tables; each has a DataFrame and the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwatch.functions import geometry as G
from loamwatch.session import table

SQL: dict[str, str] = {}


def with_sql(names: str, body: str) -> str:
    """A query over fixtures: WITH clauses of the names, then the body."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split()) + "\n" + body


SQL["obs"] = """
SELECT 'T' || (l_suppkey % 3) AS tile, (500000 + 10 * (l_suppkey % 10))::INT AS x, (4400000 + 10 * (l_suppkey // 10))::INT AS y,
       l_shipdate::DATE AS obs_date, l_orderkey, l_linenumber,
       CASE WHEN l_linenumber = 7 THEN 65535 ELSE round(300 + l_quantity * 4)::INT END AS green,
       round(300 + l_tax * 5000)::INT AS red, round(2500 + l_discount * 5000)::INT AS nir, floor(l_extendedprice / 60)::INT AS swir2
FROM lineitem"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Pixel = supplier; the order key (obs_date, l_orderkey, l_linenumber) breaks ties of dates."""
    k = F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("T"), (k % 3).cast("string")).alias("tile"),
        (500000 + 10 * (k % 10)).cast("int").alias("x"),
        (4400000 + 10 * F.expr("l_suppkey div 10")).cast("int").alias("y"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 7, 65535).otherwise(F.round(300 + F.col("l_quantity") * 4).cast("int")).alias("green"),
        F.round(300 + F.col("l_tax") * 5000).cast("int").alias("red"),
        F.round(2500 + F.col("l_discount") * 5000).cast("int").alias("nir"),
        F.floor(F.col("l_extendedprice") / 60).cast("int").alias("swir2"),
    )


SQL["seg"] = """
SELECT tile, x AS x_coord, y AS y_coord, flag, min(d) AS start_date, max(d) AS end_date,
       (date_diff('day', DATE '1970-01-01', min(d)) * 86400000)::BIGINT AS tStart, (date_diff('day', DATE '1970-01-01', max(d)) * 86400000)::BIGINT AS tEnd,
       (date_diff('day', DATE '1970-01-01', max(d)) * 86400000)::BIGINT AS tBreak,
       CASE flag WHEN 'A' THEN 100 WHEN 'R' THEN 0 ELSE 50 END AS changeProb
FROM (SELECT o.*, l_returnflag AS flag, obs_date AS d FROM obs o JOIN lineitem l USING (l_orderkey, l_linenumber)) GROUP BY ALL"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """One row a pixel and return flag: a stand-in that doesn't depend on the detection kernel."""
    flags = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    day = lambda c: (F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 86400000)
    o = observations(spark, d).join(flags, ["l_orderkey", "l_linenumber"])
    g = o.groupBy("tile", F.col("x").alias("x_coord"), F.col("y").alias("y_coord"), "flag").agg(F.min("obs_date").alias("start_date"), F.max("obs_date").alias("end_date"))
    return g.withColumns({"tStart": day(F.col("start_date")), "tEnd": day(F.col("end_date")), "tBreak": day(F.col("end_date")), "changeProb": F.when(F.col("flag") == "A", 100).when(F.col("flag") == "R", 0).otherwise(50)})


SQL["images"] = """
SELECT 'S2SR_image_' || (epoch_ms(o_orderdate)) || '_tile_' || (o_custkey % 17) || '.tif' AS path,
       CASE WHEN o_orderkey % 2 = 0 THEN 'gee' ELSE 'theia' END AS source, 'T' || (o_custkey % 17) AS tile, o_orderdate::DATE AS acq_date,
       (1000 + o_custkey % 7)::INT AS width, (1000 + o_orderkey % 5)::INT AS height, (o_totalprice % 100)::DOUBLE AS cloud_pct, o_orderkey AS seq
FROM orders"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """An image a order; its name holds the epoch milliseconds of the order date."""
    return table(spark, d, "orders").select(
        F.concat(F.lit("S2SR_image_"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("_tile_"), (F.col("o_custkey") % 17).cast("string"), F.lit(".tif")).alias("path"),
        F.when(F.col("o_orderkey") % 2 == 0, "gee").otherwise("theia").alias("source"),
        F.concat(F.lit("T"), (F.col("o_custkey") % 17).cast("string")).alias("tile"),
        F.col("o_orderdate").cast("date").alias("acq_date"),
        (1000 + F.col("o_custkey") % 7).cast("int").alias("width"),
        (1000 + F.col("o_orderkey") % 5).cast("int").alias("height"),
        (F.col("o_totalprice") % 100).alias("cloud_pct"),
        F.col("o_orderkey").alias("seq"),
    )


SQL["acts"] = """
SELECT o_custkey::VARCHAR AS id_gleba, o_orderdate::DATE AS day, o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 'CORTE' || o_orderpriority ELSE 'PLANT' END AS activity FROM orders"""


def activities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("id_gleba"),
        F.col("o_orderdate").cast("date").alias("day"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("CORTE"), "o_orderpriority")).otherwise("PLANT").alias("activity"),
    )


SQL["parcels"] = """
SELECT c_custkey::VARCHAR AS id_gleba, c_mktsegment AS ocupacao, c_nationkey, abs(c_acctbal) / 100 AS area_ha,
       10.0 * (c_custkey % 40) AS minx, 10.0 * (c_custkey // 40) AS miny FROM customer"""


def parcels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id_gleba"),
        F.col("c_mktsegment").alias("ocupacao"),
        "c_nationkey",
        (F.abs("c_acctbal") / 100).alias("area_ha"),
        (10.0 * (F.col("c_custkey") % 40)).alias("minx"),
        (10.0 * F.expr("c_custkey div 40")).alias("miny"),
    )
    return p.withColumn("ring", G.rectangle(F.col("minx"), F.col("miny"), F.col("minx") + 7, F.col("miny") + 5))


SQL["ndvi"] = """
SELECT o_custkey::VARCHAR AS id, o_orderdate::DATE AS day, median(CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE l_discount END) AS med
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def ndvi_median(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    value = F.when(F.col("l_linenumber") % 5 != 4, F.col("l_discount"))
    return joined.groupBy(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderdate").cast("date").alias("day")).agg(F.median(value).alias("med"))


SQL["labels_px"] = """
SELECT l_orderkey AS id, l_partkey::VARCHAR AS id_gleba, l_shipdate::DATE - 100 AS start_date, l_shipdate::DATE + 100 AS end_date,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate::DATE END AS drop_date,
       CASE l_linenumber % 4 WHEN 0 THEN '1000-01-01' WHEN 1 THEN strftime(l_shipdate::DATE - 30, '%Y-%m-%d') END AS ECCD1,
       CASE l_linenumber % 5 WHEN 0 THEN '1000-01-01' WHEN 1 THEN strftime(l_shipdate::DATE + 40, '%Y-%m-%d') END AS ECCD2,
       CASE WHEN l_returnflag = 'A' THEN 1.0 WHEN l_returnflag = 'R' THEN l_discount * 10 END AS NC, l_linenumber, l_quantity
FROM lineitem"""


def pixel_labels(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    iso = lambda n: F.date_format(F.date_add(day, n), "yyyy-MM-dd")
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_partkey").cast("string").alias("id_gleba"), F.date_add(day, -100).alias("start_date"), F.date_add(day, 100).alias("end_date"),
        F.when(n % 3 != 0, day).alias("drop_date"),
        F.when(n % 4 == 0, "1000-01-01").when(n % 4 == 1, iso(-30)).alias("ECCD1"),
        F.when(n % 5 == 0, "1000-01-01").when(n % 5 == 1, iso(40)).alias("ECCD2"),
        F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "R", F.col("l_discount") * 10).alias("NC"), "l_linenumber", "l_quantity",
    )


SQL["pixels"] = "SELECT DISTINCT tile, x, y FROM obs"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("tile", "x", "y").distinct()


# rectangles over the pixel grid, keyed by nation; nations overlap
SQL["polys"] = """
SELECT n_nationkey AS buffer_id, n_name AS name, n_regionkey AS region, 500000.0 + 10 * (n_nationkey % 8) - 4 AS minx, 4400000.0 + 20 * (n_nationkey // 5) - 4 AS miny,
       500000.0 + 10 * (n_nationkey % 8) + 25 AS maxx, 4400000.0 + 20 * (n_nationkey // 5) + 37 AS maxy FROM nation"""


def polygons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = 500000.0 + 10 * (k % 8), 4400000.0 + 20 * F.expr("n_nationkey div 5")
    p = table(spark, d, "nation").select(k.alias("buffer_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (x - 4).alias("minx"), (y - 4).alias("miny"), (x + 25).alias("maxx"), (y + 37).alias("maxy"))
    return p.select("buffer_id", "name", "region", G.rectangle(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")).alias("ring"))


# squares of 100 around the parcels, at an offset that some parcels straddle; every third column is missing
SQL["parcel_tiles"] = """
SELECT DISTINCT (1000 * gy + gx)::BIGINT AS tile_no, 100.0 * gx + 4 AS minx, 100.0 * gy + 4 AS miny, 100.0 * gx + 104 AS maxx, 100.0 * gy + 104 AS maxy
FROM (SELECT floor((minx - 4) / 100)::BIGINT AS gx, floor((miny - 4) / 100)::BIGINT AS gy FROM parcels) WHERE gx % 3 <> 2"""


def parcel_tiles(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.floor((F.col(c) - 4) / 100).cast("long")
    g = parcels(spark, d).select(at("minx").alias("gx"), at("miny").alias("gy")).distinct().where("gx % 3 <> 2")
    x, y = 100.0 * F.col("gx"), 100.0 * F.col("gy")
    return g.select((1000 * F.col("gy") + F.col("gx")).alias("tile_no"), G.rectangle(x + 4, y + 4, x + 104, y + 104).alias("ring"))
