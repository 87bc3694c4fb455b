"""Projections, filters and scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwatch.functions import scalars as S
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query
from loamwatch.session import table

PX = ["tile", "x", "y", "l_orderkey", "l_linenumber"]


@query("b01_band_selection", X.with_sql("obs", "SELECT tile, x, y, obs_date, green, nir FROM obs"), dates="obs_date")
def bands(spark, d):
    return X.observations(spark, d).select("tile", "x", "y", "obs_date", "green", "nir")


@query("b02_nodata_filter", X.with_sql("obs", "SELECT tile, x, y, l_orderkey, l_linenumber, green, red, nir, swir2 FROM obs WHERE green <> 65535 AND red <> 65535 AND nir <> 65535 AND swir2 <> 65535"))
def clean(spark, d):
    return X.observations(spark, d).where(S.is_clean("green", "red", "nir", "swir2")).select(*PX, "green", "red", "nir", "swir2")


@query("b03_b04_b05_ndvi", X.with_sql("obs", """
SELECT tile, x, y, l_orderkey, l_linenumber, round(CASE WHEN nir + red > 0 THEN 10000.0 * (nir - red) / (nir + red) ELSE 65535 END, 6) AS ndvi,
       least(greatest(trunc(10000.0 * (nir - red) / (nir + red))::INT, 0), 5000) AS ndvi_int, round((nir - red) / (nir + red), 9) AS ndvi_plain FROM obs"""))
def ndvi(spark, d):
    n, r = F.col("nir").cast("double"), F.col("red").cast("double")
    return X.observations(spark, d).select(*PX, F.round(S.ndvi_scaled(n, r), 6).alias("ndvi"), S.ndvi_clipped(n, r).alias("ndvi_int"), F.round(S.ndvi(n, r), 9).alias("ndvi_plain"))


@query("b06_cloud_bits", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 10000, 6) AS reflectance FROM lineitem WHERE (l_partkey & 1024) = 0 AND (l_partkey & 2048) = 0")
def cloud_bits(spark, d):
    return table(spark, d, "lineitem").where(S.cloud_free(F.col("l_partkey"))).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 10000, 6).alias("reflectance"))


@query("b07_scene_filters", X.with_sql("images", "SELECT seq, path, tile FROM images WHERE cloud_pct <= 60 AND acq_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND tile = 'T3'"))
def scenes(spark, d):
    return X.images(spark, d).where("cloud_pct <= 60 AND acq_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND tile = 'T3'").select("seq", "path", "tile")


@query("b08_zero_to_nodata", """
SELECT l_orderkey, l_linenumber, CASE WHEN a = 0 AND b = 0 THEN 65535 ELSE a END AS a, CASE WHEN a = 0 AND b = 0 THEN 65535 ELSE b END AS b
FROM (SELECT l_orderkey, l_linenumber, round(l_discount * 100)::INT AS a, round(l_tax * 100)::INT AS b FROM lineitem)""")
def zeros(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("a"), F.round(F.col("l_tax") * 100).cast("int").alias("b"))
    return t.select("l_orderkey", "l_linenumber", *S.zeros_to_nodata("a", "b"))


@query("b09_date_codec", """
SELECT o_orderkey, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 719163)::INT AS ordinal, (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000)::BIGINT AS ms,
       strftime(o_orderdate, '%Y%m%d')::INT AS compact, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INT AS days, o_orderdate::DATE AS back_ordinal, o_orderdate::DATE AS back_ms, o_orderdate::DATE AS back_compact FROM orders""", dates="back_ordinal back_ms back_compact")
def codec(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    t = t.select("o_orderkey", S.date_to_ordinal(F.col("d")).alias("ordinal"), S.date_to_ms(F.col("d")).alias("ms"), S.date_to_int(F.col("d")).alias("compact"), F.unix_date("d").alias("days"))
    return t.withColumns({"back_ordinal": S.ordinal_to_date(F.col("ordinal")), "back_ms": S.ms_to_date(F.col("ms")), "back_compact": S.int_to_date(F.col("compact"))})


@query("b10_b11_b12_text_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 AND year(o_orderdate) BETWEEN 1996 AND 1999 THEN o_orderdate::DATE END AS clean,
       CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%d%m%Y') END AS day_first, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate::DATE END AS parsed FROM orders""", dates="clean parsed")
def text_dates(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    t = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 5 == 4, "not a date").when(k % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "yyyyMMdd")).alias("a"),
        F.when(k % 5 == 4, "??").otherwise(F.date_format(day, " d/M/yyyy ")).alias("b"),
        F.when(k % 5 == 4, "x").otherwise(F.date_format(day, "dd,MM yyyy")).alias("c"),
    )
    return t.select("o_orderkey", S.clean_date(F.col("a"), 1996, 1999).alias("clean"), S.day_first(F.col("b")).alias("day_first"), S.parse_ddmmyyyy(F.col("c")).alias("parsed"))


@query("b13_integer_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS day FROM orders", dates="day")
def integer_dates(spark, d):
    code = F.when(F.col("o_orderkey") % 3 != 0, S.date_to_int(F.col("o_orderdate").cast("date"))).when(F.col("o_orderkey") % 2 == 0, 0)
    return table(spark, d, "orders").select("o_orderkey", S.int_to_date(code).alias("day"))


@query("b14_date_shifts", """
SELECT o_orderkey, o_orderdate::DATE - 5 AS before, o_orderdate::DATE + 5 AS after, (o_orderdate::DATE - INTERVAL 2 MONTH)::DATE AS two_months, (o_orderdate::DATE + INTERVAL 18 MONTH)::DATE AS later FROM orders""", dates="before after two_months later")
def shifts(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, -5).alias("before"), F.date_add(day, 5).alias("after"), F.add_months(day, -2).alias("two_months"), F.add_months(day, 18).alias("later"))


@query("b15_b16_b18_text", """
SELECT p_partkey, regexp_replace(p_name || ' - ' || p_type, '[^0-9A-Za-z]', '', 'g') AS bare, regexp_replace('[' || p_type || ']', '[\\[\\]]', '', 'g') AS open,
       p_name AS head, p_type AS tail, list_transform(string_split(replace(p_name, ' ', '_'), '_'), lambda s: s || '_EG') AS keys FROM part""")
def text(spark, d):
    both = F.concat("p_name", F.lit(" - "), "p_type")
    halves = F.split(both, " - ", 2)
    return table(spark, d, "part").select(
        "p_partkey", S.text_key(both).alias("bare"), S.unbracket(F.concat(F.lit("["), "p_type", F.lit("]"))).alias("open"),
        halves[0].alias("head"), halves[1].alias("tail"), S.id_keys(F.regexp_replace("p_name", " ", "_")).alias("keys"),
    )


@query("b17_loose_lists", "SELECT o_custkey, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS joined, count(DISTINCT o_orderdate::DATE)::INT AS n FROM orders GROUP BY 1")
def lists(spark, d):
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd"))), " , "), F.lit("]")).alias("s"))
    return t.select("o_custkey", F.array_join(S.loose_list(F.col("s")), ",").alias("joined"), F.size(S.loose_list(F.col("s"))).alias("n"))


@query("b19_b20_classes", """
SELECT o_orderkey, CASE WHEN m IN (1, 2, 11, 12) THEN 'winter' WHEN m IN (3, 4, 9, 10) THEN 'between' ELSE 'summer' END AS season,
       CASE WHEN p <= 0 THEN NULL WHEN p <= 50000 THEN 'small' WHEN p <= 150000 THEN 'middle' WHEN p <= 1000000 THEN 'large' END AS size
FROM (SELECT o_orderkey, month(o_orderdate) AS m, o_totalprice AS p FROM orders)""")
def classes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.month_class(F.month("o_orderdate")).alias("season"), S.area_class(F.col("o_totalprice"), [0, 50000, 150000, 1000000], ["small", "middle", "large"]).alias("size"))


@query("b21_digit_sum_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '1') AS k FROM orders) WHERE list_sum(list_transform(string_split(k[1:5], ''), lambda c: c::INT)) % 2 = 0")
def digit_sums(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 8, "1").alias("k"))
    return t.where(S.even_digit_sum(F.col("k"))).select("o_orderkey")


@query("b22_g5_areas", X.with_sql("parcels", """
SELECT id_gleba, round(area, 6) AS area, round(area / 10000, 9) AS ha
FROM (SELECT id_gleba, (3 + k % 5) * (2 + k % 3) + (3 + k % 5) * (k % 4) / 2.0 AS area FROM (SELECT id_gleba, id_gleba::BIGINT AS k FROM parcels)) WHERE area BETWEEN 10 AND 30"""))
def areas(spark, d):
    """Areas of gabled rings, whose width, height and gable depend on the key."""
    from loamwatch.functions import geometry as G

    k, x, y = F.col("id_gleba").cast("long"), F.col("minx"), F.col("miny")
    w, h = 3 + k % 5, 2 + k % 3
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    a = G.area(F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x + w / 2, y + h + k % 4), corner(x, y + h)))
    return X.parcels(spark, d).where(a.between(10, 30)).select("id_gleba", F.round(a, 6).alias("area"), F.round(a / 10000, 9).alias("ha"))


@query("b23_b24_interval_labels", X.with_sql("labels_px", """
SELECT id, l_linenumber, CASE WHEN ECCD1 = '1000-01-01' THEN start_date WHEN ECCD1 IS NOT NULL THEN ECCD1::DATE WHEN drop_date IS NOT NULL AND NC IS NULL THEN drop_date - 5 END AS data0,
       CASE WHEN ECCD2 = '1000-01-01' THEN end_date WHEN ECCD2 IS NOT NULL THEN ECCD2::DATE WHEN drop_date IS NOT NULL AND NC IS NULL THEN drop_date + 5 END AS data1,
       coalesce(drop_date, CASE WHEN l_quantity < 25 THEN start_date END) AS filled FROM labels_px"""), dates="data0 data1 filled")
def intervals(spark, d):
    t = X.pixel_labels(spark, d)
    drop = F.when(F.col("NC").isNull(), F.col("drop_date"))  # the shifted drop stands in only without an analyst's value
    ends = S.interval_ends(drop, F.col("ECCD1"), F.col("ECCD2"), F.col("start_date"), F.col("end_date"))
    return t.select("id", "l_linenumber", *ends, F.coalesce("drop_date", F.when(F.col("l_quantity") < 25, F.col("start_date"))).alias("filled"))


@query("b25_b26_day_differences", X.with_sql("labels_px", """
SELECT id, l_linenumber, date_diff('day', start_date, drop_date)::INT AS days, CASE WHEN drop_date + (l_quantity * 8)::INT - 200 < start_date THEN date_diff('day', start_date, drop_date + (l_quantity * 8)::INT - 200)
       WHEN drop_date + (l_quantity * 8)::INT - 200 > end_date THEN date_diff('day', end_date, drop_date + (l_quantity * 8)::INT - 200) ELSE 0 END::INT AS signed FROM labels_px WHERE drop_date IS NOT NULL"""))
def differences(spark, d):
    t = X.pixel_labels(spark, d).where(F.col("drop_date").isNotNull())
    moved = F.date_add("drop_date", (F.col("l_quantity") * 8).cast("int") - 200)
    return t.select("id", "l_linenumber", F.datediff("drop_date", "start_date").alias("days"), S.signed_distance(moved, F.col("start_date"), F.col("end_date")).alias("signed"))


@query("b27_ratios", X.with_sql("parcels acts", """
SELECT id_gleba, round(area_ha / n, 6) AS per_cut, trunc(area_ha / n)::INT AS whole FROM parcels JOIN (SELECT id_gleba, count(*) AS n FROM acts WHERE activity LIKE 'CORTE%' GROUP BY 1) USING (id_gleba)"""))
def ratios(spark, d):
    cuts = X.activities(spark, d).where(F.col("activity").startswith("CORTE")).groupBy("id_gleba").agg(F.count("*").alias("n"))
    r = F.col("area_ha") / F.col("n")
    return X.parcels(spark, d).join(cuts, "id_gleba").select("id_gleba", F.round(r, 6).alias("per_cut"), r.cast("int").alias("whole"))


@query("b28_b30_constants_casts", X.with_sql("obs seg", "SELECT x_coord AS longitude, y_coord AS latitude, flag, -1 AS mag, tEnd AS End_S, x_coord::SMALLINT % 1000 AS small, (y_coord || ',' || x_coord) AS coord FROM (SELECT * REPLACE (x_coord % 30000 AS x_coord) FROM seg)"))
def constants(spark, d):
    x = (F.col("x_coord") % 30000).cast("int")
    return X.segments(spark, d).select(x.alias("longitude"), F.col("y_coord").alias("latitude"), "flag", F.lit(-1).alias("mag"), F.col("tEnd").alias("End_S"), (x.cast("smallint") % 1000).alias("small"), F.concat_ws(",", "y_coord", x).alias("coord"))


@query("b29_subtiles", X.with_sql("obs pixels", "SELECT tile, x, y, 'part_' || (least(floor((x - 500000) * 6 / 95), 5) * 6 + least(floor((y - 4400000) * 6 / 1010), 5) + 1)::INT AS part FROM pixels"))
def subtiles(spark, d):
    return X.pixels(spark, d).select("tile", "x", "y", S.subtile(F.col("x"), F.col("y"), F.lit(500000), F.lit(4400000), F.lit(500095), F.lit(4401010)).alias("part"))


@query("b31_b32_attribute_filters", X.with_sql("ndvi", "SELECT id, day, round(med, 6) AS med FROM ndvi WHERE year(day) >= 1998 AND id = '7'"), dates="day")
def attributes(spark, d):
    return X.ndvi_median(spark, d).where("year(day) >= 1998 AND id = '7'").select("id", "day", F.round("med", 6).alias("med"))
