"""Sorts, limits, set operations (F); arrays and reshapes (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwatch.functions import geometry as G
from loamwatch.functions import scalars as S
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query
from loamwatch.session import table


@query("f01_sorted_series", X.with_sql("obs", "SELECT x, y, list(nir ORDER BY obs_date, l_orderkey, l_linenumber, nir) AS series FROM obs GROUP BY x, y"))
def series(spark, d):
    g = X.observations(spark, d).groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("obs_date", "l_orderkey", "l_linenumber", "nir"))).alias("s"))
    return g.select("x", "y", F.transform("s", lambda v: v["nir"]).alias("series"))


@query("f02_top_two", X.with_sql("obs seg", "SELECT x_coord, y_coord, flag, tBreak FROM seg QUALIFY row_number() OVER (PARTITION BY x_coord, y_coord ORDER BY tBreak DESC, flag) <= 2"))
def top_two(spark, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("x_coord", "y_coord").orderBy(F.desc("tBreak"), "flag"))
    return X.segments(spark, d).withColumn("n", n).where("n <= 2").select("x_coord", "y_coord", "flag", "tBreak")


@query("f03_f06_union_layers", X.with_sql("acts", "SELECT id_gleba, day, activity FROM acts WHERE activity = 'PLANT' UNION ALL SELECT id_gleba, day, activity FROM acts WHERE activity LIKE 'CORTE1%'"), dates="day")
def union(spark, d):
    a = X.activities(spark, d)
    return a.where("activity = 'PLANT'").select("id_gleba", "day", "activity").unionByName(a.where("activity LIKE 'CORTE1%'").select("day", "activity", "id_gleba"))


_LAYERS = X.with_sql("polys", """
SELECT row_number() OVER (ORDER BY label, id)::INT AS n, label, id, day FROM (
 SELECT 'mix' AS label, buffer_id::VARCHAR AS id, CASE WHEN buffer_id % 2 = 0 THEN DATE '2018-05-06' END AS day FROM polys
 UNION ALL SELECT 'cut', lpad(o_orderkey::VARCHAR, 7, '0'), NULL FROM orders WHERE list_sum(list_transform(string_split(lpad(o_orderkey::VARCHAR, 7, '0')[1:5], ''), lambda c: c::INT)) % 2 = 0)""")


@query("f04_harmonised_layers", _LAYERS, dates="day")
def layers(spark, d):
    from loamwatch.operators.relations import surrogate_keys

    area = G.area(F.col("ring"))
    mix = X.polygons(spark, d).where(area.between(500, 1_000_000)).select(F.lit("mix").alias("label"), F.col("buffer_id").cast("string").alias("id"), S.clean_date(F.when(F.col("buffer_id") % 2 == 0, "20180506").otherwise("20300101")).alias("day"))
    o = table(spark, d, "orders").select(F.lit("cut").alias("label"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0").alias("id"), F.lit(None).cast("date").alias("day"))
    both = mix.unionByName(o.where(S.even_digit_sum(F.col("id"))))
    return surrogate_keys(both, ["label", "id"], "n").select(F.col("n").cast("int").alias("n"), "label", "id", "day")


@query("f05_distinct", X.with_sql("acts", "SELECT DISTINCT id_gleba, activity FROM acts"))
def distinct(spark, d):
    return X.activities(spark, d).select("id_gleba", "activity").dropDuplicates()


@query("f07_seeded_sample", X.with_sql("obs", "SELECT x, y, l_orderkey, l_linenumber FROM obs ORDER BY md5(concat_ws(' ', 123, l_orderkey, l_linenumber)), l_orderkey, l_linenumber LIMIT 1000"))
def sample(spark, d):
    """A fixed sample of 1,000 pixels' observations, by a hash of seed and key: the feature is the size of the sample."""
    return X.observations(spark, d).orderBy(F.md5(F.concat_ws(" ", F.lit(123), "l_orderkey", "l_linenumber")), "l_orderkey", "l_linenumber").limit(1000).select("x", "y", "l_orderkey", "l_linenumber")


@query("g01_parallel_explode", X.with_sql("obs seg", "SELECT x_coord, y_coord, CASE WHEN keep THEN tBreak END AS tBreak, CASE WHEN keep THEN changeProb END AS changeProb FROM (SELECT DISTINCT x_coord, y_coord, keep, CASE WHEN keep THEN tBreak END AS tBreak, CASE WHEN keep THEN changeProb END AS changeProb, CASE WHEN keep THEN flag END AS flag FROM (SELECT *, x_coord % 20 = 0 AS keep FROM seg))"))
def parallel(spark, d):
    g = X.segments(spark, d).groupBy("x_coord", "y_coord").agg(F.array_sort(F.collect_list(F.struct("tBreak", "changeProb", "flag"))).alias("l"))
    l = F.when(F.col("x_coord") % 20 == 0, F.col("l")).otherwise(F.array().cast("array<struct<tBreak:bigint,changeProb:int,flag:string>>"))
    t = g.select("x_coord", "y_coord", F.transform(l, lambda v: v["tBreak"]).alias("tBreak"), F.transform(l, lambda v: v["changeProb"]).alias("changeProb"))
    return t.select("x_coord", "y_coord", F.explode_outer(F.arrays_zip("tBreak", "changeProb")).alias("z")).select("x_coord", "y_coord", "z.tBreak", "z.changeProb")


@query("g03_analyst_rows", X.with_sql("obs seg", """
SELECT x_coord, y_coord, flag, 1 AS part, start_date AS day, 'a' || changeProb AS kind FROM seg UNION ALL SELECT x_coord, y_coord, flag, 2, end_date, 'b' || changeProb FROM seg WHERE changeProb > 0"""), dates="day")
def analyst(spark, d):
    s = X.segments(spark, d).select("x_coord", "y_coord", "flag", F.col("start_date").alias("data_1"), F.concat(F.lit("a"), "changeProb").alias("tipo_1"), F.when(F.col("changeProb") > 0, F.col("end_date")).alias("data_3"), F.concat(F.lit("b"), "changeProb").alias("tipo_2"))
    from loamwatch.operators.validation import analyst_rows

    return analyst_rows(s, ["x_coord", "y_coord", "flag"], [("data_1", "tipo_1"), ("data_3", "tipo_2")], ["data_1", "data_3"]).select("x_coord", "y_coord", "flag", "part", F.col("data").alias("day"), F.col("tipo").alias("kind"))


@query("g04_single_parts", X.with_sql("parcels", """
SELECT id_gleba, p::INT AS part, (1 + k % 3)::INT AS parts, (2 + p + k % 4) * (1.0 + k % 2) AS area FROM (SELECT id_gleba, id_gleba::BIGINT AS k FROM parcels), (SELECT unnest([0, 1, 2]) AS p) WHERE p <= k % 3"""))
def parts(spark, d):
    """One to three parts of different sizes."""
    k, x, y = F.col("id_gleba").cast("long"), F.col("minx"), F.col("miny")
    rings = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda p: G.rectangle(x + 100 * p, y, x + 100 * p + 2 + p + k % 4, y + 1 + k % 2))
    t = X.parcels(spark, d).select("id_gleba", F.size(rings).alias("parts"), F.posexplode(rings).alias("part", "r"))
    return t.select("id_gleba", "part", "parts", F.round(G.area(F.col("r")), 6).alias("area"))


_DESIGN = "cos(w) AS c1, sin(w) AS s1, cos(2 * w) AS c2, sin(2 * w) AS s2, cos(3 * w) AS c3, sin(3 * w) AS s3"


@query("g06_h07_fitted_curve", X.with_sql("obs seg", """
SELECT x_coord, y_coord, flag, day, round(k[1] + 0.01 * (t - 728000) + k[2] * cos(w) + k[3] * sin(w) + k[4] * cos(2 * w) + k[5] * sin(2 * w) + k[6] * cos(3 * w) + k[7] * sin(3 * w), 6) AS value FROM (
SELECT *, date_diff('day', DATE '1970-01-01', day) + 719163 AS t, 2 * pi() * (date_diff('day', DATE '1970-01-01', day) + 719163) / 365.2425 AS w FROM (SELECT x_coord, y_coord, flag, [100 + x_coord % 7, y_coord % 11, changeProb / 10, 3, 2, x_coord % 3, 0.5] AS k, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY))::DATE AS day FROM seg))"""), dates="day")
def curve(spark, d):
    from loamwatch.functions.harmonics import predicted

    x, y = F.col("x_coord"), F.col("y_coord")
    own = F.array(*[c.cast("double") for c in (F.lit(0.01), y % 11, F.col("changeProb") / 10, F.lit(3), F.lit(2), x % 3, F.lit(0.5))])
    s = X.segments(spark, d).select("x_coord", "y_coord", "flag", (100 + x % 7 - 7280.0).alias("intercept"), own.alias("own"), F.explode(F.sequence("start_date", "end_date")).alias("day"))
    return s.select("x_coord", "y_coord", "flag", "day", F.round(predicted(S.date_to_ordinal(F.col("day")), F.col("intercept"), F.col("own")), 6).alias("value"))
