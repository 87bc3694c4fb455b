"""Window functions (E)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.operators import windows as O
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query

KEY = ["x_coord", "y_coord"]


@query("e01_break_flags", X.with_sql("obs seg", "SELECT x_coord, y_coord, flag, lead(tStart) OVER (PARTITION BY x_coord, y_coord ORDER BY tStart, flag) IS NOT NULL AS is_break FROM seg"))
def flags(spark, d):
    s = X.segments(spark, d).withColumn("at", F.struct("tStart", "flag"))
    return O.break_flags(s, KEY, "at").select(*KEY, "flag", "is_break")


@query("e02_break_pick", X.with_sql("obs seg", """
SELECT x_coord, y_coord, tBreak, flag FROM (SELECT *, row_number() OVER (PARTITION BY x_coord, y_coord ORDER BY tBreak DESC, flag) AS r, count(*) OVER (PARTITION BY x_coord, y_coord) AS n
FROM seg WHERE tBreak BETWEEN 800000000000 AND 1003000000000) WHERE r = 2 OR (n = 1 AND r = 1)"""))
def pick(spark, d):
    return O.pick_break(X.segments(spark, d), KEY, 800000000000, 1003000000000, ties=["flag"]).select(*KEY, "tBreak", "flag")


@query("e03_probability_fix", X.with_sql("obs seg", "SELECT x_coord, y_coord, flag, CASE WHEN count(*) OVER w > 1 AND tBreak <> max(tBreak) OVER w THEN 1.0 ELSE changeProb / 100 END AS p FROM seg WINDOW w AS (PARTITION BY x_coord, y_coord)"))
def probability(spark, d):
    return O.fix_probability(X.segments(spark, d), KEY).select(*KEY, "flag", F.col("changeProb").alias("p"))


@query("e04_group_statistics", X.with_sql("obs seg", "SELECT x_coord, y_coord, flag, min(tStart) OVER w AS start_min, ceil(sum(changeProb / 100) OVER w)::INT AS breaks, count(*) OVER w AS n FROM seg WINDOW w AS (PARTITION BY x_coord, y_coord)"))
def statistics(spark, d):
    w = W.partitionBy(*KEY)
    return X.segments(spark, d).select(*KEY, "flag", F.min("tStart").over(w).alias("start_min"), F.ceil(F.sum(F.col("changeProb") / 100).over(w)).cast("int").alias("breaks"), F.count("*").over(w).alias("n"))


_STEPS = """
grid AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM ndvi)),
steps AS (SELECT a.id, g.nxt AS moment, b.med - a.med AS step FROM ndvi a JOIN grid g ON a.day = g.day JOIN ndvi b ON b.id = a.id AND b.day = g.nxt WHERE b.med - a.med IS NOT NULL)
SELECT id, round("drop", 6) AS "drop", drop_date FROM (SELECT DISTINCT id FROM ndvi) LEFT JOIN (SELECT id, min(step) AS "drop", arg_min(moment, {'a': step, 'b': moment}) AS drop_date FROM steps GROUP BY 1) USING (id)"""


@query("e05_biggest_drop", "WITH ndvi AS (" + X.SQL["ndvi"] + ")," + _STEPS, dates="drop_date")
def drop(spark, d):
    return O.biggest_drop(X.ndvi_median(spark, d), "id", "day", "med").withColumn("drop", F.round("drop", 6))


_SESSIONS = X.with_sql("acts", """
SELECT id_gleba, seq, min(day) AS start, max(day) AS stop FROM (
  SELECT id_gleba, day, 1 + sum(CASE WHEN gap > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY id_gleba ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING) AS seq
  FROM (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY id_gleba ORDER BY day, o_orderkey), day) AS gap FROM acts))
WHERE id_gleba IN (SELECT id_gleba FROM acts GROUP BY 1 HAVING count(*) < 3 OR count(DISTINCT day) > 1) GROUP BY 1, 2""")


@query("e06_gap_sessions", _SESSIONS, dates="start stop")
def sessions(spark, d):
    return O.gap_sessions(X.activities(spark, d), "id_gleba", "day", 400).select("id_gleba", "seq", "start", F.col("end").alias("stop"))


_ANCHORED = """
WITH RECURSIVE acts AS (SELECT DISTINCT o_custkey::VARCHAR AS id_gleba, o_orderdate::DATE AS day FROM orders),
steps AS (
  SELECT id_gleba, 1 AS seq, min(day) AS start FROM acts GROUP BY 1
  UNION ALL
  SELECT s.id_gleba, s.seq + 1, (SELECT min(a.day) FROM acts a WHERE a.id_gleba = s.id_gleba AND a.day > s.start + 400) FROM steps s
  WHERE EXISTS (SELECT 1 FROM acts a WHERE a.id_gleba = s.id_gleba AND a.day > s.start + 400))
SELECT id_gleba, seq, start, (SELECT max(a.day) FROM acts a WHERE a.id_gleba = s.id_gleba AND a.day BETWEEN s.start AND s.start + 400) AS stop FROM steps s"""


@query("e07_anchored_intervals", _ANCHORED, dates="start stop")
def anchored(spark, d):
    return O.anchored_intervals(X.activities(spark, d), "id_gleba", "day", 400).withColumnRenamed("end", "stop")


@query("e08_first_interval", "SELECT id_gleba, start, stop FROM (" + _SESSIONS + ") QUALIFY row_number() OVER (PARTITION BY id_gleba ORDER BY seq) = 1", dates="start stop")
def first_interval(spark, d):
    s = O.gap_sessions(X.activities(spark, d), "id_gleba", "day", 400)
    b = s.groupBy("id_gleba").agg(F.min_by(F.struct("start", "end"), "seq").alias("b"))
    return b.select("id_gleba", "b.start", F.col("b.end").alias("stop"))


@query("e09_e10_keys", X.with_sql("acts", """
SELECT id_gleba, o_orderkey, id_gleba || '_' || CASE WHEN r < 10 THEN '0' ELSE '' END || r AS talhao, row_number() OVER (ORDER BY o_orderkey)::INT AS n
FROM (SELECT *, row_number() OVER (PARTITION BY id_gleba ORDER BY day, o_orderkey) AS r FROM acts)"""))
def keys(spark, d):
    a = X.activities(spark, d)
    r = F.row_number().over(W.partitionBy("id_gleba").orderBy("day", "o_orderkey")).cast("string")
    padded = F.when(F.length(r) < 2, F.lpad(r, 2, "0")).otherwise(r)
    # a global number needs one order over all rows: range-partitioned runs, numbered by the counts before them
    from loamwatch.operators.relations import surrogate_keys

    return surrogate_keys(a.select("id_gleba", "o_orderkey", F.concat_ws("_", "id_gleba", padded).alias("talhao")), ["o_orderkey"], "n").withColumn("n", F.col("n").cast("int"))


@query("e11_nearest_analyst", X.with_sql("obs seg", "SELECT x_coord, y_coord, flag, min(abs(date_diff('day', start_date, end_date) - 2000)) OVER (PARTITION BY x_coord, y_coord)::INT AS nearest FROM seg"))
def nearest(spark, d):
    delta = F.abs(F.datediff("end_date", "start_date") - 2000)
    return X.segments(spark, d).select(*KEY, "flag", F.min(delta).over(W.partitionBy(*KEY)).alias("nearest"))


@query("e12_around_reference", X.with_sql("obs", """
SELECT x, y, 1 AS one, list(n ORDER BY r) FILTER (WHERE side) AS before, list(n ORDER BY r) FILTER (WHERE NOT side) AS after FROM (
 SELECT *, row_number() OVER (PARTITION BY x, y, side ORDER BY CASE WHEN side THEN -epoch(obs_date) ELSE epoch(obs_date) END, CASE WHEN side THEN -l_orderkey ELSE l_orderkey END, CASE WHEN side THEN -l_linenumber ELSE l_linenumber END) AS r
 FROM (SELECT x, y, obs_date, l_orderkey, l_linenumber, nir AS n, obs_date <= DATE '1998-06-01' AS side FROM obs)) WHERE r <= 5 GROUP BY x, y"""))
def around(spark, d):
    o = X.observations(spark, d).withColumn("ref", F.lit("1998-06-01").cast("date"))
    t = O.around(o, ["x", "y"], "obs_date", "ref", 5, ["nir"], ["l_orderkey", "l_linenumber"])
    return t.select("x", "y", F.lit(1).alias("one"), F.transform("before", lambda s: s["nir"]).alias("before"), F.transform("after", lambda s: s["nir"]).alias("after"))


@query("e13_first_of_duplicates", X.with_sql("obs", "SELECT x, y, obs_date, l_orderkey, l_linenumber, nir FROM obs QUALIFY row_number() OVER (PARTITION BY x, y, obs_date ORDER BY l_orderkey, l_linenumber) = 1"), dates="obs_date")
def first_of(spark, d):
    n = F.row_number().over(W.partitionBy("x", "y", "obs_date").orderBy("l_orderkey", "l_linenumber"))
    return X.observations(spark, d).withColumn("n", n).where("n = 1").select("x", "y", "obs_date", "l_orderkey", "l_linenumber", "nir")


@query("e14_break_palette", X.with_sql("obs seg", """
SELECT day, dense_rank() OVER (ORDER BY year(day))::INT - 1 AS year_index, round((dayofyear(day) - 1) / 365.0, 6) AS position, round(0.9 - 0.4 * (dayofyear(day) - 1) / 365.0, 6) AS brightness FROM (SELECT DISTINCT end_date AS day FROM seg)"""), dates="day")
def palette(spark, d):
    days = X.segments(spark, d).select(F.col("end_date").alias("day")).distinct()
    years = days.select(F.year("day").alias("y")).distinct().withColumn("year_index", F.row_number().over(W.orderBy("y")) - 1)  # one row a year
    p = (F.dayofyear("day") - 1) / 365.0
    return days.join(F.broadcast(years), F.year("day") == F.col("y")).select("day", "year_index", F.round(p, 6).alias("position"), F.round(0.9 - 0.4 * p, 6).alias("brightness"))
