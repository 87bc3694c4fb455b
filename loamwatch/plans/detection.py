"""Detection queries (H) and the break map."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loamwatch.functions import harmonics as HM
from loamwatch.functions import scalars as S
from loamwatch.operators import detection as D
from loamwatch.operators import windows as O
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query

ORDER = ["l_orderkey", "l_linenumber", "nir", "red", "swir2"]
PX = ["tile", "x", "y"]


def segments(spark, d):
    return D.detect_segments(X.observations(spark, d), order=ORDER)


@query("h01_detect_segments")
def detect(spark, d):
    return segments(spark, d).select("tile", "x_coord", "y_coord", "tStart", "tEnd", "tBreak", "changeProb", "greenStart", "greenEnd", F.round("intercept_values", 3).alias("intercept"))


@query("break_map")
def break_map(spark, d):
    """Pixels with their picked break as YYYYMMDD."""
    s = segments(spark, d).where("tBreak IS NOT NULL").select("tile", "x_coord", "y_coord", "tStart", "tBreak")
    picked = O.pick_break(s, ["tile", "x_coord", "y_coord"], ties=["tStart"])
    return picked.select("tile", "x_coord", "y_coord", S.date_to_int(S.ms_to_date(F.col("tBreak"))).alias("yyyymmdd"))


@query("h08_harmonic_fit")
def fit(spark, d):
    t = D.harmonic_fit(X.observations(spark, d), order=ORDER)
    return t.select("tile", "x", "y", "band", F.round("rmse", 3).alias("rmse"), F.round(F.get("coefficients", 1), 3).alias("cos1"), F.round(F.get("coefficients", 0), 6).alias("slope"))


@query("h09_outlier_mask")
def outliers(spark, d):
    return D.outlier_flags(X.observations(spark, d), order=ORDER).groupBy(*PX).agg(F.count_if("outlier").alias("outliers"), F.count("*").alias("n"))


_ORD = "(date_diff('day', DATE '1970-01-01', obs_date) + 719163)"


@query("h07_design_columns", X.with_sql("obs", f"SELECT l_orderkey, l_linenumber, x, round(cos(w), 6) AS c1, round(sin(w), 6) AS s1, round(cos(3 * w), 6) AS c3 FROM (SELECT *, 2 * pi() * {_ORD} / 365.2425 AS w FROM obs)"))
def design(spark, d):
    c = HM.design(S.date_to_ordinal(F.col("obs_date")))
    return X.observations(spark, d).select("l_orderkey", "l_linenumber", "x", F.round(c[1], 6).alias("c1"), F.round(c[2], 6).alias("s1"), F.round(c[5], 6).alias("c3"))


def flat_fit(t, y, terms, alpha, year):
    """A fitter that SQL can repeat: the mean of each band."""
    return [D.Fit(np.zeros(7), float(v.mean()), float(v.std()), v - v.mean()) for v in y]


def scores(spark, d):
    return D.series_scores(X.observations(spark, d), D.replace(D.Parameters(), fitter=flat_fit), ORDER)


_BANDS = ("ndvi", "green", "swir2")
_each = lambda form, sep=", ": sep.join(form.format(b=b) for b in _BANDS)
# clean series in order, the least lag whose commonest gap is wide, pairs at that lag and at one, the kernel's variogram of each band, and the flat fit
_SERIES = f""",
o AS (SELECT tile, x, y, {_ORD} AS t, obs_date, 10000.0 * (nir - red) / (nir + red) AS ndvi, green, swir2, row_number() OVER (PARTITION BY tile, x, y ORDER BY obs_date, l_orderkey, l_linenumber, nir, red, swir2) AS i FROM obs WHERE green <> 65535 AND nir + red > 0),
lags(tile, x, y, k, mode) AS (SELECT DISTINCT tile, x, y, 0::BIGINT, 0::BIGINT FROM o UNION ALL
 SELECT tile, x, y, k, arg_max(gap, {{'a': n, 'b': -gap}}) FROM (SELECT r.tile, r.x, r.y, r.k + 1 AS k, (a.t - b.t)::BIGINT AS gap, count(*) AS n FROM lags r JOIN o a USING (tile, x, y) JOIN o b ON b.tile = a.tile AND b.x = a.x AND b.y = a.y AND b.i = a.i - r.k - 1 WHERE r.mode <= 30 GROUP BY ALL) GROUP BY ALL),
chosen AS (SELECT tile, x, y, k FROM lags WHERE mode > 30),
pairs AS (SELECT a.tile, a.x, a.y, c.k, a.t - b.t AS gap, {_each('abs(a.{b} - b.{b}) AS {b}')} FROM (FROM chosen UNION SELECT DISTINCT tile, x, y, 1 FROM o) c JOIN o a USING (tile, x, y) JOIN o b ON b.tile = a.tile AND b.x = a.x AND b.y = a.y AND b.i = a.i - c.k),
vario AS (SELECT f.tile, f.x, f.y, {_each('coalesce(w.{b}, f.{b}) AS v_{b}')} FROM (SELECT tile, x, y, {_each('median({b}) AS {b}')} FROM pairs WHERE k = 1 GROUP BY ALL) f
 LEFT JOIN (SELECT tile, x, y, {_each('median({b}) AS {b}')} FROM pairs JOIN chosen USING (tile, x, y, k) WHERE gap > 30 GROUP BY ALL) w USING (tile, x, y)),
flat AS (SELECT tile, x, y, count(*) AS n, {_each('avg({b}) AS m_{b}, stddev_pop({b}) AS s_{b}')}, greatest(6, CASE WHEN median(g) > 0 THEN round_even(96 / median(g), 0) ELSE 6 END)::INT AS peek FROM (SELECT *, t - lag(t) OVER (PARTITION BY tile, x, y ORDER BY i) AS g FROM o) GROUP BY ALL),
limits AS (SELECT unnest({list(range(6, 97))}) AS peek, unnest({[round(D.chi2_quantile(1 - (1 - 0.999) ** (6 / k)), 9) for k in range(6, 97)]}) AS lim)
"""
_sql = lambda body: X.with_sql("obs", _SERIES + body).replace("WITH obs", "WITH RECURSIVE obs").replace("\n,\n", ",\n")


@query("h10_h11_h12_change_scores", _sql(f"""
SELECT tile, x, y, round(any_value(u), 5) AS instability, (count(*) FILTER (WHERE m > lim))::INT AS over, (count(*) FILTER (WHERE m > 30.66485))::INT AS extreme, round(min(m), 5) AS least, round(max(m), 5) AS most FROM (
SELECT tile, x, y, lim, {_each('power(abs({b} - m_{b}) / greatest(v_{b}, s_{b}), 2)', ' + ')} AS m, u FROM o JOIN flat USING (tile, x, y) JOIN vario USING (tile, x, y) JOIN limits USING (peek) JOIN (
 SELECT tile, x, y, {_each('power((abs(arg_min({b}, i) - any_value(m_{b})) + abs(arg_max({b}, i) - any_value(m_{b}))) / greatest(any_value(v_{b}), any_value(s_{b})), 2)', ' + ')} AS u FROM o JOIN flat USING (tile, x, y) JOIN vario USING (tile, x, y) GROUP BY ALL) USING (tile, x, y)) GROUP BY ALL"""))
def change_scores(spark, d):
    """Instability and squared deviations over the noise, against the limits, as the kernel computes them."""
    return scores(spark, d).select(*PX, F.round("instability", 5).alias("instability"), "over", "extreme", F.round("least", 5).alias("least"), F.round("most", 5).alias("most"))


@query("h13_thresholds", _sql("SELECT tile, x, y, peek, round(lim, 5) AS change_limit, 30.66485::DOUBLE AS outlier_limit FROM flat JOIN limits USING (peek)"))
def thresholds(spark, d):
    """Limits of each pixel; the one of a change falls as its peek grows."""
    return scores(spark, d).select(*PX, "peek", F.round("change_limit", 5).alias("change_limit"), F.round("outlier_limit", 5).alias("outlier_limit"))


@query("h14_seasonal_neighbours", _sql("""
SELECT tile, x, y, round(sqrt(sum(power(ndvi - m_ndvi, 2))) / 4, 5) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY tile, x, y ORDER BY abs(round_even((t - t_at) / 365.25, 0) * 365.25 - (t - t_at)), i) AS r
FROM (SELECT *, max(t) OVER (PARTITION BY tile, x, y) AS t_at FROM o)) JOIN flat USING (tile, x, y) WHERE r <= 24 GROUP BY ALL"""))
def seasonal(spark, d):
    return scores(spark, d).select(*PX, F.round("seasonal", 5).alias("rmse"))


@query("h15_h16_sufficiency", _sql("""
SELECT tile, x, y, count(*) >= 12 AS enough, max(t) - min(t) >= 365 AS long_enough, CASE WHEN count(*) / 3 < 6 THEN 4 WHEN count(*) / 3 < 8 THEN 6 ELSE 8 END AS terms, (min(t) FILTER (WHERE t - f >= 365))::INT AS year_on
FROM (SELECT *, min(t) OVER (PARTITION BY tile, x, y) AS f FROM o) GROUP BY ALL"""))
def sufficiency(spark, d):
    return scores(spark, d).select(*PX, "enough", "long_enough", "terms", "year_on")


@query("g02_edge_values")
def edges(spark, d):
    """Band values at the edges of each segment: first, second, last but one, last."""
    names = [f"{b}{e}" for b in D.BANDS for e in ("Start", "Start2", "End", "End2")]
    return segments(spark, d).select("tile", "x_coord", "y_coord", "tStart", "tEnd", *names)


@query("g02_edge_values_of_dates", X.with_sql("obs seg", f""",
o AS (SELECT tile, x, y, obs_date, green, red, nir, swir2, row_number() OVER (PARTITION BY tile, x, y ORDER BY obs_date, l_orderkey, l_linenumber) AS r, count(*) OVER (PARTITION BY tile, x, y) AS n FROM obs WHERE green <> 65535 AND nir + red > 0),
first AS (SELECT s.tile, x_coord, y_coord, flag, any_value(n) AS n, least(count(*) FILTER (WHERE obs_date < start_date) + 1, any_value(n)) AS i, least(count(*) FILTER (WHERE obs_date < end_date) + 1, any_value(n)) AS j
 FROM seg s JOIN o ON o.tile = s.tile AND x = x_coord AND y = y_coord GROUP BY ALL),
places AS (SELECT tile, x_coord, y_coord, flag, unnest([{{'k': 'Start', 'r': i}}, {{'k': 'Start2', 'r': least(i + 1, n)}}, {{'k': 'End', 'r': j}}, {{'k': 'End2', 'r': greatest(j - 1, 1)}}]) AS p FROM first)
SELECT q.tile, x_coord, y_coord, flag, {", ".join(f"(max({b}) FILTER (WHERE p.k = '{e}'))::DOUBLE AS {b}{e}" for b in ("green", "red", "nir", "swir2") for e in ("Start", "Start2", "End", "End2"))}
FROM places q JOIN o ON o.tile = q.tile AND x = x_coord AND y = y_coord AND o.r = p.r GROUP BY ALL""").replace("\n,\n", ",\n"))
def edges_of_dates(spark, d):
    """The same values over given dates of segments."""
    found = D.edge_values(D.series_of(X.observations(spark, d), ["l_orderkey", "l_linenumber"]), X.segments(spark, d))
    return found.select("tile", "x_coord", "y_coord", "flag", *[f"{b}{e}" for b in D.BANDS for e in ("Start", "Start2", "End", "End2")])


@query("g06_detected_curve")
def detected_curve(spark, d):
    """The fitted NDVI of each day of the segments that detection finds, by their own coefficients."""
    s = segments(spark, d).where("tStart IS NOT NULL")
    days = s.select("tile", "x_coord", "y_coord", "tStart", "intercept_values", "coeficientes", F.explode(F.sequence(S.ms_to_date(F.col("tStart")), S.ms_to_date(F.col("tEnd")))).alias("day"))
    value = HM.predicted(S.date_to_ordinal(F.col("day")), F.col("intercept_values"), F.col("coeficientes"))
    return days.select("tile", "x_coord", "y_coord", "tStart", F.col("day").cast("string").alias("day"), F.round(value, 3).alias("value"))


@query("h01_models")
def models(spark, d):
    """The full record of each segment, one row a band."""
    t = D.detect_models(X.observations(spark, d), order=ORDER).select(*PX, "segment", "start_day", "end_day", "break_day", "observation_count", "change_probability", F.explode("bands").alias("b"))
    return t.select(*PX, "segment", "start_day", "end_day", "break_day", "observation_count", "change_probability", "b.band", *[F.round(f"b.{c}", 3).alias(c) for c in ("magnitude", "rmse", "intercept")], F.transform("b.coefficients", lambda v: F.round(v, 6)).alias("coefficients"))


@query("j03_grouped_function", X.with_sql("obs", "SELECT tile, x, y, count(*)::INT AS n, round(max(nir) - min(nir), 6)::DOUBLE AS span FROM obs GROUP BY ALL"))
def grouped(spark, d):
    """A user function of a pixel's frame."""

    def spread(pdf):
        return pdf.head(1)[PX].assign(n=len(pdf), span=float(pdf["nir"].max() - pdf["nir"].min()))

    return X.observations(spark, d).select(*PX, "nir").groupBy(*PX).applyInPandas(spread, "tile string, x int, y int, n int, span double")


@query("j01_j02_own_fitter", X.with_sql("obs", """
SELECT tile, x, y, round(avg(10000.0 * (nir - red) / (nir + red)), 4) AS intercept, round(stddev_pop(10000.0 * (nir - red) / (nir + red)), 4) AS rmse FROM obs WHERE green <> 65535 GROUP BY ALL HAVING count(*) > 4"""))
def own_fitter(spark, d):
    """The fitter is an argument: here a flat one."""
    t = D.harmonic_fit(X.observations(spark, d), 4, D.replace(D.Parameters(), fitter=flat_fit), ORDER)
    return t.where("band = 'ndvi'").select("tile", "x", "y", F.round("intercept", 4).alias("intercept"), F.round("rmse", 4).alias("rmse"))
