"""Validation (I1 to I4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamwatch.operators import aggregates as A
from loamwatch.operators import spatial as P
from loamwatch.operators import validation as V
from loamwatch.operators import windows as O
from loamwatch.plans import fixtures as X
from loamwatch.plans.registry import query

START, END = 800000000000, 1003000000000
_FIXED = """,
fixed AS (SELECT * REPLACE (CASE WHEN count(*) OVER w > 1 AND tBreak <> max(tBreak) OVER w THEN 1.0 ELSE changeProb / 100 END AS changeProb) FROM seg WINDOW w AS (PARTITION BY x_coord, y_coord)),
flagged AS (SELECT *, min(tStart) OVER w AS startMin, ceil(sum(changeProb) OVER w)::INT AS numBreak, changeProb > 0 AND changeProb < 1 AS part, tBreak > 800000000000 AND tBreak < 1003000000000 AND NOT (changeProb > 0 AND changeProb < 1) AS inside FROM fixed WINDOW w AS (PARTITION BY x_coord, y_coord)),
nulled AS (SELECT * REPLACE (CASE WHEN inside THEN tBreak END AS tBreak) FROM flagged),
marked AS (SELECT *, max(tBreak) OVER (PARTITION BY x_coord, y_coord) IS NOT NULL AS has FROM nulled),
kept AS (SELECT *, count(*) OVER (PARTITION BY x_coord, y_coord) AS n FROM marked WHERE NOT (tBreak IS NULL AND (numBreak > 1 OR (numBreak = 1 AND NOT inside AND tStart = startMin)))),
period AS (SELECT x_coord, y_coord, flag, tStart, tBreak, changeProb FROM kept WHERE NOT (n = 2 AND changeProb = 0 AND numBreak = 1)
 UNION ALL SELECT x_coord, y_coord, flag, tStart, tBreak, changeProb FROM marked WHERE tBreak IS NULL AND NOT has AND (part OR (changeProb = 0 AND numBreak > 1)))
"""


def _period(spark, d):
    s = O.fix_probability(X.segments(spark, d), V.COORD)
    return V.period_filter(s, START, END).select(*V.COORD, "flag", "tStart", "tBreak", "changeProb")


@query("i01_period_filter", X.with_sql("obs seg", _FIXED + "SELECT * FROM period").replace("\n,\n", ",\n"))
def period(spark, d):
    return _period(spark, d)


def reference_rows(spark, d):
    """Segments of the period at the polygons, one row an analyst date: coordinate, nome, id, analysts, tBreak, delta_min, tipo, altera, border."""
    points = _period(spark, d).withColumn("id", F.concat_ws("_", *V.COORD, "flag", "tStart"))
    hit = P.point_pairs(points, X.polygons(spark, d), 40.0, *V.COORD, border=10.0)
    k = F.col("buffer_id")
    first = F.when(k % 8 == 0, F.lit("2000-03-01").cast("date"))
    second = F.when(k % 12 == 0, F.lit("2001-08-01").cast("date"))
    t = hit.select(*V.COORD, "id", "buffer_id", "tBreak", "border", first.alias("data_1"), second.alias("data_3"), F.lit("Corte").alias("tipo_1"), F.lit("Corte").alias("tipo_2"))
    an = F.col("data_1").isNotNull().cast("int") + (F.col("data_1").isNotNull() & F.col("data_3").isNotNull()).cast("int")
    keep = [*V.COORD, "id", "buffer_id", "tBreak", "border", "analysts"]
    rows = V.analyst_rows(t.withColumn("analysts", an), keep, [("data_1", "tipo_1"), ("data_3", "tipo_2")], ["data_1", "data_3"])
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("tBreak") / 86400000).cast("int"))
    return rows.withColumn("delta_min", F.datediff(day, "data")).withColumn("nome", F.concat_ws("_", "buffer_id", "part"))


_B = lambda c: f"coalesce(({c}), false)::INT"
_CLASSES = _FIXED + f""",
points AS (SELECT p.*, x_coord || '_' || y_coord || '_' || flag || '_' || tStart AS id, buffer_id, least(x_coord - minx, maxx - x_coord, y_coord - miny, maxy - y_coord) < 10 AS border,
 CASE WHEN buffer_id % 8 = 0 THEN DATE '2000-03-01' END AS data_1, CASE WHEN buffer_id % 12 = 0 THEN DATE '2001-08-01' END AS data_3 FROM period p JOIN polys ON x_coord >= minx AND x_coord < maxx AND y_coord >= miny AND y_coord < maxy),
dated AS (SELECT x_coord, y_coord, id, buffer_id, tBreak, border, (data_1 IS NOT NULL)::INT + (data_1 IS NOT NULL AND data_3 IS NOT NULL)::INT AS an, part, CASE part WHEN 1 THEN data_1 ELSE data_3 END AS data
 FROM points, (SELECT unnest([1, 2]) AS part) WHERE part = 1 OR (data_1 IS NOT NULL AND data_3 IS NOT NULL)),
refs AS (SELECT *, buffer_id || '_' || part AS nome, date_diff('day', data, DATE '1970-01-01' + (tBreak // 86400000)::INT) AS delta_min FROM dated),
c1 AS (SELECT *, count(tBreak) OVER (PARTITION BY x_coord, y_coord, nome) AS vb, abs(delta_min) AS d FROM refs),
c2 AS (SELECT *, CASE WHEN an = 2 AND vb < 2 THEN min(d) FILTER (WHERE an = 2 AND vb < 2) OVER (PARTITION BY x_coord, y_coord) ELSE min(d) OVER (PARTITION BY x_coord, y_coord, nome) END AS m, min(d) OVER (PARTITION BY x_coord, y_coord) AS nearest FROM c1),
c3 AS (SELECT *, {_B('d <= 60 AND tBreak IS NOT NULL AND an > 0')} AS VP, {_B('an = 0 AND tBreak IS NOT NULL')} | {_B('d > 60 AND d = m')} | {_B('d > 60 AND an = 1 AND tBreak IS NOT NULL')} AS FP FROM c2),
c4 AS (SELECT *, {_B('an > 0 AND tBreak IS NULL')} | {_B('an = 1 AND vb = 1 AND FP = 1')} | {_B('an = 2 AND vb = 3 AND FP = 1')} AS FN, {_B('an = 0 AND tBreak IS NULL')} AS VN FROM c3),
c5 AS (SELECT *, sum(VP + FP + FN + VN) OVER (PARTITION BY x_coord, y_coord, tBreak) AS total FROM c4),
c6 AS (SELECT * REPLACE (CASE WHEN {_B('tBreak IS NOT NULL AND total = 0 AND an = 2 AND vb > 2 AND d = nearest')} = 1 THEN 1 ELSE FP END AS FP) FROM c5),
c7 AS (SELECT * REPLACE (CASE WHEN {_B('FP = 1 AND an = 1 AND d = m AND vb IN (2, 3)')} = 1 OR (an = 2 AND vb = 1 AND VP = 0) OR (an = 2 AND vb = 2 AND FP = 1) THEN 1 ELSE FN END AS FN) FROM c6),
c8 AS (SELECT *, max({_B('tBreak IS NOT NULL AND total = 0 AND an = 2 AND vb = 2')}) OVER (PARTITION BY x_coord, y_coord) AS redo FROM c7),
c9 AS (SELECT *, first(d) OVER w AS d0, first(tBreak) OVER w AS b0, first(data) OVER w AS a0 FROM c8 WHERE redo = 1 WINDOW w AS (PARTITION BY buffer_id, x_coord, y_coord ORDER BY d NULLS LAST, nome, id)),
final AS (SELECT x_coord, y_coord, id, nome, an, delta_min, border, VP, FP, FN, VN FROM c8 WHERE redo = 0
 UNION ALL SELECT x_coord, y_coord, id, nome, an, delta_min, border, {_B('d <= 60')}, {_B('d > 60')}, {_B('d > 60')}, 0 FROM c9 WHERE NOT (({_B('tBreak = b0')} = 1 OR {_B('data = a0')} = 1) AND d IS DISTINCT FROM d0))
"""
_classes = lambda body: X.with_sql("obs seg polys", _CLASSES + body).replace("\n,\n", ",\n").replace("\n,", ",\n")


@query("i02_i03_classification", _classes("SELECT x_coord, y_coord, id, nome, an AS analysts, delta_min::INT AS delta_min, VP, FP, FN, VN FROM final WHERE VP + FP + FN + VN > 0"))
def classification(spark, d):
    return V.classify(reference_rows(spark, d), 60).select(*V.COORD, "id", "nome", "analysts", "delta_min", "VP", "FP", "FN", "VN")


@query("i04_validation", _classes("""
SELECT VP, FP, FN, round(FP / (FP + VP), 6) AS cm, round(FN / (FN + VP), 6) AS om, round(2 * (1 - FN / (FN + VP)) * (1 - FP / (FP + VP)) / (2 - FN / (FN + VP) - FP / (FP + VP)), 6) AS f1
FROM (SELECT sum(VP)::BIGINT AS VP, sum(FP)::BIGINT AS FP, sum(FN)::BIGINT AS FN FROM final WHERE VP + FP + FN + VN > 0 AND NOT border)"""))
def validation(spark, d):
    """From segments to commission, omission and F1, border rows left out."""
    rows = V.classify(reference_rows(spark, d), 60).withColumns({"altera": F.when(F.col("analysts") > 0, "Com Alteracao").otherwise("Sem Alteracao"), "classe_anterior": F.lit("Eucalipto"), "classe_atual": F.lit("Solo")})
    t = A.scores(V.comparable(rows, ("Solo",)))
    return t.select("VP", "FP", "FN", *[F.round(c, 6).alias(c) for c in ("cm", "om", "f1")])
