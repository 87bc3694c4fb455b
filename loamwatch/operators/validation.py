"""Validation of segments against dated reference polygons.

Rows carry a coordinate (x_coord, y_coord), days as dates or epoch milliseconds, and probabilities from 0 to 1.
The rules are numbered stages, each a handful of columns over windows of the coordinate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COORD = ["x_coord", "y_coord"]


def analyst_rows(df: DataFrame, keep: list[str], parts: list[tuple[str, str]], both: list[str]) -> DataFrame:
    """(keep, part, data, tipo): a row for the first analyst date; another for the second where both dates exist."""
    (d1, t1), (d2, t2) = parts
    row = lambda n, d, t: F.struct(F.lit(n).alias("part"), F.col(d).alias("data"), F.col(t).alias("tipo"))
    two = F.col(both[0]).isNotNull() & F.col(both[1]).isNotNull()
    rows = F.when(two, F.array(row(1, d1, t1), row(2, d2, t2))).otherwise(F.array(row(1, d1, t1)))
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def period_filter(segments: DataFrame, start_ms: int, end_ms: int, magnitude: str | None = None, least: float | None = None) -> DataFrame:
    """Segments of an analysis period: breaks strictly inside it, and one row without a break where there is none."""
    w = W.partitionBy(*COORD)
    p = F.col("changeProb")
    t = segments.withColumn("tBreak", F.nullif("tBreak", F.lit(0)))
    if magnitude:
        t = t.withColumn("tBreak", F.when(~(F.col(magnitude) > least), F.col("tBreak")))
    t = t.withColumns({"startMin": F.min("tStart").over(w), "numBreak": F.ceil(F.sum("changeProb").over(w)).cast("int")})
    part = (p > 0) & (p < 1)
    inside = F.coalesce((F.col("tBreak") > start_ms) & (F.col("tBreak") < end_ms) & ~part, F.lit(False))
    t = t.withColumn("inPeriod", inside).withColumn("tBreak", F.when(F.col("inPeriod"), F.col("tBreak")))
    t = t.withColumn("hasBreak", F.max("tBreak").over(w).isNotNull())
    none = F.col("tBreak").isNull()
    left = t.where(~(none & ((F.col("numBreak") > 1) | ((F.col("numBreak") == 1) & ~F.col("inPeriod") & (F.col("tStart") == F.col("startMin"))))))
    left = left.withColumn("rows", F.count("*").over(w)).where(~((F.col("rows") == 2) & (p == 0) & (F.col("numBreak") == 1))).drop("rows")
    more = t.where(none & ~F.col("hasBreak") & (part | ((p == 0) & (F.col("numBreak") > 1))))
    return left.unionByName(more)


def drop_conflicts(rows: DataFrame, group: list[str], distance: str, brk: str, date: str, ties: list[str]) -> DataFrame:
    """Where two analyst dates of a point compete for its breaks, the nearest pair of break and date stays.

    A group is a polygon and a point. Of its nearest row (the first by ``ties`` among equals) the break and the date
    are taken: other rows of that break or that date go, unless they are as near. What is left are pairs of other
    breaks and dates, one date a break.
    """
    w = W.partitionBy(*group)
    nearest = F.min(F.struct(F.col(distance).isNull().alias("far"), F.col(distance).alias("d"), *ties, F.col(brk).alias("b"), F.col(date).alias("a"))).over(w)
    t = rows.withColumn("_o", nearest)
    taken = F.coalesce(F.col(brk) == F.col("_o.b"), F.lit(False)) | F.coalesce(F.col(date) == F.col("_o.a"), F.lit(False))
    return t.where(~(taken & ~F.col(distance).eqNullSafe(F.col("_o.d")))).drop("_o")


def classify(rows: DataFrame, theta: int = 60) -> DataFrame:
    """VP, FP, FN, VN of rows (coordinate, buffer_id, nome, id, analysts, tBreak, data, delta_min, tipo).

    ``buffer_id`` is the polygon, ``data`` the analyst date of this row, ``analysts`` counts the analyst dates of the polygon, ``delta_min`` are days from the break to the date of
    this row, ``nome`` tells the analyst rows apart, ``id`` the segments.
    """
    coord, one = W.partitionBy(*COORD), W.partitionBy(*COORD, "nome")
    by_break = W.partitionBy(*COORD, "tBreak")
    an, vb, d, m = F.col("analysts"), F.col("vb"), F.col("d"), F.col("m")
    has, none = F.col("tBreak").isNotNull(), F.col("tBreak").isNull()
    num = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    t = rows.withColumns({"vb": F.count("tBreak").over(one), "d": F.abs("delta_min")}).withColumn("m", F.min("d").over(one))
    # 1
    t = t.withColumn("_few", (an == 2) & (vb < 2)).withColumn("m", F.when(F.col("_few"), F.min(F.when(F.col("_few"), d)).over(coord)).otherwise(m))
    # 2, 3
    t = t.withColumn("VP", num((d <= theta) & has & (an > 0)))
    t = t.withColumn("FP", num(((an == 0) & has) | ((d > theta) & (d == m)) | ((d > theta) & (an == 1) & has)))
    fp = F.col("FP") == 1
    t = t.withColumn("FN", num(((an > 0) & none) | ((an == 1) & (vb == 1) & fp) | ((an == 2) & (vb == 3) & fp)))
    t = t.withColumn("VN", num((an == 0) & none)).withColumn("total", F.col("VP") + F.col("FP") + F.col("FN") + F.col("VN"))
    # 4
    t = t.withColumn("_sum", F.sum("total").over(by_break)).withColumn("_least", F.min("d").over(coord))
    t = t.withColumn("FP", F.when(has & (F.col("_sum") == 0) & (an == 2) & (vb > 2) & (d == F.col("_least")), 1).otherwise(F.col("FP")))
    # 5
    late = (fp & (an == 1) & (d == m) & vb.isin(2, 3)) | ((an == 2) & (vb == 1) & (F.col("VP") == 0)) | ((an == 2) & (vb == 2) & fp)
    t = t.withColumn("FN", F.when(F.coalesce(late, F.lit(False)), 1).otherwise(F.col("FN")))
    # 6
    t = t.withColumn("_redo", F.max(num(has & (F.col("_sum") == 0) & (an == 2) & (vb == 2))).over(coord) == 1)
    redo = drop_conflicts(t.where("_redo"), ["buffer_id", *COORD], "d", "tBreak", "data", ["nome", "id"])
    # a row without a distance is neither near nor far; 7 drops it
    redo = redo.withColumns({"VP": num(d <= theta), "FP": num(d > theta), "FN": num(d > theta), "VN": F.lit(0)})
    t = t.where("NOT _redo").unionByName(redo)
    # 7
    t = t.where((F.col("VP") + F.col("FP") + F.col("FN") + F.col("VN") > 0) & ~F.coalesce(F.col("tipo").isin("Agricultura", "Agua"), F.lit(False)))
    return t.drop("_few", "_sum", "_least", "_redo", "total")


#: Classes before and after a change that count as clear cuts.
BEFORE = ("Pinheiro bravo", "Eucalipto")


def comparable(rows: DataFrame, after: tuple[str, ...], before: tuple[str, ...] = BEFORE) -> DataFrame:
    """Unchanged polygons, or changes from forest to a bare or shrub class; rows at a border go."""
    changed: Column = (F.col("altera") == "Com Alteracao") & F.col("classe_anterior").isin(*before) & F.col("classe_atual").isin(*after)
    return rows.where(((F.col("altera") == "Sem Alteracao") | changed) & ~F.col("border"))
