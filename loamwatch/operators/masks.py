"""Cloud and shadow masks on image cells: shadows are equi-joins on shifted cells, squares are runs along rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _runs(cells: DataFrame, image: str, reach: int) -> DataFrame:
    """(image, cy, lo, hi): what the squares of ``reach`` around cells cover, as runs of columns in each row.

    Cells of a row become runs first, then each run goes to the rows near it; so there are far fewer rows than cells times
    squares, at most 2 reach + 1 a cell if all lie alone.
    """
    w = W.partitionBy(image, "cy").orderBy("cx")
    fresh = F.coalesce((F.col("cx") - F.lag("cx").over(w) > 2 * reach + 1).cast("int"), F.lit(1))
    numbered = cells.select(image, "cx", "cy").withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.groupBy(image, "cy", "_run").agg((F.min("cx") - reach).alias("lo"), (F.max("cx") + reach).alias("hi"))
    return runs.select(image, F.explode(F.sequence(F.col("cy") - reach, F.col("cy") + reach)).alias("cy"), "lo", "hi")


def covered(cells: DataFrame, by: DataFrame, image: str, reach: int, name: str) -> DataFrame:
    """The cells with ``name``: whether a cell of ``by`` lies at most ``reach`` columns and rows away.

    Runs and cells of a row are sorted together; a cell is covered if a run that begins before it ends behind it.
    """
    ends = _runs(by, image, reach).select(image, "cy", F.col("lo").alias("cx"), F.col("hi").alias("_hi"), F.lit(None).cast(cells.select(F.struct("*").alias("c")).dtypes[0][1]).alias("_cell"))
    rows = cells.select(image, "cy", "cx", F.lit(None).cast(dict(ends.dtypes)["_hi"]).alias("_hi"), F.struct("*").alias("_cell"))
    w = W.partitionBy(image, "cy").orderBy("cx", F.col("_cell").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    met = ends.unionByName(rows).withColumn("_far", F.max("_hi").over(w)).where("_cell IS NOT NULL")
    return met.select("_cell.*", F.coalesce(F.col("_far") >= F.col("cx"), F.lit(False)).alias(name))


def cloud_mask(cells: DataFrame, image: str = "image", probability: int = 50, dark: int = 2000, water: int = 6, reach: int = 10, erode: int = 2, dilate: int = 5) -> DataFrame:
    """Cells (image, cx, cy, prob, scl, nir, azimuth) with ``masked``.

    Clouds by probability; shadows are dark, dry cells on the way from a cloud along 90 degrees minus the solar
    azimuth, up to ``reach`` cells. The mask is eroded (cells without a clear one in their square stay), then dilated.
    """
    flagged = cells.withColumn("cloud", F.col("prob") > probability).withColumn("dark", (F.col("nir") < dark) & (F.col("scl") != water))
    angle = F.radians(90 - F.col("azimuth"))
    steps = flagged.where("cloud").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    cast = steps.select(image, (F.col("cx") + F.bround(F.cos(angle) * F.col("step")).cast("int")).alias("cx"), (F.col("cy") + F.bround(F.sin(angle) * F.col("step")).cast("int")).alias("cy")).distinct().withColumn("cast", F.lit(True))
    key = [image, "cx", "cy"]
    mask = flagged.join(cast, key, "left").withColumn("bad", (F.col("cloud") | (F.col("dark") & F.coalesce("cast", F.lit(False)))).cast("int"))
    mask = mask.select(*cells.columns, "bad")
    eroded = covered(mask, mask.where("bad = 0"), image, erode, "_open")
    return covered(eroded, eroded.where("NOT _open"), image, dilate, "masked").select(*cells.columns, "masked")
