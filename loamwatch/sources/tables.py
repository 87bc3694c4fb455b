"""Readers and writers of observations, segments, CSV tables and the long raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwatch.schemas import OBSERVATIONS, SEGMENTS


def read_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations partitioned by tile; a filter on tile prunes folders."""
    return spark.read.schema(OBSERVATIONS).parquet(folder)


def write_observations(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("tile").parquet(folder)


def cube_to_long(images: DataFrame, bands: list[str]) -> DataFrame:
    """Wide images (tile, x, y, obs_date, one array a pixel in band order) -> one column a band."""
    return images.select("tile", "x", "y", "obs_date", *[F.get("bands", i).cast("int").alias(b) for i, b in enumerate(bands)])


def read_segments(spark: SparkSession, *folders: str, columns: list[str] | None = None) -> DataFrame:
    """Segments with the wanted columns only, and the end date in each file's name."""
    from loamwatch.sources.catalogue import end_date

    df = spark.read.schema(SEGMENTS).parquet(*folders).withColumn("end_date", end_date(F.col("_metadata.file_name")))
    return df.select(*columns) if columns else df


def write_segments(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").partitionBy("tile").parquet(folder)


def delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of the usual delimiters in the first line."""
    line = spark.read.text(path).limit(1).first()
    text = line[0] if line else ""
    return max([",", ";", "\t", "|"], key=text.count)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", delimiter(spark, path))
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def list_rows(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Columns that hold lists as text -> one row a list position."""
    lists = [F.from_json(F.col(c), "array<double>").alias(c) for c in columns]
    return df.select(*keep, F.explode(F.arrays_zip(*lists)).alias("z")).select(*keep, *[F.col("z")[c].alias(c) for c in columns])


def raster_cells(points: DataFrame, value: str, x: str = "x_coord", y: str = "y_coord", size: float = 10.0, order: list[str] | None = None) -> DataFrame:
    """(row, col, value) of pixel centres on the grid around them; half to even, the last write of a cell wins."""
    box = points.agg((F.min(x) - size / 2).alias("minx"), (F.max(y) + size / 2).alias("maxy"))  # one row
    placed = points.crossJoin(F.broadcast(box)).select(
        F.bround((F.col("maxy") - F.col(y)) / size - 0.5).cast("int").alias("row"), F.bround((F.col(x) - F.col("minx")) / size - 0.5).cast("int").alias("col"), F.col(value), *[F.col(c) for c in order or []]
    )
    return placed.groupBy("row", "col").agg(F.max_by(value, F.struct(*order) if order else F.col(value)).alias(value))


def dense(cells: DataFrame, value: str, fill: int = -9999) -> DataFrame:
    """The full grid up to the last row and column, with a fill value: rows are made from a sequence on each side."""
    size = cells.agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    grid = size.select(F.explode(F.sequence(F.lit(0), "rows")).alias("row"), "cols").select("row", F.explode(F.sequence(F.lit(0), "cols")).alias("col"))
    return grid.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce(value, F.lit(fill)).alias(value))
