"""Image catalogues: tables of file names with dates in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def image_files(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, modificationTime, length) of the files of a folder tree; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")


def dated(files: DataFrame, path: str = "path") -> DataFrame:
    """Images with an eight-digit date in the name."""
    found = F.regexp_extract(path, r"(?<![0-9])((?:19|20)[0-9]{6})(?![0-9])", 1)
    return files.withColumn("acq_date", F.try_to_timestamp(found, F.lit("yyyyMMdd")).cast("date")).where(F.col("acq_date").isNotNull())


def by_year(files: DataFrame, first_year: int, last_date: str, path: str = "path") -> DataFrame:
    """Dated images of the years from ``first_year`` to that of ``last_date``; later images of the last year stay."""
    return dated(files, path).where(F.year("acq_date").between(first_year, F.year(F.lit(last_date).cast("date"))))


def name_ms(path: Column) -> Column:
    """The 12- or 13-digit epoch milliseconds in a name."""
    return F.nullif(F.regexp_extract(path, r"(?<![0-9])([0-9]{12,13})(?![0-9])", 1), F.lit("")).cast("long")


def by_ms(files: DataFrame, last_date: str, path: str = "path") -> DataFrame:
    """Images named by epoch milliseconds, up to a date."""
    t = files.withColumn("acq_date", F.timestamp_millis(name_ms(F.col(path))).cast("date"))
    return t.where(F.col("acq_date") <= F.lit(last_date).cast("date"))


def most_recent(files: DataFrame, without: str | None = None, time: str = "modificationTime") -> DataFrame:
    """(path) of the newest file whose name doesn't hold a text."""
    left = files.where(~F.contains("path", F.lit(without))) if without else files
    return left.agg(F.max_by("path", time).alias("path"))


def largest(files: DataFrame, order: str = "seq") -> DataFrame:
    """The image with the most pixels; the first of equals."""
    return files.orderBy(F.desc(F.col("width").cast("long") * F.col("height")), order).limit(1)


def first_last(files: DataFrame, start: str, end: str) -> DataFrame:
    """First and last acquisition date in a range; nulls when there is none."""
    return files.where(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.min("acq_date").alias("first"), F.max("acq_date").alias("last"))


def dated_name(path: Column) -> Column:
    """The name with the epoch milliseconds turned into YYYYMMDD."""
    ms = name_ms(path)
    return F.when(ms.isNotNull(), F.replace(path, ms.cast("string"), F.date_format(F.timestamp_millis(ms), "yyyyMMdd"))).otherwise(path)


def end_date(path: Column) -> Column:
    """END and eight digits in a file name."""
    return F.try_to_timestamp(F.regexp_extract(path, r"END([0-9]{8})", 1), F.lit("yyyyMMdd")).cast("date")
