"""New images appended to the stored series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwatch.schemas import OBSERVATIONS

PIXEL = ["tile", "x", "y"]


def newest_at_known(images: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of each tile's newest date, at pixels that have a series already."""
    newest = images.groupBy("tile").agg(F.max("obs_date").alias("obs_date"))
    return images.join(newest, ["tile", "obs_date"], "left_semi").join(known.select(*PIXEL).distinct(), PIXEL, "left_semi")


def append_newest(stored: DataFrame, images: DataFrame) -> DataFrame:
    """The stored series and the newest image, as a batch; dates that are stored already aren't taken again."""
    fresh = newest_at_known(images.join(stored.select("tile", "obs_date").distinct(), ["tile", "obs_date"], "left_anti"), stored)
    return stored.unionByName(fresh.select(*stored.columns))


def _logs(spark: SparkSession, store: str) -> None:
    """Small tables beside the series, made once: pixels that have a series, and dates stored for each tile. Spark's readers pass over their folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/_pixels")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        series = spark.read.schema(OBSERVATIONS).option("recursiveFileLookup", "true").parquet(store)
        series.select("tile", "obs_date").distinct().write.mode("overwrite").parquet(f"{store}/_dates/batch=-1")
        series.select(*PIXEL).distinct().write.mode("overwrite").parquet(f"{store}/_pixels")


def start_append(spark: SparkSession, incoming: str, store: str, checkpoint: str):
    """A stream over a folder of image files, with the rules of ``append_newest``: of each micro-batch, the newest date of a tile that isn't stored yet, at known pixels.

    Each batch writes folders of its own, so a batch that is run again after a failure overwrites its own result, and
    its own dates don't count as stored. ``streaming.continued`` detects what is appended.
    """
    _logs(spark, store)
    stream = spark.readStream.schema(OBSERVATIONS).parquet(incoming)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        dates = session.read.parquet(f"{store}/_dates").where(F.col("batch") != number).select("tile", "obs_date")
        fresh = newest_at_known(batch.join(dates, ["tile", "obs_date"], "left_anti"), session.read.parquet(f"{store}/_pixels"))
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number}")
        session.read.schema(OBSERVATIONS).parquet(f"{store}/batch={number}").select("tile", "obs_date").distinct().write.mode("overwrite").parquet(f"{store}/_dates/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
