"""Store of pixel series, clustered in space, from which detection reads without a shuffle.

One row a pixel, with its clean observations as sorted arrays. Files hold ranges of (tile, x, y), so a filter on a tile or
a stretch of x is pushed to the files' statistics and most of them aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loamwatch.operators.detection import series_of
from loamwatch.schemas import SERIES


def write_series(observations: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Two shuffles, once: by pixel, then by range of place. ``order`` breaks ties of dates."""
    series_of(observations, order).repartitionByRange("tile", "x", "y").sortWithinPartitions("tile", "x", "y").write.option("parquet.block.size", str(32 << 20)).parquet(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERIES).parquet(path)
