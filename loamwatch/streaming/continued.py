"""Detection that continues series from keyed state.

The state of a pixel is its clean series. The first batch fills it from the store; after that an image adds an observation
to the pixels that it touches, and the store is never read again. Noise, peek and limits of a pixel depend on all of its
observations, so its control loop runs again, over the state, and the result is that of one batch run over everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwatch.functions import scalars as S
from loamwatch.operators.detection import BANDS, Parameters, detect_series
from loamwatch.schemas import OBSERVATIONS, SERIES

_STATE = SERIES.split("y int, ")[1]
_NAMES = ["ordinal", "ndvi", *BANDS]


def _continue(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Adds a batch's clean observations of dates that the state doesn't have; gives the series as it is now."""
    before = pd.DataFrame(dict(zip(_NAMES, state.get, strict=True))) if state.exists else pd.DataFrame(columns=_NAMES)
    new = pd.concat(list(frames))
    new = new[new["clean"] & ~new["ordinal"].isin(before["ordinal"])][_NAMES]
    now = pd.concat([before, new]) if len(before) else new
    now = now.sort_values(["ordinal", *BANDS], kind="stable")
    lists = [[float(v) for v in now[c]] if c == "ndvi" else [int(v) for v in now[c]] for c in _NAMES]
    state.update(tuple(lists))
    yield pd.DataFrame([[*key, *lists]], columns=["tile", "x", "y", *_NAMES])


def start_detection(spark: SparkSession, store: str, checkpoint: str, segments: str, p: Parameters = Parameters()):  # noqa: B008
    """A stream over the files of a store, as ``streaming.append`` writes them; each batch writes the segments of the pixels that it touched.

    ``current_segments`` reads the latest of each pixel. A batch that is run again overwrites its own result. Observations of
    a date that the pixel has from an earlier batch aren't taken again; equal dates within a batch all are.
    """
    rows = spark.readStream.schema(OBSERVATIONS).option("recursiveFileLookup", "true").parquet(store)
    rows = rows.withColumn("ndvi", S.ndvi_scaled(F.col("nir").cast("double"), F.col("red").cast("double"))).withColumn("ordinal", S.date_to_ordinal(F.col("obs_date")).cast("int"))
    rows = rows.select("tile", "x", "y", *_NAMES, F.coalesce(S.is_clean(*BANDS, "ndvi"), F.lit(False)).alias("clean"))
    series = rows.groupBy("tile", "x", "y").applyInPandasWithState(_continue, SERIES, _STATE, "update", "NoTimeout")

    def take(batch: DataFrame, number: int) -> None:
        detect_series(batch, p).write.mode("overwrite").parquet(f"{segments}/batch={number}")

    return series.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_segments(spark: SparkSession, segments: str) -> DataFrame:
    """Of each pixel, the segments of the last batch that touched it."""
    every = spark.read.parquet(segments)
    key = ["tile", "x_coord", "y_coord"]
    return every.join(every.groupBy(*key).agg(F.max("batch").alias("batch")), [*key, "batch"], "left_semi").drop("batch")
