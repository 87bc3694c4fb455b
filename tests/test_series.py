"""Detection from a clustered store, and detection continued from state, against one batch run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamwatch.functions.harmonics import predicted
from loamwatch.operators import detection as D
from loamwatch.schemas import OBSERVATIONS
from loamwatch.sources.series import read_series, write_series
from loamwatch.streaming.append import start_append
from loamwatch.streaming.continued import current_segments, start_detection

ORDER = ["green", "red", "nir", "swir2"]


@pytest.fixture(scope="module")
def images(spark):
    """Twelve pixels of two tiles, 90 dates; one has a break, one no clean observation, some dates are repeated."""
    rng, rows = np.random.default_rng(1), []
    days = pd.date_range("2018-01-01", periods=90, freq="16D")
    for k in range(12):
        step = np.where(np.arange(90) < 40 + k, 0, 600 if k % 3 == 0 else 0)
        w = 2 * np.pi * np.arange(90) * 16 / 365.2425
        bands = np.array([500 + 40 * np.cos(w) + step, 400 + 30 * np.sin(w) + step, 3000 + 200 * np.cos(w) - step, 1500 + 80 * np.sin(w) + 2 * step]) + rng.normal(0, 10, (4, 90))
        if k == 5:
            bands[0] = 65535
        frame = pd.DataFrame({"tile": f"T{k % 2}", "x": k // 2, "y": k % 2, "obs_date": days.date} | dict(zip(ORDER, bands.round().astype(int), strict=True)))
        rows.append(pd.concat([frame, frame.iloc[[3, 3]].assign(green=510)]))
    return spark.createDataFrame(pd.concat(rows), OBSERVATIONS).cache()


def shown(segments):
    rounded = [F.transform(c, lambda v: F.round(v, 5)).alias(c) if k.startswith("array") else F.round(c, 5).alias(c) if k == "double" else c for c, k in segments.dtypes]
    return sorted(map(str, segments.select(*rounded).collect()))


def test_a_store_is_detected_without_a_shuffle(spark, images, tmp_path):
    path = str(tmp_path / "series")
    write_series(images, path, ORDER)
    found = D.detect_series(read_series(spark, path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert shown(found) == shown(D.detect_segments(images, order=ORDER))
    assert read_series(spark, path).where("tile = 'T1'")._jdf.queryExecution().executedPlan().toString().count("EqualTo(tile,T1)") > 0


def test_appended_images_give_what_one_batch_gives(spark, images, tmp_path):
    store, incoming, cp, out = (str(tmp_path / n) for n in ("store", "in", "cp", "seg"))
    dates = [r.obs_date for r in images.select("obs_date").distinct().orderBy("obs_date").collect()]
    images.where(F.col("obs_date") < dates[-3]).write.parquet(f"{store}/batch=start")
    start_detection(spark, store, f"{cp}/d", out).awaitTermination(180)
    for k in (3, 2, 1):  # an image of one tile alone, then of both
        fresh = images.where((F.col("obs_date") == dates[-k]) & ((F.col("tile") == "T0") | F.lit(k < 3)))
        fresh.coalesce(1).write.mode("append").parquet(incoming)
        start_append(spark, incoming, store, f"{cp}/a").awaitTermination(120)
        start_detection(spark, store, f"{cp}/d", out).awaitTermination(180)
    stored = spark.read.schema(OBSERVATIONS).option("recursiveFileLookup", "true").parquet(store)
    assert shown(current_segments(spark, out)) == shown(D.detect_segments(stored, order=ORDER))
    touched = [r["n"] for r in spark.read.parquet(out).groupBy("batch").agg(F.countDistinct("tile", "x_coord", "y_coord").alias("n")).orderBy("batch").collect()]
    assert touched == [12, 6, 12, 12]


def test_edge_values_are_those_of_detection(spark, images):
    found = D.detect_segments(images, order=ORDER).where("tStart IS NOT NULL")
    names = [f"{b}{e}" for b in D.BANDS for e in ("Start", "Start2", "End", "End2")]
    again = D.edge_values(D.series_of(images, ORDER), found.drop(*names)).select(*found.columns)
    assert shown(again) == shown(found)


def test_curve_lies_among_the_observations(spark, images):
    s = D.detect_segments(images, order=ORDER).where("tStart IS NOT NULL").select("tile", F.col("x_coord").alias("x"), F.col("y_coord").alias("y"), "tStart", "tEnd", "intercept_values", "coeficientes")
    ndvi = F.transform(F.arrays_zip("ordinal", "ndvi"), lambda v: v)
    seen = D.series_of(images, ORDER).select("tile", "x", "y", F.explode(ndvi).alias("o")).join(s, ["tile", "x", "y"])
    ms = (F.col("o.ordinal") - D.EPOCH).cast("long") * 86_400_000
    gaps = seen.where(ms.between(F.col("tStart"), F.col("tEnd"))).select(F.abs(F.col("o.ndvi") - predicted(F.col("o.ordinal"), F.col("intercept_values"), F.col("coeficientes"))).alias("gap"))
    assert gaps.agg(F.median("gap")).first()[0] < 120
