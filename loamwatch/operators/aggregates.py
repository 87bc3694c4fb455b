"""Aggregations over series, events and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole)


def ordered_events(events: DataFrame, key: str, day: str, activity: str, ties: list[str]) -> DataFrame:
    """(key, n, days, activities): all events of a key in order of time, in two arrays."""
    listed = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(day, *ties, activity))).alias("_e"))
    part = lambda c: F.transform("_e", lambda e: e[c])
    return listed.select(key, F.size("_e").alias("n"), part(day).alias("days"), part(activity).alias("activities"))


def numbered_columns(listed: DataFrame, key: str, width: int) -> DataFrame:
    """The first ``width`` events as columns day_k and activity_k, for output in wide tables."""
    return listed.select(key, "n", *[F.get(a, k).alias(f"{c}_{k + 1}") for k in range(width) for a, c in (("days", "day"), ("activities", "activity"))])


def first_variogram(series: DataFrame, key: list[str], day: str, values: list[str], order: list[str]) -> DataFrame:
    """Median absolute difference of successive observations."""
    w = W.partitionBy(*key).orderBy(day, *order)
    steps = series.select(*key, *[F.abs(F.col(v) - F.lag(v).over(w)).alias(v) for v in values])
    return steps.groupBy(*key).agg(*[F.median(v).alias(v) for v in values])


def adjusted_variogram(series: DataFrame, key: list[str], day: str, values: list[str], order: list[str], gap: int = 30) -> DataFrame:
    """The same over pairs more than ``gap`` days apart, at the least lag whose most frequent gap exceeds it; else the first variogram.

    One shuffle by key; every lag is tried, in the detection kernel's own function. A single observation gives nulls.
    """
    from loamwatch.operators.detection import variogram

    def one(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", *[f"_order{i}" for i in range(len(order))]], kind="stable")
        found = variogram(pdf["_t"].to_numpy(), pdf[values].to_numpy(float).T, gap) if len(pdf) > 1 else [None] * len(values)
        return pd.DataFrame([(*group, *found)], columns=[*key, *values])

    ready = series.select(*key, F.unix_date(day).alias("_t"), *[F.col(v).cast("double").alias(v) for v in values], *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    kinds = dict(series.select(*key).dtypes)
    return ready.groupBy(*key).applyInPandas(one, ", ".join([*[f"{k} {kinds[k]}" for k in key], *[f"{v} double" for v in values]]))


def peek_size(series: DataFrame, key: list[str], day: str, order: list[str], peek: int = 6, base: int = 16) -> DataFrame:
    """max(peek, round(peek * 16 / median gap)), half to even."""
    w = W.partitionBy(*key).orderBy(day, *order)
    gaps = series.select(*key, F.datediff(day, F.lag(day).over(w)).alias("gap")).groupBy(*key).agg(F.median("gap").alias("gap"))
    return gaps.select(*key, F.greatest(F.lit(peek), F.when(F.col("gap") > 0, F.bround(peek * base / F.col("gap"))).otherwise(peek).cast("int")).alias("peek"))


def scores(counts: DataFrame) -> DataFrame:
    """Commission, omission and F1 from columns VP, FP, FN."""
    t = counts.agg(*[F.sum(c).alias(c) for c in ("VP", "FP", "FN")])
    t = t.withColumns({"cm": F.when(F.col("FP") + F.col("VP") > 0, F.col("FP") / (F.col("FP") + F.col("VP"))), "om": F.when(F.col("FN") + F.col("VP") > 0, F.col("FN") / (F.col("FN") + F.col("VP")))})
    return t.withColumn("f1", F.when(2 - F.col("om") - F.col("cm") > 0, 2 * (1 - F.col("om")) * (1 - F.col("cm")) / (2 - F.col("om") - F.col("cm"))))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): bins of equal width, the last one closed on the right."""
    b = F.when(F.col(value) == high, bins).otherwise(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)))
    return df.where(F.col(value).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def mosaic(images: DataFrame, key: list[str], bands: list[str], part: str, nodata: int) -> DataFrame:
    """The first valid value of each cell among overlapping parts."""
    valid = F.lit(True)
    for b in bands:
        valid = valid & (F.col(b) != nodata)
    best = images.where(valid).groupBy(*key).agg(F.min_by(F.struct(*bands), part).alias("_b"))
    return best.select(*key, "_b.*")
