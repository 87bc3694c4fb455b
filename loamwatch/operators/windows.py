"""Window operators on segments, series and event dates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def break_flags(segments: DataFrame, key: list[str], start: str = "tStart") -> DataFrame:
    """is_break: true for all but the last segment of a pixel."""
    return segments.withColumn("is_break", F.lead(start).over(W.partitionBy(*key).orderBy(start)).isNotNull())


def pick_break(segments: DataFrame, key: list[str], start: str | None = None, end: str | None = None, when: str = "tBreak", ties: list[str] | None = None) -> DataFrame:
    """One row a pixel: the only one in the (inclusive) range, else the one with the second-highest break."""
    s = segments.where(F.col(when).isNotNull())
    if start is not None:
        s = s.where(F.col(when).between(start, end))
    w = W.partitionBy(*key)
    ranked = s.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(when), *(ties or [])))).withColumn("_rows", F.count("*").over(w))
    return ranked.where((F.col("_rank") == 2) | ((F.col("_rows") == 1) & (F.col("_rank") == 1))).drop("_rank", "_rows")


def fix_probability(segments: DataFrame, key: list[str]) -> DataFrame:
    """changeProb / 100, then 1 for every segment but the one with the latest break."""
    w = W.partitionBy(*key)
    last = F.col("tBreak") == F.max("tBreak").over(w)
    return segments.withColumn("changeProb", F.when((F.count("*").over(w) > 1) & ~F.coalesce(last, F.lit(False)), 1.0).otherwise(F.col("changeProb") / 100))


def biggest_drop(series: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, drop, drop_date): the most negative difference between neighbouring dates of the whole table, the first of equals.

    A null on either side gives no difference, so the dates of the whole table are laid under each series.
    """
    days = series.select(day).distinct()
    ids = series.select(key).distinct()
    grid = days.withColumn("_next", F.lead(day).over(W.orderBy(day)))  # one row a date of the table
    pairs = series.select(key, F.col(day).alias("_d"), F.col(value).alias("_v")).join(grid, F.col("_d") == F.col(day)).select(key, F.col("_v"), "_next")
    after = series.select(F.col(key), F.col(day).alias("_next"), F.col(value).alias("_w"))
    steps = pairs.join(after, [key, "_next"]).select(key, F.col("_next").alias("_at"), (F.col("_w") - F.col("_v")).alias("_step")).where(F.col("_step").isNotNull())
    best = steps.groupBy(key).agg(F.min(F.struct("_step", "_at")).alias("_b"))
    return ids.join(best, key, "left").select(key, F.col("_b._step").alias("drop"), F.col("_b._at").alias("drop_date"))


def gap_sessions(events: DataFrame, key: str, day: str, gap: int = 730) -> DataFrame:
    """(key, seq, start, end): a new interval when the gap to the date before exceeds ``gap`` days; ids with three or more equal dates alone have none."""
    w = W.partitionBy(key).orderBy(day)
    flagged = events.withColumn("_new", F.coalesce((F.datediff(day, F.lag(day).over(w)) > gap).cast("int"), F.lit(0)))
    numbered = flagged.withColumn("seq", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1)
    every = numbered.groupBy(key).agg(F.count("*").alias("_n"), F.countDistinct(day).alias("_d"))
    spans = numbered.groupBy(key, "seq").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    return spans.join(every.where((F.col("_n") < 3) | (F.col("_d") > 1)).select(key), key).select(key, "seq", "start", "end")


def _anchors(span: int):
    """Rows (key, day) sorted by both -> the day of the interval that each belongs to; a partition may hold many keys, a key one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = object(), 0  # no key yet; null is one
        for batch in batches:
            keys, days = batch.column(0), batch.column(1).cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = keys.dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy()
            out = np.empty(len(days), np.int32)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]).tolist() if len(days) else []
            for i, j in zip(starts, [*starts[1:], len(days)], strict=False):
                now = keys[i].as_py()
                at = i
                if now == key:  # the key goes on from the batch before
                    at = i + int(np.searchsorted(days[i:j], first + span, side="right"))
                    out[i:at] = first
                while at < j:
                    key, first = now, int(days[at])
                    end = i + int(np.searchsorted(days[i:j], first + span, side="right"))
                    out[at:end], at = first, end
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(out).cast(pa.date32())], names=["key", "day", "start"])

    return run


def anchored_intervals(events: DataFrame, key: str, day: str, span: int = 730) -> DataFrame:
    """(key, seq, start, end): a new interval at the first date more than ``span`` days after the interval's first.

    Where an interval begins depends on where the one before began, so rows are read in order once, with the last start as
    all that is remembered; an id of very many dates takes steps for its intervals, not for its dates. Null dates are left out.
    """
    rows = events.select(F.col(key).alias("key"), F.col(day).cast("date").alias("day")).where("day IS NOT NULL")
    ordered = rows.repartition("key").sortWithinPartitions("key", "day")
    kind = dict(rows.dtypes)["key"]
    spans = ordered.mapInArrow(_anchors(span), f"key {kind}, day date, start date").groupBy("key", "start").agg(F.max("day").alias("end"))
    return spans.select(F.col("key").alias(key), F.row_number().over(W.partitionBy("key").orderBy("start")).alias("seq"), "start", "end")


def around(series: DataFrame, key: list[str], day: str, reference: str, n: int, values: list[str], order: list[str]) -> DataFrame:
    """The n observations up to (inclusive) and the n after a reference date per pixel, as arrays nearest first."""
    rank = lambda before: F.row_number().over(W.partitionBy(*key).orderBy(F.desc(day) if before else day, *[F.desc(c) if before else c for c in order]))
    side = lambda before: series.where(F.col(day) <= F.col(reference) if before else F.col(day) > F.col(reference)).withColumn("_r", rank(before)).where(F.col("_r") <= n)
    pack = lambda df, name: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", day, *values))), lambda s: F.struct(s[day], *[s[v] for v in values])).alias(name))
    return pack(side(True), "before").join(pack(side(False), "after"), key, "full")
