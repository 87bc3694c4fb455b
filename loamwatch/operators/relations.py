"""Joins by key, order and time, and surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loamwatch.staging import staged


def surrogate_keys(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers rows 1..n in an order without one task seeing them all: ranges are sorted and numbered apart, then shifted by the counts before."""
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    shifts = sizes.select("_part", "_first", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    return ranged.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_part", "_id", "_first", "_before")


def first_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, columns: list[str], order: list[str], how: str = "left") -> DataFrame:
    """Left rows with the columns of their first right row, or nulls (``how="inner"`` drops those); the left side isn't multiplied."""
    n = F.row_number().over(W.partitionBy(right_key).orderBy(*order))
    once = right.withColumn("_n", n).where("_n = 1").select(F.col(right_key).alias("_k"), *columns)
    return left.join(once, F.col(left_key) == F.col("_k"), how).drop("_k")


def merge_three(a: DataFrame, b: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Rows of a with what b and c have for their key."""
    return a.join(b, key, "left").join(c, key, "left")


def _timeline(left: DataFrame, right: DataFrame, key: str, at: str, when: str) -> DataFrame:
    """(key, _t, _k, _v): the left side's times (_k = 0) among the right side's values (_k = 1)."""
    asked = left.where(F.col(at).isNotNull()).select(key, F.col(at).alias("_t"), F.lit(0).alias("_k")).distinct().withColumn("_v", F.lit(None).cast(right.schema[when].dataType))
    return asked.unionByName(right.where(F.col(when).isNotNull()).select(key, F.col(when).alias("_t"), F.lit(1).alias("_k"), F.col(when).alias("_v")))


def last_before(left: DataFrame, right: DataFrame, key: str, at: str, when: str, name: str) -> DataFrame:
    """As-of join: the latest ``when`` of the right side strictly before ``at``; null if there is none. Both sides are sorted once by key and time, never paired."""
    w = W.partitionBy(key).orderBy("_t", "_k").rowsBetween(W.unboundedPreceding, W.currentRow)
    best = _timeline(left, right, key, at, when).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_k = 0").select(key, F.col("_t").alias(at), name)
    return left.join(best, [key, at], "left")


def first_within(left: DataFrame, right: DataFrame, key: str, start: str, end: str, when: str, name: str) -> DataFrame:
    """The earliest ``when`` of the right side in [start, end]; null if there is none: the first from start on, unless it is later than end."""
    w = W.partitionBy(key).orderBy(F.desc("_t"), F.desc("_k")).rowsBetween(W.unboundedPreceding, W.currentRow)
    best = _timeline(left, right, key, start, when).withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_k = 0").select(key, F.col("_t").alias(start), name)
    return left.join(best, [key, start], "left").withColumn(name, F.when(F.col(name) <= F.col(end), F.col(name)))
