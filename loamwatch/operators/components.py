"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwatch.staging import discard, staged

MOST_ROUNDS = 60


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, component): every node with an edge to another one, and the least node it can reach.

    Each round replaces the edges by stars around least neighbours and stages the result, so a hub's edges are
    joined and pre-aggregated, never gathered in one place. Null ends and loops are ignored.
    """
    pairs = edges.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).where((F.col(left) != F.col(right)))
    now = staged(pairs.distinct(), "components")
    seen = _signature(now)
    for _ in range(MOST_ROUNDS if seen[0] else 0):
        both = now.select(F.col("hi").alias("n"), F.col("lo").alias("w")).unionByName(now.select(F.col("lo").alias("n"), F.col("hi").alias("w")))
        least = both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where(F.col("w") > F.col("n")).join(least, "n").select(F.col("w").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        inner = large.join(least, "hi").where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = staged(inner.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "components")
        discard(now)
        now, before, seen = after, seen, _signature(after)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    stars = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
