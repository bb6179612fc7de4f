"""Connected components by alternating stars.

A round links every node's larger neighbours to its smallest one (large star), then
every node's smaller neighbours to the smallest (small star). The number of rounds grows
with the logarithm of the number of nodes. The smallest neighbour is a partial
aggregate, and adaptive execution splits a hub's join, so hubs are no task's burden. Each
round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """node, component (the smallest node in it) for all nodes of the edges (u, v)."""

    def ordered(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now, last, round_ = scratch.save(ordered(edges), f"{name}-0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last or not state[0]:
            break
        last, round_ = state, round_ + 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ordered(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.*")
        now = scratch.save(ordered(small), f"{name}-{round_}")
        if round_ > 1:
            scratch.drop(f"{name}-{round_ - 2}")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
