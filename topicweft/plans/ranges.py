"""Global ranks and running sums over range partitions, at any number of them.

Rows are range-partitioned by Spark and written with their partition's number, which is
then fixed; each partition's totals are one row. No cut points are held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import Scratch

BUCKET = "_bucket"


def ranged(df: DataFrame, column: str) -> DataFrame:
    """The rows as a table, with the number of the range that holds them (ascending)."""
    dealt = df.repartitionByRange(F.col(column)).withColumn(BUCKET, F.spark_partition_id())
    return Scratch(df.sparkSession, "ranges").save(dealt, "rows")


def with_lower_totals(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Add, per row of ``ranged``, the totals of the named columns over all lower ranges.

    ``sums`` maps an output column to the summed column. The running sum is over one
    row per range; whether these are broadcast is left to their measured size.
    """
    per_range = rows.groupBy(BUCKET).agg(*[F.sum(c).alias(f"_{o}") for o, c in sums.items()])
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    lower = per_range.select(BUCKET, *[F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(o) for o in sums])
    return rows.join(lower, BUCKET)


def dense_index(distinct_values: DataFrame, column: str, index: str) -> DataFrame:
    """0-based rank of each distinct value in ascending order."""
    rows = ranged(distinct_values.withColumn("_one", F.lit(1)), column)
    inside = Window.partitionBy(BUCKET).orderBy(column)
    return (
        with_lower_totals(rows, {"_before": "_one"})
        .withColumn(index, (F.col("_before") + F.row_number().over(inside) - 1).cast("long"))
        .drop(BUCKET, "_one", "_before")
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``_rank``: how many rows up to this one are the first of their value, less one."""
    before = -1
    for batch in batches:
        rank = np.cumsum(batch.column("_first").to_numpy(zero_copy_only=False)) + before
        before = int(rank[-1]) if len(rank) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64())], names=[*batch.schema.names, "_rank"])


def numbered(rows: DataFrame, column: str, index: str, per_value: dict[str, Column]) -> DataFrame:
    """All rows with the 0-based rank of their value among the distinct values (``index``), aggregates over the rows of the value
    (``per_value``) and ``first``, true in one row of each value. The rows are shuffled once, by ranges, and not joined to the values."""
    same = Window.partitionBy(column)
    dealt = rows.repartitionByRange(F.col(column)).select(
        "*", *[a.over(same).alias(c) for c, a in per_value.items()], (F.row_number().over(same.orderBy(column)) == 1).alias("_first")
    ).withColumn(BUCKET, F.spark_partition_id())
    scratch = Scratch(rows.sparkSession, "ranges")
    schema = StructType([*dealt.schema.fields, StructField("_rank", LongType())])
    ranked = scratch.save(dealt.mapInArrow(_running, schema), "rows")
    per_range = ranked.groupBy(BUCKET).agg(F.sum(F.col("_first").cast("long")).alias("_values"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    lower = scratch.save(per_range.select(BUCKET, F.coalesce(F.sum("_values").over(before), F.lit(0)).alias("_before")), "lower")
    found = ranked.join(lower, BUCKET).withColumn(index, F.col("_before") + F.col("_rank"))
    return found.withColumnRenamed("_first", "first").drop(BUCKET, "_before", "_rank")
