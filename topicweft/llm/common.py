"""What the operators share: table access, session settings and small columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch

__all__ = ["Scratch", "documents", "benchmark", "lower_ascii", "whole_text", "remainder", "small_batches", "total"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text: str | Column) -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the identifier's decimal form modulo ``by``."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by)).cast("int")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Arrow batches by bytes, so that rows of very long texts don't meet in one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def total(df: DataFrame, value: Column) -> int:
    """Sum of a column as a number on the driver (0 for no rows)."""
    return df.agg(F.sum(value)).first()[0] or 0
