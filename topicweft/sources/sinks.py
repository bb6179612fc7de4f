"""Text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import list_text
from ..plans.scratch import Scratch


def as_lines(df: DataFrame, sep: str = " ") -> DataFrame:
    """Columns joined to one ``value`` column."""
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value"))


def write_delimited(df: DataFrame, path: str, sep: str = " ") -> None:
    as_lines(df, sep).write.text(path)


ONE_FILE_BYTES = 256 << 20


def write_single_file(df: DataFrame, path: str, sep: str = " ", most_bytes: int = ONE_FILE_BYTES) -> None:
    """One output file, for results that one task can write. The lines are written in parallel first and their size is
    looked at; above ``most_bytes`` a ``ValueError`` says so and nothing is left at ``path``. Rows keep no order."""
    spark = df.sparkSession
    scratch = Scratch(spark, "one-file")
    lines = scratch.save(as_lines(df, sep), "lines")
    size = lines.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    if size > most_bytes:
        scratch.drop("")
        raise ValueError(f"{size} bytes are too many for a single file; use write_delimited or raise most_bytes")
    lines.coalesce(1).write.text(path)
    scratch.drop("")


def matrix_lines(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``k, List(a, b, ...)`` lines."""
    return df.select(F.concat_ws(", ", *[F.col(k).cast("string") for k in keys], list_text(value)).alias("value"))


def write_matrix(df: DataFrame, keys: list[str], value: Column, path: str) -> None:
    matrix_lines(df, keys, value).write.text(path)
