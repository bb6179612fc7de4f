"""Array expressions over fixed-length topic vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column, k: int) -> Column:
    """``a[0]*b[0] + a[1]*b[1] + ...`` summed left to right."""
    if k <= 16:
        out = a[0] * b[0]
        for i in range(1, k):
            out = out + a[i] * b[i]
        return out
    return total(F.zip_with(a, b, lambda x, y: x * y))


def zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


def counts_by_topic(topic: Column, weight: Column, k: int) -> Column:
    """Aggregate: array of K sums of ``weight``, one per topic."""
    return F.array(*[F.sum(F.when(topic == i, weight).otherwise(0)) for i in range(k)])
