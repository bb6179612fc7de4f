"""Linear models by full-batch gradient descent and their evaluation.

One distributed aggregate per iteration; the driver holds the weights only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import BUCKET, ranged, with_lower_totals


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns shifted and scaled to mean 0 and (population) deviation 1."""
    moments = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return df.withColumns(
        {c: (F.col(c) - moments[f"m_{c}"]) / (moments[f"s_{c}"] or 1.0) for c in columns}
    )


def score(weights: list[float], features: list[str], intercept: float = 0.0) -> Column:
    """Linear score as a column."""
    out = F.lit(float(intercept))
    for w, f in zip(weights, features):
        out = out + F.lit(float(w)) * F.col(f)
    return out


def _gradient(df: DataFrame, factor: Column, features: list[str]) -> tuple[list[float], int]:
    row = df.select(factor.alias("_f"), *features).agg(
        *[F.sum(F.col("_f") * F.col(f)).alias(f) for f in features], F.count(F.lit(1)).alias("_n")
    ).first()
    return [row[f] or 0.0 for f in features], row["_n"]


def linear_descent(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    iterations: int = 100,
    step: float = 1.0,
    penalty: str | None = None,
    reg: float = 0.01,
    tolerance: float = 0.001,
) -> list[float]:
    """Least-squares weights without intercept by gradient descent from 0.

    Iteration ``i`` moves ``step/sqrt(i)`` against the mean gradient.
    ``penalty="l2"`` also shrinks the weights (ridge), ``"l1"`` soft-thresholds
    them (lasso). Stops when the move is below ``tolerance`` times the weights'
    length (at least 1).
    """
    if penalty not in (None, "l1", "l2"):
        raise ValueError("penalty is None, 'l1' or 'l2'")
    with kept(df.select(label, *features)) as data:
        return _linear_descent(data, features, label, iterations, step, penalty, reg, tolerance)


@contextmanager
def kept(data: DataFrame) -> Iterator[DataFrame]:
    """Rows kept for the passes of a loop, and let go however it ends."""
    data.persist()
    try:
        yield data
    finally:
        data.unpersist()


def _linear_descent(data, features, label, iterations, step, penalty, reg, tolerance) -> list[float]:
    weights = [0.0] * len(features)
    for i in range(1, iterations + 1):
        sums, n = _gradient(data, score(weights, features) - F.col(label), features)
        if n == 0:
            break
        rate = step / math.sqrt(i)
        moved = [w * (1 - rate * reg) if penalty == "l2" else w for w in weights]
        moved = [w - rate * g / n for w, g in zip(moved, sums)]
        if penalty == "l1":
            moved = [math.copysign(max(0.0, abs(w) - rate * reg), w) for w in moved]
        change = math.dist(moved, weights)
        weights = moved
        if i > 1 and change < tolerance * max(math.hypot(*weights), 1.0):
            break
    return weights


def logistic_descent(
    df: DataFrame,
    features: list[str],
    label: str = "label",
    iterations: int = 5,
    start: list[float] | None = None,
    step: float = 1.0,
) -> list[float]:
    """Logistic weights for labels -1 and +1; each iteration subtracts the summed
    gradient ``(1/(1+exp(-y w.x)) - 1) y x``."""
    weights = list(start or [0.0] * len(features))
    y = F.col(label)
    with kept(df.select(label, *features)) as data:
        for _ in range(iterations):
            factor = (1.0 / (1.0 + F.exp(-y * score(weights, features))) - 1.0) * y
            sums, _n = _gradient(data, factor, features)
            weights = [w - step * g for w, g in zip(weights, sums)]
    return weights


def called(score: Column, threshold: float = 0.5) -> Column:
    """1 where the score is above the threshold, else 0."""
    return F.when(score > threshold, 1.0).otherwise(0.0)


def weight_table(spark, features: list[str], weights: list[float]) -> DataFrame:
    return spark.createDataFrame(list(zip(features, map(float, weights))), "feature string, weight double")


def mean_squared_error(df: DataFrame, label: str, prediction: Column) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(label) - prediction, F.lit(2.0))).alias("mse"))


def area_under_roc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Exact area under the ROC curve; a tie counts half.

    Rows are first counted per distinct score, and the counts are written once. Those below
    a score come from range partitions, so no task orders more than one of them.
    """
    hit = F.when(positive, 1).otherwise(0)
    per_score = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )
    bucketed = with_lower_totals(ranged(per_score, "s"), {"_base": "neg"})
    below = Window.partitionBy(BUCKET).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_base") + F.coalesce(F.sum("neg").over(below), F.lit(0))
    wins = F.col("pos") * (before + F.col("neg") / 2)
    return bucketed.select(wins.alias("wins"), "pos", "neg").agg(
        (F.sum("wins") / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc")
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``label, prediction, n``."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_metrics(matrix: DataFrame) -> DataFrame:
    """``class, precision, recall, f, accuracy`` from a confusion matrix."""
    right = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    everything = matrix.agg(F.sum("n").alias("n")).scalar()
    hits = matrix.agg(F.sum(right).alias("n")).scalar()
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"), right.cast("long").alias("hit")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
            )
        ).alias("x")
    ).select("x.*")
    sums = sides.groupBy("class").agg(F.sum("actual").alias("a"), F.sum("called").alias("c"), F.sum("hit").alias("h"))
    ratio = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    return sums.select(
        "class",
        ratio(F.col("h"), F.col("c")).alias("precision"),
        ratio(F.col("h"), F.col("a")).alias("recall"),
        ratio(2 * F.col("h"), F.col("a") + F.col("c")).alias("f"),
        (hits / everything).alias("accuracy"),
    )


def save_weights(df: DataFrame, path: str) -> None:
    """A weight table as a folder; a repeated write replaces it."""
    df.write.mode("overwrite").parquet(path)


def load_weights(spark, path: str, features: list[str]) -> list[float]:
    found = {r["feature"]: r["weight"] for r in spark.read.parquet(path).collect()}
    return [found[f] for f in features]
