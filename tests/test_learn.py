import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweft.operators import learn as L
from topicweft.plans.skew import HotKeys, count_by


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((1.0 if x - 0.5 * y + rng.gauss(0, 0.5) > 0 else 0.0, x, y))
    return rows, spark.createDataFrame(rows, "label double, x double, y double")


def expected_descent(rows, iterations, penalty=None, reg=0.01):
    a = np.array(rows)
    y, x, w = a[:, 0], a[:, 1:], np.zeros(2)
    for i in range(1, iterations + 1):
        rate = 1 / math.sqrt(i)
        g = x.T @ (x @ w - y) / len(y)
        w = (w * (1 - rate * reg) if penalty == "l2" else w) - rate * g
        if penalty == "l1":
            w = np.sign(w) * np.maximum(0, np.abs(w) - rate * reg)
    return w


@pytest.mark.parametrize("penalty", [None, "l1", "l2"])
def test_descent(data, penalty):
    rows, df = data
    got = L.linear_descent(df, ["x", "y"], iterations=6, penalty=penalty, tolerance=0.0)
    assert got == pytest.approx(expected_descent(rows, 6, penalty))


def test_descent_reaches_least_squares(data):
    rows, df = data
    a = np.array(rows)
    best = np.linalg.lstsq(a[:, 1:], a[:, 0], rcond=None)[0]
    assert L.linear_descent(df, ["x", "y"], iterations=100, tolerance=1e-6) == pytest.approx(best, abs=1e-2)


def test_logistic(data):
    rows, df = data
    a = np.array(rows)
    y, x, w = 2 * a[:, 0] - 1, a[:, 1:], np.zeros(2)
    for _ in range(3):
        scale = (1 / (1 + np.exp(-y * (x @ w))) - 1) * y
        w = w - 0.01 * x.T @ scale
    signed = df.withColumn("label", 2 * F.col("label") - 1)
    assert L.logistic_descent(signed, ["x", "y"], iterations=3, step=0.01) == pytest.approx(w)


def test_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(float(rng.randrange(2)), float(rng.randrange(12))) for _ in range(300)]
    pos = [s for l, s in rows if l]
    neg = [s for l, s in rows if not l]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "label double, score double")
    assert L.area_under_roc(df, "score", F.col("label") > 0).first()["auc"] == pytest.approx(want)


def test_auc_matches_spark_ml(data):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    _, df = data
    scored = df.withColumn("score", F.col("x") - F.col("y"))
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(scored)
    assert L.area_under_roc(scored, "score", F.col("label") > 0).first()["auc"] == pytest.approx(theirs)


def test_confusion_metrics(spark):
    rows = [(1.0, 1.0)] * 3 + [(1.0, 0.0)] * 1 + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 4
    m = L.confusion(spark.createDataFrame(rows, "l double, p double"), "l", "p")
    assert {(r["label"], r["prediction"]): r["n"] for r in m.collect()} == {(1, 1): 3, (1, 0): 1, (0, 1): 2, (0, 0): 4}
    by_class = {r["class"]: r for r in L.class_metrics(m).collect()}
    assert by_class[1.0]["precision"] == pytest.approx(0.6) and by_class[1.0]["recall"] == pytest.approx(0.75)
    assert by_class[0.0]["accuracy"] == pytest.approx(0.7)


def test_mse_and_weights(spark, data):
    _, df = data
    mse = L.mean_squared_error(df, "label", L.score([0.0, 0.0], ["x", "y"], 0.5)).first()["mse"]
    assert mse == pytest.approx(0.25)
    assert L.weight_table(spark, ["x"], [1]).first()["weight"] == 1.0


def test_standardised(data):
    _, df = data
    row = L.standardised(df, ["x"]).agg(F.avg("x"), F.stddev_pop("x")).first()
    assert tuple(row) == pytest.approx((0.0, 1.0), abs=1e-9)


def test_hot_key_join_keeps_all_rows(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9).alias("k"), "id")
    small = spark.range(9).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = HotKeys(count_by(big, "k"), "k", parts=8)
    assert hot.any
    got = hot.join(big, small, by=["id"]).groupBy("k", "v").count()
    want = big.join(small, "k").groupBy("k", "v").count()
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert hot.join(big, small.filter("k > 3"), by=["id"], how="left").count() == 1000


def test_dot_is_the_same_on_both_sides_of_its_switch(spark):
    from topicweft.functions.arrays import dot

    rng = random.Random(4)
    for k in (1, 16, 17, 40):
        a, b = ([rng.uniform(-1, 1) for _ in range(k)] for _ in range(2))
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        want = 0.0
        for x, y in zip(a, b):
            want += x * y
        assert df.select(dot(F.col("a"), F.col("b"), k).alias("d")).first()["d"] == pytest.approx(want, abs=1e-12)


def test_called_threshold(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.7,)], "s double")
    assert [r[0] for r in df.select(L.called(F.col("s"))).collect()] == [0.0, 0.0, 1.0]
    assert [r[0] for r in df.select(L.called(F.col("s"), 0.1)).collect()] == [1.0] * 3
