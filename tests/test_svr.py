"""Support vector regression against convex search by golden sections."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meterflow.operators import svr

GOLD = (5**0.5 - 1) / 2


def least(f, low, high, rounds=60):
    """The least value of a convex function of one variable."""
    a, b = high - GOLD * (high - low), low + GOLD * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - GOLD * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + GOLD * (high - low)
            fb = f(b)
    return min(fa, fb)


def data(spark, x, y):
    rows = [([float(v) for v in np.atleast_1d(a)], float(b)) for a, b in zip(x, y)]
    return spark.createDataFrame(rows, "a array<double>, y double").repartition(4).select(
        array_to_vector("a").alias("features"), "y")


@pytest.mark.parametrize("c, epsilon", [(1.0, 0.0), (0.01, 0.0), (1.0, 0.5), (10.0, 0.1)])
def test_objective_is_the_least(spark, c, epsilon):
    draw = np.random.default_rng(6)
    x = draw.uniform(0, 1, 300)
    y = 3 * x - 1 + draw.standard_t(1.5, 300) * 0.3  # heavy tails, where squares go wrong

    def objective(w, b):
        return 0.5 * (w * w + b * b) + c * np.maximum(np.abs(y - w * x - b) - epsilon, 0).sum()

    want = least(lambda w: least(lambda b: objective(w, b), -20, 20), -20, 20)
    fit = svr.linear_svr(data(spark, x, y), c, epsilon)
    assert fit.objective == pytest.approx(objective(fit.coefficients[0], fit.intercept))
    assert want * (1 - 1e-9) <= fit.objective <= want * 1.01


def test_outliers_do_not_move_the_line(spark):
    x = np.linspace(0, 1, 200)
    y = 2 * x + 1
    y[::10] += 1000
    df = data(spark, x, y)
    fit = svr.linear_svr(df, 10.0)
    assert (fit.coefficients[0], fit.intercept) == pytest.approx((2, 1), abs=0.05)
    got = df.select("y", fit.predicted().alias("p")).where(F.col("y") < 500).collect()
    assert max(abs(r.p - r.y) for r in got) < 0.1


def test_edges(spark):
    df = data(spark, np.zeros(3), np.array([0.1, -0.1, 0.0]))
    assert svr.linear_svr(df, epsilon=0.2).objective == 0.0  # all rows lie in the tube
    assert list(svr.linear_svr(df.limit(0)).coefficients) == []
