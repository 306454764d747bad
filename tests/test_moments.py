"""Linear fits from cross products against numpy."""

import numpy as np
import pytest

from meterflow.operators import moments

SCHEMA = "split string, a double, b double, d double, e double, y double"


def table(spark, n=400, seed=1):
    draw = np.random.default_rng(seed)
    a, b = draw.normal(50, 9, n), draw.uniform(-3, 3, n)
    d = draw.integers(0, 2, n).astype(float)
    y = 2 * a - 7 * b + 11 * d + draw.normal(0, 1, n) + 1000
    gaps = draw.random((n, 3)) < 0.1
    parts = np.array(["train", "val", "test", None], dtype=object)[draw.choice(4, n, p=[0.5, 0.2, 0.2, 0.1])]
    rows = [(parts[i], None if gaps[i, 0] else float(a[i]), None if gaps[i, 1] else float(b[i]), float(d[i]),
             float(1 - d[i]), None if gaps[i, 2] else float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5), rows


def brute(rows, names, train=("train", "val")):
    """Imputed and scaled matrix, its least-squares solution, and the ranges."""
    at = {name: i + 1 for i, name in enumerate("abdey")}
    stats = {}
    for name in "aby":
        seen = [r[at[name]] for r in rows if r[0] == "train" and r[at[name]] is not None]
        stats[name] = (np.mean(seen), min(seen), max(seen)) if seen else (0.0, 0.0, 0.0)

    def value(r, name):
        x = r[at[name]]
        if name not in stats:
            return x
        mean, low, high = stats[name]
        return ((mean if x is None else x) - low) / ((high - low) or 1.0)

    used = [r for r in rows if r[0] in train]
    x = np.array([[1.0, *(value(r, c) for c in names)] for r in used])
    return x, np.array([value(r, "y") for r in used]), stats


def test_fit_is_least_squares(spark):
    df, rows = table(spark)
    fit, stats = moments.fit_linear(df, ["a", "b"], ["d"])
    x, y, want = brute(rows, fit.features)
    weights = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit.features == ("a", "b", "d")
    assert [fit.intercept, *fit.coefficients] == pytest.approx(weights, rel=1e-8)
    for name, (mean, low, high) in want.items():
        assert (stats.mean[name], stats.low[name], stats.high[name]) == pytest.approx((mean, low, high))


def test_dependent_columns_weigh_nothing(spark):
    df, rows = table(spark)
    fit, _ = moments.fit_linear(df, ["a", "b"], ["d", "e"])
    assert fit.coefficients[fit.features.index("e")] == 0.0  # 1 - d depends on the intercept and d
    x, y, _ = brute(rows, fit.features)
    best = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert x @ np.array([fit.intercept, *fit.coefficients]) == pytest.approx(best, rel=1e-8)


def test_predictions_are_a_projection(spark):
    df, rows = table(spark, 60)
    fit, stats = moments.fit_linear(df, ["a", "b"], ["d"])
    scaled = stats.scale(stats.impute(df.where("split IN ('train', 'val')")))
    got = sorted(r[0] for r in scaled.select(fit.predicted()).collect())
    x, _, _ = brute(rows, fit.features)
    assert got == pytest.approx(sorted(x @ np.array([fit.intercept, *fit.coefficients])))


def test_one_pass(spark):
    """Statistics and fit read the rows once, and only cells are shuffled."""
    df, _ = table(spark, 50)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    moments.fit_linear(df, ["a", "b"], ["d"])
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)) <= 3


def test_edges(spark):
    df, _ = table(spark, 30)
    fit, stats = moments.fit_linear(df.limit(0), ["a", "b"], ["d"])
    assert (fit.intercept, list(fit.coefficients), stats.mean["a"]) == (0.0, [0.0, 0.0, 0.0], 0.0)
    gaps = spark.createDataFrame([("train", None, 1.0, 0.0, 1.0, 5.0), ("train", None, 2.0, 0.0, 1.0, 7.0)], SCHEMA)
    fit, stats = moments.fit_linear(gaps, ["a", "b"], ["d"])
    assert (stats.low["a"], stats.high["a"]) == (0.0, 0.0)
    assert [fit.intercept, *fit.coefficients] == pytest.approx([0.0, 0.0, 1.0, 0.0])
    odd = spark.createDataFrame([("train", float("nan"), 1.0, 0.0, 1.0, 5.0)], SCHEMA)
    with pytest.raises(ValueError):
        moments.fit_linear(odd, ["a", "b"], ["d"])
