"""Fits, scores and the parameter search."""

import math

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from meterflow.constants import FAILED_TRIAL_FITNESS
from meterflow.functions.vectors import rowwise
from meterflow.operators import models, reports, search
from meterflow.operators.scaling import ColumnStats
from meterflow.plans import forecast, household

STATS = ColumnStats({"y": 0.0}, {"y": 0.0}, {"y": 10.0})


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).selectExpr(
        "elt(id % 4 + 1, 'train', 'train', 'val', 'test') AS split",
        "(id % 17) / 17.0D AS a", "(id % 23) / 23.0D AS b")
    df = df.withColumn("y", 0.3 * F.col("a") + 0.5 * F.col("b") + 0.1)
    return models.assembled(df, ["b", "a"]).cache()


def test_linear_fit_is_exact(spark, rows, tmp_path):
    scored = models.fit_and_score(models.linear(), rows, STATS, "linear")
    row = scored.metrics.first()
    assert row.n == 100 and row.R2 == pytest.approx(1.0) and row.RMSE < 1e-6
    top = models.importance(scored.model, ["a", "b"], rows).collect()
    assert [(r.feature, round(r.coefficient, 6)) for r in top] == [("b", 0.5), ("a", 0.3)]
    models.save_model(scored.model, str(tmp_path / "model"))
    loaded = LinearRegressionModel.load(str(tmp_path / "model"))
    assert loaded.coefficients == scored.model.coefficients


@pytest.mark.parametrize("make", [
    lambda: models.robust_linear(), lambda: models.forest(5, 5), lambda: models.boosted(3)])
def test_fits_are_finite_and_repeat(rows, make):
    first, second = (models.fit_and_score(make(), rows, STATS, "m").metrics.first() for _ in "12")
    assert all(math.isfinite(first[m]) for m in ("RMSE", "MAE", "R2", "RMSLE"))
    assert first.R2 > 0.5 and first.RMSE == pytest.approx(second.RMSE)


def test_fourier_features_approach_the_kernel(rows):
    gamma = 0.7
    pairs = rows.limit(2)
    x = np.array([r.features.toArray() for r in pairs.collect()])
    z = np.array([r.features.toArray() for r in models.fourier_features(pairs, 4000, gamma).collect()])
    assert z[0] @ z[1] == pytest.approx(math.exp(-gamma * ((x[0] - x[1]) ** 2).sum()), abs=0.05)


def test_forecast_on_household_windows(spark):
    df = spark.range(300).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2016-01-01' + make_dt_interval(0, 0, id) AS timestamp",
        "10 + 5 * sin(id / 8.0D) AS P")
    data = household.household_data(df, 3, 5, ("P",), rows_per_chunk=50)
    scored = models.fit_and_score(
        models.linear(), forecast.window_frame(data.windows), data.parts.target_stats(), "windows")
    assert scored.metrics.first().R2 > 0.99


def test_rowwise_function(spark):
    df = spark.range(50).selectExpr("id", "array(id, 2.0D * id) AS x")
    out = df.withColumn("y", rowwise(lambda x: (x**2).sum(axis=1))("x")).collect()
    assert [r.y for r in out] == [5.0 * r.id**2 for r in out]


def test_candidates_are_decoded_and_scored(spark):
    points = spark.createDataFrame([([0.0] * 4,), ([1.0] * 4,), ([2.0, 2.0, 2.0, 0.0],), ([0.0] * 4,)], "x array<double>")
    table = search.candidates(points)
    assert {tuple(r) for r in table.collect()} == {(32, 1, 3, 0.005), (512, 4, 32, 0.02), (512, 4, 32, 0.005)}
    logged = []

    def evaluate(params):
        return {**vars(params), "VAL_RMSE_orig": float(abs(params.units - 500) + params.learning_rate)}

    trials = search.score_candidates(spark, evaluate, table, parallelism=2, log=lambda t: logged.append(t.count()))
    assert [r.eval_num for r in trials.orderBy("units", "learning_rate").collect()] == [1, 2, 3] and logged == [3]
    best = reports.best_trial(trials).first()
    assert (best.units, best.learning_rate) == (512, 0.005)


def test_candidate_without_windows_fails(spark, rows):
    objective = search.Objective(lambda length: rows.where("split = 'test'"), STATS)
    assert objective.evaluate(search.Params(32, 1, 3, 0.01))["VAL_RMSE_orig"] == FAILED_TRIAL_FITNESS
