"""Queries: fitted models and parameter search. Of the fits, linear least squares have a SQL
form: sums of products and an elimination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import oracle as o
from catalog.registry import query, r6
from catalog.series import FEATURES, NUMERIC, USES, _prepared
from catalog.views import Views
from meterflow.functions.scalars import decode_params, logistic_map
from meterflow.operators import metrics, models, moments, reports, search, splits, svr
from meterflow.plans import forecast, household, preprocess
from meterflow.session import stored

# Normal equations of the imputed and scaled features of the training and validation rows, by name
# behind the intercept, and their solution: columns are eliminated one by one, and one whose rest is
# nothing depends on earlier ones and weighs 0.
_NAMES = sorted([*NUMERIC, *(f"primary_use_{u}" for u in USES)])
_SIZE = len(_NAMES) + 1
LINEAR = f"""WITH RECURSIVE {FEATURES}, fit AS (SELECT {", ".join(
    f"COALESCE(AVG({c}), 0) AS m_{c}, COALESCE(MIN({c}), 0) AS l_{c}, "
    f"COALESCE(MAX({c}), 0) AS h_{c}" for c in (*NUMERIC, "y"))}
  FROM prepared WHERE split = 'train'),
rows AS (SELECT split, [1.0::DOUBLE, {", ".join(
    f"(COALESCE({c}, m_{c}) - l_{c}) / CASE WHEN h_{c} = l_{c} THEN 1 ELSE h_{c} - l_{c} END"
    if c in (*NUMERIC, "y") else c for c in (*_NAMES, "y"))}] AS x, l_y, h_y FROM prepared, fit),
cells AS (SELECT i, j, SUM(x[i + 1] * x[j + 1]) AS s FROM rows,
  range({_SIZE + 1}) a(i), range({_SIZE + 1}) b(j) WHERE split IN ('train', 'val') GROUP BY i, j),
lines AS (SELECT i, list(s ORDER BY j) AS line FROM cells GROUP BY i),
start AS (SELECT list(line ORDER BY i) AS m FROM lines),
steps AS (
  SELECT 0 AS k, m, list_transform(range({_SIZE}), lambda i: m[i + 1][i + 1]) AS whole, []::BOOLEAN[] AS used FROM start
  UNION ALL
  SELECT k + 1, CASE WHEN m[k + 1][k + 1] <= 1e-9 * whole[k + 1] THEN m ELSE
      list_transform(range({_SIZE + 1}), lambda r: CASE WHEN r = k THEN m[r + 1] ELSE list_transform(range({_SIZE + 1}),
        lambda c: m[r + 1][c + 1] - m[r + 1][k + 1] / m[k + 1][k + 1] * m[k + 1][c + 1]) END) END,
    whole, list_append(used, m[k + 1][k + 1] > 1e-9 * whole[k + 1])
  FROM steps WHERE k < {_SIZE}),
weights AS (
  SELECT i, CASE WHEN used[i + 1] THEN m[i + 1][{_SIZE + 1}] / m[i + 1][i + 1] ELSE 0 END AS w, {_NAMES!r} AS names
  FROM steps, range({_SIZE}) t(i) WHERE k = {_SIZE}),
vector AS (SELECT list(w ORDER BY i) AS ws FROM weights),
predicted AS (
  SELECT x[{_SIZE + 1}] * (h_y - l_y) + l_y AS y,
    GREATEST(list_dot_product(ws, x[1:{_SIZE}]) * (h_y - l_y) + l_y, 0) AS p
  FROM rows, vector WHERE split = 'test')"""

SHOWN = ("RMSE", "MAE", "MAPE", "R2", "RMSLE")


def _shown(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", "n", *[r6(m) for m in SHOWN])


def _lag_rows(v: Views):
    done = preprocess.finish(_prepared(v))
    return forecast.lag_frame(done, v.readings_layout()), done.stats


def _benchmark(v: Views):
    """The linear fit, its scores on the test part, and the features' frame."""
    prepared = _prepared(v)
    fit, stats = moments.fit_linear(prepared.frame, prepared.numeric, prepared.dummies)
    rows = stats.scale(stats.impute(splits.only_splits(prepared.frame, "test")))
    scored = rows.select(
        stats.restored("y").alias("y_true"), stats.restored("y", fit.predicted()).alias("y_pred"))
    return fit, scored.withColumn("y_pred", metrics.clamped()), prepared


@query(f"""{LINEAR} SELECT 'linear' AS model, COUNT(*) AS n,
  ROUND(SQRT(AVG(POW(p - y, 2))), 6) AS RMSE, ROUND(AVG(ABS(p - y)), 6) AS MAE,
  ROUND(100 * AVG(CASE WHEN y <> 0 THEN ABS((p - y) / y) END), 6) AS MAPE,
  ROUND(1 - AVG(POW(p - y, 2)) / VAR_POP(y), 6) AS R2,
  ROUND(SQRT(AVG(POW(LN(1 + p) - LN(1 + GREATEST(y, 0)), 2))), 6) AS RMSLE
FROM predicted""")
def lr_benchmark(v: Views):
    _, scored, _ = _benchmark(v)
    return _shown(scored.agg(*metrics.metric_columns()).withColumn("model", F.lit("linear")))


@query(f"""{LINEAR}, weighed AS (
  SELECT CAST(i - 1 AS INTEGER) AS feature_index, names[i] AS feature, w AS coefficient, ABS(w) AS importance
  FROM weights WHERE i > 0)
SELECT feature_index, feature, ROUND(coefficient, 6) AS coefficient, ROUND(importance, 6) AS importance
FROM weighed ORDER BY weighed.importance DESC, feature_index LIMIT 10""")
def feature_importance(v: Views):
    prepared = _prepared(v)
    fit, _ = moments.fit_linear(prepared.frame, prepared.numeric, prepared.dummies)
    top = models.importance(fit, fit.features, prepared.frame)
    return top.select("feature_index", "feature", r6("coefficient"), r6("importance"))


@query()
def rf_forecast(v: Views):
    rows, stats = _lag_rows(v)
    return _shown(models.fit_and_score(models.forest(), stored(rows), stats, "forest").metrics)


@query()
def rff_regression(v: Views):
    rows, stats = _lag_rows(v)
    mapped = models.fourier_features(rows)
    return _shown(models.fit_and_score(models.robust_linear(), mapped, stats, "kernel").metrics)


@query()
def robust_linear(v: Views):
    rows, stats = _lag_rows(v)
    return _shown(models.fit_and_score(models.robust_linear(), rows, stats, "robust").metrics)


@query()
def linear_svr(v: Views):
    """Epsilon-insensitive fit with the defaults of the usual linear support vector regression."""
    rows, stats = _lag_rows(v)
    rows = stored(rows)
    fit = svr.linear_svr(rows.where(F.col("split").isin("train", "val")))
    scored = rows.where("split = 'test'").select(
        stats.restored("y").alias("y_true"), stats.restored("y", fit.predicted()).alias("y_pred"))
    shown = scored.withColumn("y_pred", metrics.clamped()).agg(*metrics.metric_columns())
    return _shown(shown.withColumn("model", F.lit("svr")))


@query()
def gbt_forecast(v: Views):
    data = household.household_data(v.household(), 3, 7)
    rows = forecast.window_frame(data.windows).withColumn("_held_out", F.col("split") == "val")
    model = models.boosted(validation="_held_out")
    return _shown(models.fit_and_score(model, rows, data.parts.target_stats(), "boosted").metrics)


def _objective(v: Views) -> search.Objective:
    parts = household.scaled_parts(v.household(), 3)

    def windowing(length: int) -> DataFrame:
        return forecast.window_frame(parts.windows(length))

    return search.Objective(windowing, parts.target_stats())


# The declared candidates, as points of the unit cube.
POINTS = ([0.0, 0.0, 0.0, 0.5], [0.1, 0.4, 0.1, 0.5], [0.2, 0.7, 0.2, 0.9])


def _candidates(v: Views) -> DataFrame:
    points = v.spark.createDataFrame([(p,) for p in POINTS], "x array<double>")
    return search.candidates(points)


@query()
def trial_eval(v: Views):
    first = _candidates(v).orderBy("units").limit(1)
    log = search.score_candidates(v.spark, _objective(v).evaluate, first)
    return log.select(
        "algorithm", "eval_num", "units", "num_layers", "seq", r6("learning_rate"),
        r6("VAL_RMSE_scaled"), r6("VAL_RMSE_orig"), r6("VAL_R2_orig"), "epochs_trained")


@query()
def candidate_search(v: Views):
    trials = search.score_candidates(v.spark, _objective(v).evaluate, _candidates(v), parallelism=3)
    return trials.select(
        "algorithm", "eval_num", "units", "num_layers", "seq", r6("VAL_RMSE_orig"))


@query()
def refit_best(v: Views):
    objective = _objective(v)
    trials = search.score_candidates(v.spark, objective.evaluate, _candidates(v), parallelism=3)
    best = reports.best_trial(trials).first()
    params = search.Params(best.units, best.num_layers, best.seq, best.learning_rate)
    return _shown(objective.refit(params, best.algorithm).metrics)


CHAOS = "0.4 * {0} * (1 - {0})"


@query(f"""WITH {o.TRIALS}, grown AS (
  SELECT trial_id, 1 AS step, x0, x1, x2, x3 FROM trials
  UNION ALL SELECT trial_id, 2, {", ".join(CHAOS.format(f"x{i}") for i in range(4))} FROM trials
  UNION ALL SELECT trial_id, 3,
  {", ".join(CHAOS.format("(" + CHAOS.format(f"x{i}") + ")") for i in range(4))} FROM trials)
SELECT trial_id, CAST(step AS BIGINT) AS step, {o.DECODED} FROM grown""")
def trial_candidates(v: Views):
    starts = v.trials().select("trial_id", "x")
    paths = F.arrays_zip(*[
        logistic_map(F.get("x", F.lit(i)), 3).alias(f"x{i}") for i in range(4)])
    grown = starts.select("trial_id", F.posexplode(paths))
    vector = F.array(*[F.col(f"col.x{i}") for i in range(4)])
    out = grown.withColumns(decode_params(vector))
    return out.select(
        "trial_id", (F.col("pos") + 1).cast("long").alias("step"), "units", "num_layers", "seq",
        r6("learning_rate"))
