"""Queries: metrics, error distributions, trial logs and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as o
from catalog.registry import long, query, r6
from catalog.views import Views
from meterflow.functions.scalars import decode_params as decoded
from meterflow.operators import metrics, reports
from meterflow.operators.models import one_feature_fit
from meterflow.operators.series import Series


@query(f"""WITH {o.PREDICTIONS}
SELECT model, COUNT(*) AS n, ROUND(AVG(POW(y_pred - y_true, 2)), 4) AS MSE,
  ROUND(SQRT(AVG(POW(y_pred - y_true, 2))), 6) AS RMSE,
  ROUND(AVG(ABS(y_pred - y_true)), 6) AS MAE,
  ROUND(100 * AVG(CASE WHEN y_true <> 0 THEN ABS((y_pred - y_true) / y_true) END), 4) AS MAPE,
  ROUND(100 * AVG(CASE WHEN ABS(y_true) > 1 THEN ABS((y_pred - y_true) / y_true) END), 4) AS MAPE_abs1,
  ROUND(100 * AVG(ABS((y_pred - y_true) / GREATEST(y_true, 1e-9))), 4) AS MAPE_clipped,
  ROUND(1 - SUM(POW(y_true - y_pred, 2)) / (COUNT(*) * VAR_POP(y_true)), 6) AS R2,
  ROUND(SQRT(AVG(POW(LN(1 + GREATEST(y_pred, 0)) - LN(1 + GREATEST(y_true, 0)), 2))), 6) AS RMSLE,
  MIN(y_true) AS y_min, MAX(y_true) AS y_max, MIN(y_pred) AS p_min, MAX(y_pred) AS p_max
FROM predictions GROUP BY model""")
def metrics_all(v: Views):
    out = metrics.metrics(v.predictions())
    four = {"MSE", "MAPE", "MAPE_abs1", "MAPE_clipped"}
    return out.select("model", "n", "y_min", "y_max", "p_min", "p_max", *[
        F.round(m, 4 if m in four else 6).alias(m) for m in metrics.METRICS])


@query(f"""WITH {o.PREDICTIONS}, e AS (SELECT model, ABS(y_true - y_pred) AS x FROM predictions),
q AS (SELECT model, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
  quantile_cont(x, 0.75) AS q3 FROM e GROUP BY 1)
SELECT model, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  ROUND(MIN(x) FILTER (x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  ROUND(MAX(x) FILTER (x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
FROM e JOIN q USING (model) GROUP BY model, q1, median, q3""")
def error_boxplot(v: Views):
    boxes = metrics.error_boxes(v.predictions())
    return boxes.select("model", *[r6(c) for c in boxes.columns if c != "model"])


@query(f"""WITH {o.PREDICTIONS}, e AS (SELECT model, ABS(y_true - y_pred) AS x FROM predictions),
g AS (SELECT model, COUNT(*) AS n, AVG(x) AS m, VAR_POP(x) AS v FROM e GROUP BY 1),
a AS (SELECT AVG(x) AS grand, COUNT(*) AS total FROM e)
SELECT ROUND((SUM(n * POW(m - grand, 2)) / (COUNT(*) - 1)) /
    (SUM(n * v) / (MAX(total) - COUNT(*))), 4) AS f,
  COUNT(*) - 1 AS df1, CAST(MAX(total) - COUNT(*) AS BIGINT) AS df2 FROM g, a""")
def anova_f(v: Views):
    errors = v.predictions().withColumn("abs_error", F.abs(F.col("y_true") - F.col("y_pred")))
    return metrics.anova(errors).select(F.round("f", 4).alias("f"), long("df1"), long("df2"))


@query(f"""WITH {o.PREDICTIONS} SELECT model, CAST(FLOOR(y_true / 10) AS BIGINT) AS y_bin,
  CAST(FLOOR(y_pred / 10) AS BIGINT) AS p_bin, COUNT(*) AS n
FROM predictions GROUP BY 1, 2, 3""")
def scatter_bins(v: Views):
    return metrics.scatter_bins(v.predictions(), 10.0)


@query(f"""WITH {o.PREDICTIONS} SELECT model, row_id, y_true, y_pred FROM predictions
QUALIFY row_number() OVER (PARTITION BY model ORDER BY row_id) <= 2000""")
def series_snippet(v: Views):
    rows = v.predictions()
    return Series(["model"], ("row_id", "row_id")).measure(rows, few=True).first(rows, 2000)


@query(f"""WITH {o.LAGGED} SELECT meter, ROUND(regr_slope(meter_reading, lag1), 6) AS slope,
  ROUND(regr_intercept(meter_reading, lag1), 6) AS intercept, COUNT(*) AS n
FROM lagged WHERE pos > 1 GROUP BY meter""")
def lr_lag1(v: Views):
    lagged = v.readings_layout().over(
        v.readings(), lambda w, pos: {"lag1": F.lag("meter_reading").over(w)}, preceding=1
    ).where("lag1 IS NOT NULL")
    fit = one_feature_fit(lagged, "meter", "meter_reading", "lag1")
    return fit.select("meter", r6("slope"), r6("intercept"), "n")


@query(f"""WITH {o.TRIALS} SELECT algorithm, COUNT(*) AS total_evaluations,
  ROUND(AVG(epochs_trained), 1) AS avg_epochs_per_eval,
  CAST(SUM(epochs_trained) AS BIGINT) AS total_epochs,
  ROUND(COUNT(*) * CAST(2.5 AS DOUBLE), 1) AS estimated_train_time_min FROM trials GROUP BY 1""")
def trial_summary(v: Views):
    return reports.trial_summary(v.trials())


@query("""WITH h AS (SELECT o_custkey AS run, o_orderkey AS epoch, o_totalprice AS loss,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2 END AS val_loss FROM orders),
ranked AS (SELECT *, COUNT(val_loss) OVER (PARTITION BY run) AS vals FROM h)
SELECT run, epoch AS best_epoch, CASE WHEN vals > 0 THEN val_loss ELSE loss END AS best_loss
FROM ranked WHERE vals = 0 OR val_loss IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY run
  ORDER BY CASE WHEN vals > 0 THEN val_loss ELSE loss END, epoch) = 1""")
def best_epoch(v: Views):
    history = v.table("orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("epoch"),
        F.col("o_totalprice").alias("loss"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 2).alias("val_loss"),
    )
    return reports.best_epoch(history, ["run"])


@query(f"""WITH {o.TRIALS}, b AS (SELECT algorithm, eval_num, trial_id, VAL_RMSE_orig FROM trials
  QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY VAL_RMSE_orig, eval_num) = 1)
SELECT * FROM b UNION ALL
(SELECT 'overall', eval_num, trial_id, VAL_RMSE_orig FROM b
 ORDER BY VAL_RMSE_orig, eval_num LIMIT 1)""")
def best_trial(v: Views):
    each = reports.best_trial(v.trials().select("algorithm", "eval_num", "trial_id", "VAL_RMSE_orig"))
    overall = reports.best_trial(each.withColumn("algorithm", F.lit("overall")))
    return each.unionByName(overall)


@query(f"WITH {o.CURVE} SELECT algorithm, eval_num, best_so_far FROM curve")
def convergence_curve(v: Views):
    trials = v.trials()
    curve = reports.convergence(trials, v.trials_layout(trials))
    return curve.select("algorithm", "eval_num", "best_so_far")


@query(f"""WITH {o.CURVE}, fell AS (SELECT *, LAG(best_so_far) OVER (
  PARTITION BY algorithm ORDER BY eval_num) AS before FROM curve),
ends AS (SELECT algorithm, MAX(eval_num) AS last FROM fell
  WHERE before IS NULL OR best_so_far < before GROUP BY 1)
SELECT algorithm, eval_num, best_so_far FROM curve JOIN ends USING (algorithm)
WHERE eval_num <= last""")
def convergence_filled(v: Views):
    trials = v.trials()
    layout = v.trials_layout(trials)
    events = reports.improvements(reports.convergence(trials, layout), layout)
    return reports.step_fill(events.select("algorithm", "eval_num", "best_so_far"), layout.series)


@query(f"""WITH {o.LATEST} SELECT Model, RMSE, MAE, o_orderkey FROM latest""")
def latest_per_model(v: Views):
    return reports.latest_per_group(v.metrics_runs(), ["Model"], "timestamp", "o_orderkey").drop(
        "timestamp")


LABELS = {"1-URGENT": "Urgent", "2-HIGH": "High"}


@query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High'
  ELSE o_orderpriority END AS Model, ROUND(AVG(o_totalprice), 2) AS "RMSE (kWh)",
  MAX(o_totalprice) AS "MAE (kWh)" FROM orders GROUP BY o_orderpriority""")
def leaderboard_export(v: Views):
    table = v.table("orders").groupBy(F.col("o_orderpriority").alias("Model")).agg(
        F.avg("o_totalprice").alias("RMSE"), F.max("o_totalprice").alias("MAE"))
    return reports.leaderboard(
        table, LABELS, {"RMSE": "RMSE (kWh)", "MAE": "MAE (kWh)"}, digits=2)


@query(f"""WITH {o.LATEST}, cost AS (SELECT o_orderpriority AS Model,
  COUNT(*) AS total_evaluations FROM orders GROUP BY 1)
SELECT Model, RMSE, MAE, total_evaluations FROM latest JOIN cost USING (Model)""")
def perf_vs_cost(v: Views):
    latest = reports.latest_per_group(v.metrics_runs(), ["Model"], "timestamp", "o_orderkey")
    cost = reports.trial_summary(v.trials()).withColumnRenamed("algorithm", "Model")
    return latest.join(cost, "Model").select("Model", "RMSE", "MAE", "total_evaluations")


@query(f"WITH {o.TRIALS} SELECT trial_id, {o.DECODED} FROM trials")
def decode_params(v: Views):
    trials = v.trials().withColumns(decoded(F.col("x")))
    return trials.select("trial_id", "units", "num_layers", "seq", r6("learning_rate"))


@query(f"""WITH {o.TRIALS} SELECT algorithm, {o.DECODED} FROM trials
QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY VAL_RMSE_orig, eval_num) = 1""")
def params_table(v: Views):
    params = F.create_map(*[
        item for name, column in decoded(F.col("x")).items()
        for item in (F.lit(name), column.cast("double"))])
    trials = v.trials().withColumn("params", params)
    best = reports.best_trial(trials.select("algorithm", "eval_num", "VAL_RMSE_orig", "params"))
    return reports.params_table(best.select("algorithm", "params")).withColumn(
        "learning_rate", r6("learning_rate"))


@query("""SELECT event_id, value AS RMSE,
  CASE WHEN event_type = 'click' THEN value / 2 END AS MAE, NULL::DOUBLE AS MAPE,
  NULL::DOUBLE AS R2 FROM events WHERE event_type <> 'error'""")
def payload_metrics(v: Views):
    value, kind = F.col("value"), F.col("event_type")
    payload = (
        F.when(kind == "click", F.to_json(F.struct(
            value.alias("RMSE_orig"), (value / 2).alias("VAL_MAE_orig"))))
        .when(kind == "error", F.lit("{}"))
        .otherwise(F.to_json(F.struct(value.alias("VAL_RMSE_orig"))))
    )
    rows = v.table("events").select("event_id", payload.alias("payload"))
    return reports.payload_metrics(rows, "payload")
