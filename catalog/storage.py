"""Queries: tables written to the shared folder and read back as they lie there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import oracle as o
from catalog.registry import query, r6, text
from catalog.views import Views
from meterflow.operators import reports
from meterflow.operators.resample import ResampleJob
from meterflow.session import shared_folder
from meterflow.sources import readers, results

MEASURES = ("P", "Q", "V")
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _place(v: Views) -> str:
    return f"{shared_folder(v.spark)}/query-{uuid.uuid4().hex}"


@query(f"""SELECT {STAMP.format("time_bucket(INTERVAL '1 hour', ts)")} AS timestamp,
  ROUND(MAX(value), 6) AS P, ROUND(MAX(value / 460), 6) AS Q, CAST(MAX(event_id % 7) AS DOUBLE) AS V
FROM events GROUP BY 1""")
def resampled_files(v: Views):
    """The hourly file of an export beside the raw file, read back by its header."""
    written = results.export_resampled(
        v.household(), [ResampleJob("1D"), ResampleJob("1h", "max")], MEASURES, _place(v), raw=True)
    return readers.read_resampled(v.spark, written[-1], MEASURES).select(
        text("timestamp"), *[r6(m) for m in MEASURES])


@query(f"""WITH {o.BUILDINGS}, {o.WEATHER} SELECT event_id AS building_id, {STAMP.format("ts")} AS timestamp,
  value AS meter_reading, primary_use, square_feet FROM events LEFT JOIN buildings ON user_id = building_id
WHERE event_type = 'click'""")
def star_files(v: Views):
    """Readings of one meter with their buildings, from CSV files with headers."""
    place, readings = _place(v), v.readings().join(v.buildings(), "building_id", "left")
    seconds = F.date_trunc("second", "timestamp").cast("timestamp_ntz").alias("timestamp")
    # every reading is a building of its own here, so that the join key is the file's
    results.export_csv(readings.select(
        F.col("event_id").alias("building_id"), F.when(F.col("meter") == "click", 0).otherwise(1).alias("meter"),
        seconds, "meter_reading"), f"{place}/train.csv")
    results.export_csv(readings.select(
        "site_id", F.col("event_id").alias("building_id"), "primary_use", "square_feet",
        F.lit(None).cast("double").alias("year_built"), F.lit(None).cast("double").alias("floor_count"),
    ), f"{place}/building_metadata.csv")
    empty = [F.lit(None).cast("double").alias(c) for c in (
        "dew_temperature", "sea_level_pressure", "wind_direction", "wind_speed")]
    weather = v.weather().select(
        "site_id", "timestamp", "air_temperature", "cloud_coverage", empty[0], "precip_depth_1_hr", *empty[1:])
    results.export_csv(weather, f"{place}/weather_train.csv")
    star = readers.read_star(v.spark, place, meter=0)
    return star["readings"].join(star["buildings"], "building_id", "left").select(
        "building_id", text("timestamp"), "meter_reading", "primary_use", "square_feet")


@query("""SELECT c_custkey AS id, c_acctbal AS RMSE FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier""")
def fixed_append(v: Views):
    """Two appends to a table whose columns are fixed."""
    store = results.ResultsStore(v.spark, _place(v))
    store.append_fixed(v.table("customer").selectExpr("c_custkey AS id", "c_acctbal AS RMSE"), "runs")
    store.append_fixed(v.table("supplier").selectExpr("s_acctbal AS RMSE", "s_suppkey AS id"), "runs")
    return store.read("runs").select("id", "RMSE")


@query(f"""WITH {o.PREDICTIONS} SELECT model AS algorithm, row_id, y_true, GREATEST(y_pred, 0) AS y_pred
FROM predictions WHERE model <> 'roll7'""")
def predictions_store(v: Views):
    """Predictions of two algorithms, one of them saved a second time: the newest run of each."""
    store, rows = results.ResultsStore(v.spark, _place(v)), v.predictions()
    first = rows.where("model = 'lag1'").drop("model")
    store.save_predictions(first.withColumn("y_pred", F.col("y_pred") + 1), "lag1", "earlier")
    store.save_predictions(first, "lag1", "later")
    store.save_predictions(rows.where("model = 'roll3'").drop("model"), "roll3", "only")
    return store.predictions(["lag1", "roll3"]).select("algorithm", "row_id", "y_true", "y_pred")


@query(f"""WITH {o.TRIALS} SELECT algorithm, COUNT(*) AS n, MIN(VAL_RMSE_orig) AS best, MAX(eval_num) AS last
FROM trials GROUP BY 1""")
def trials_store(v: Views):
    """A trial log appended by algorithm, and what it holds."""
    store = results.ResultsStore(v.spark, _place(v))
    store.save_trials(v.trials().select("algorithm", "eval_num", "VAL_RMSE_orig", "epochs_trained"))
    return store.read("trials").groupBy("algorithm").agg(
        F.count(F.lit(1)).alias("n"), F.min("VAL_RMSE_orig").alias("best"), F.max("eval_num").alias("last"))


@query("""SELECT o_orderkey AS run, 'seq' AS kind, NULL::DOUBLE AS R2, o_totalprice AS val_rmse
FROM orders""")
def report_columns(v: Views):
    """Columns picked by words in their names, missing ones filled, in a fixed order."""
    runs = v.table("orders").selectExpr(
        "o_orderkey AS run", "o_totalprice AS val_rmse", "o_totalprice / 2 AS loss", "o_orderstatus AS state")
    picked = reports.columns_like(runs, ["rmse"], always=["run"])
    full = reports.with_defaults(picked, {"kind": "seq", "R2": None, "val_rmse": 0.0}, ["run"])
    return full.withColumn("R2", F.col("R2").cast("double"))
