"""The meter tables as views over the test tables, for Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.functions.calendar import hour_start
from meterflow.operators.series import Layout, Series
from meterflow.operators.windows import lag_features

READING_ORDER = ("timestamp", "event_id")


class Views:
    """Lazily read views of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def readings(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("user_id").alias("building_id"),
            F.col("event_type").alias("meter"),
            F.col("ts").alias("timestamp"),
            F.col("value").alias("meter_reading"),
        )

    def readings_layout(self) -> Layout:
        return Series(["building_id"], READING_ORDER).measure(self.readings())

    def buildings(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("building_id"),
            F.col("c_nationkey").cast("long").alias("site_id"),
            F.col("c_mktsegment").alias("primary_use"),
            F.col("c_acctbal").alias("square_feet"),
        )

    def weather(self) -> DataFrame:
        sites = self.table("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("site_id")
        )
        hour = hour_start(F.col("ts")).alias("timestamp")
        return (
            self.table("events").join(sites, "user_id")
            .groupBy("site_id", hour)
            .agg(
                F.round(F.avg("value"), 6).alias("air_temperature"),
                F.min("value").alias("cloud_coverage"),
                F.max("value").alias("precip_depth_1_hr"),
            )
        )

    def household(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").alias("timestamp"),
            F.col("value").alias("P"),
            (F.col("value") / 460).alias("Q"),
            (F.col("event_id") % 7).cast("double").alias("V"),
            (F.length("props") / F.lit(100)).alias("I"),
        )

    def household_layout(self) -> Layout:
        return Series((), READING_ORDER).measure(self.household())

    def predictions(self) -> DataFrame:
        """Three naive forecasts of every reading with seven predecessors, in long form."""
        lagged = lag_features(
            self.readings(), self.readings_layout(), "meter_reading", length=7
        )
        last3 = (F.col("lag1") + F.col("lag2") + F.col("lag3")) / 3
        guesses = {"lag1": F.col("lag1"), "roll3": last3, "roll7": F.col("roll_mean")}
        pairs = F.array(*[
            F.struct(F.lit(model).alias("model"), F.round(guess, 6).alias("y_pred"))
            for model, guess in guesses.items()
        ])
        return lagged.select(
            F.col("event_id").alias("row_id"),
            F.col("meter_reading").alias("y_true"),
            F.explode(pairs).alias("_guess"),
        ).select("row_id", "_guess.model", "y_true", "_guess.y_pred")

    def trials(self) -> DataFrame:
        """Every order is one trial of the algorithm named by its priority."""
        orders = self.table("orders").select(
            F.col("o_orderpriority").alias("algorithm"),
            F.col("o_orderkey").alias("trial_id"),
            F.col("o_totalprice").alias("VAL_RMSE_orig"),
            (F.col("o_orderkey") % 50 + 1).alias("epochs_trained"),
            F.array(
                F.col("o_orderkey") % 97 / 96, F.col("o_custkey") % 89 / 88,
                F.col("o_orderkey") % 83 / 82, F.col("o_custkey") % 79 / 78,
            ).alias("x"),
        )
        numbered = Series(["algorithm"], ("trial_id", "trial_id")).measure(orders, few=True)
        return numbered.positions(orders, "eval_num")

    def trials_layout(self, trials: DataFrame) -> Layout:
        return Series(["algorithm"], ("eval_num", "eval_num")).measure(trials, few=True)

    def metrics_runs(self) -> DataFrame:
        undated = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
        return self.table("orders").select(
            F.col("o_orderpriority").alias("Model"),
            F.when(~undated, F.col("o_orderdate")).alias("timestamp"),
            F.col("o_totalprice").alias("RMSE"),
            (F.col("o_totalprice") / 2).alias("MAE"),
            "o_orderkey",
        )
