"""Naive forecast report: how well the previous reading predicts the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions.calendar import calendar_features
from meterflow.operators.joins import join_buildings
from meterflow.operators.metrics import metrics
from meterflow.operators.series import Layout


def naive_forecast_report(readings: DataFrame, buildings: DataFrame, layout: Layout) -> DataFrame:
    """Errors of the previous reading as forecast, by building use and weekday."""

    def build(w, pos):
        return {"y_pred": F.lag("meter_reading").over(w)}

    slim = readings.select("event_id", "building_id", "timestamp", "meter_reading")
    forecast = layout.over(slim, build, preceding=1).where(F.col("y_pred").isNotNull())
    uses = buildings.select("building_id", "primary_use")
    joined = calendar_features(join_buildings(forecast, uses))
    return metrics(joined, ["primary_use", "weekday"], y="meter_reading")
