"""Feature frames for forecast models: columns ``split``, ``y`` and a feature vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.operators import windows
from meterflow.operators.models import assembled, window_vector
from meterflow.operators.series import Layout
from meterflow.plans.preprocess import Prepared

LAGS = ("lag1", "lag2", "lag3", "roll_mean", "roll_std")


def current_frame(done: Prepared) -> DataFrame:
    """Features of the predicted row itself."""
    return assembled(done.frame, done.features)


def lag_frame(done: Prepared, layout: Layout, length: int = 7) -> DataFrame:
    """Features of the previous row, lags and rolling statistics of the target."""
    lagged = windows.lag_features(done.frame, layout, "y", length, last_step=done.features)
    return assembled(lagged, [*LAGS, *(f"last_{c}" for c in done.features)])


def window_frame(made: DataFrame) -> DataFrame:
    """Whole windows as flat vectors."""
    flat = made.withColumn("_flat", windows.flat())
    return flat.select(
        "split", F.get("y", F.lit(0)).alias("y"), window_vector("_flat").alias("features")
    )
