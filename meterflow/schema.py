"""Declared schemas of the input and result tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, INT, DOUBLE, TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
TIME = T.TimestampNTZType()

READINGS = _struct(building_id=LONG, meter=INT, timestamp=TIME, meter_reading=DOUBLE)

BUILDINGS = _struct(
    site_id=LONG, building_id=LONG, primary_use=TEXT, square_feet=DOUBLE,
    year_built=DOUBLE, floor_count=DOUBLE,
)

WEATHER = _struct(
    site_id=LONG, timestamp=TIME, air_temperature=DOUBLE, cloud_coverage=DOUBLE,
    dew_temperature=DOUBLE, precip_depth_1_hr=DOUBLE, sea_level_pressure=DOUBLE,
    wind_direction=DOUBLE, wind_speed=DOUBLE,
)

HOUSEHOLD = _struct(timestamp=TEXT, P=DOUBLE, Q=DOUBLE, V=DOUBLE, I=DOUBLE)

SPLITS = _struct(**{name: T.ArrayType(LONG) for name in ("train", "val", "test")})

TRIALS = _struct(
    algorithm=TEXT, timestamp=TIME, eval_num=LONG, units=INT, num_layers=INT, seq=INT,
    learning_rate=DOUBLE, VAL_MSE_scaled=DOUBLE, VAL_RMSE_scaled=DOUBLE,
    VAL_MAE_scaled=DOUBLE, VAL_MAPE_scaled=DOUBLE, VAL_R2_scaled=DOUBLE,
    VAL_RMSE_orig=DOUBLE, VAL_MAE_orig=DOUBLE, VAL_MAPE_orig=DOUBLE,
    VAL_R2_orig=DOUBLE, epochs_trained=INT,
)

PREDICTIONS = _struct(
    algorithm=TEXT, model_name=TEXT, run_ts=TIME, row_id=LONG, y_true=DOUBLE, y_pred=DOUBLE,
)
