"""Table scans with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meterflow import schema
from meterflow.functions.calendar import parse_timestamps


def read_csv_folder(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """Every CSV file of a folder as one table; a missing or empty folder is an error."""
    try:
        df = spark.read.csv(
            path, schema=columns, header=True, pathGlobFilter="*.csv", enforceSchema=False
        )
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"input folder does not exist: {path}") from problem
        raise
    if not df.inputFiles():
        raise FileNotFoundError(f"no CSV files in {path}")
    return df


def read_household(
    spark: SparkSession, path: str, columns: T.StructType = schema.HOUSEHOLD
) -> DataFrame:
    """Raw meter files; rows whose timestamp cannot be read are dropped."""
    if "timestamp" not in columns.names:
        raise ValueError("missing column 'timestamp'")
    return parse_timestamps(read_csv_folder(spark, path, columns))


def read_resampled(
    spark: SparkSession, path: str, measures: Sequence[str] = ("P", "Q", "V")
) -> DataFrame:
    """A resampled table: its timestamp and the named measures."""
    return read_household(spark, path).select("timestamp", *measures)


def read_star(spark: SparkSession, path: str, meter: int | None = 0) -> dict[str, DataFrame]:
    """Readings, buildings and weather of a folder of CSV files.

    The filter on the meter reaches the scan. Test-period files are not read: nothing uses them.
    """
    def table(name: str, columns: T.StructType) -> DataFrame:
        return spark.read.csv(f"{path}/{name}.csv", header=True, schema=columns, enforceSchema=False)

    readings = table("train", schema.READINGS)
    return {
        "readings": readings if meter is None else readings.where(readings.meter == meter),
        "buildings": table("building_metadata", schema.BUILDINGS),
        "weather": table("weather_train", schema.WEATHER),
    }
