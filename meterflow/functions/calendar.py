"""Calendar features and timestamp parsing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.constants import US_HOLIDAYS


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, without a zone conversion."""
    seconds = (
        F.unix_date(F.to_date(ts)).cast("long") * 86400
        + F.hour(ts).cast("long") * 3600
        + F.minute(ts).cast("long") * 60
    )
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return seconds * 1_000_000 + micros


def hour_start(ts: Column) -> Column:
    """Start of the hour of a zone-less timestamp, without a zone conversion."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(ts))


def calendar_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Minute of hour, hour of day and weekday (Monday = 0) of ``ts``."""
    return df.withColumns(
        {"minute": F.minute(ts), "hour": F.hour(ts), "weekday": F.weekday(ts)}
    )


def holiday_flag(
    df: DataFrame, ts: str = "timestamp", holidays: Iterable[str] = US_HOLIDAYS
) -> DataFrame:
    """``is_holiday``: 1 on the listed dates, else 0."""
    days = [F.lit(day).cast("date") for day in holidays]
    return df.withColumn("is_holiday", F.to_date(F.col(ts)).isin(*days).cast("int"))


def parse_timestamps(df: DataFrame, ts: str = "timestamp", strict: bool = False) -> DataFrame:
    """Parse a text column to a zone-less timestamp.

    Strict parsing raises on bad text; lenient parsing drops the rows it cannot read.
    """
    if ts not in df.columns:
        raise ValueError(f"missing column {ts!r}")
    if strict:
        return df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    return df.withColumn(ts, F.col(ts).try_cast("timestamp_ntz")).where(F.col(ts).isNotNull())
