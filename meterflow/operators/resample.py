"""Time buckets: mean and max per interval, several jobs from one scan."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_SECONDS = 86_400
# Interval units and their seconds.
UNIT_SECONDS = {"s": 1, "min": 60, "T": 60, "h": 3600, "H": 3600, "D": DAY_SECONDS}


@dataclass(frozen=True)
class ResampleJob:
    """One output table: an interval such as ``1s``, ``5T``, ``1h`` and ``mean`` or ``max``."""

    interval: str
    aggregation: str = "mean"

    def __post_init__(self) -> None:
        if self.aggregation not in _AGGREGATES:
            raise ValueError(f"unsupported aggregation {self.aggregation!r}")

    @property
    def seconds(self) -> int:
        match = re.fullmatch(r"(\d*)(s|min|T|h|H|D)", self.interval)
        if not match:
            raise ValueError(f"unsupported interval {self.interval!r}")
        return int(match[1] or 1) * UNIT_SECONDS[match[2]]

    @property
    def table_name(self) -> str:
        return f"{self.interval}_{self.aggregation}"


_AGGREGATES = {"mean": F.avg, "max": F.max}


def make_jobs(intervals: Iterable[str], include_max: bool = False) -> list[ResampleJob]:
    """A mean job per interval, and a max job as well on request."""
    kinds = ("mean", "max") if include_max else ("mean",)
    return [ResampleJob(interval, kind) for interval in intervals for kind in kinds]


def _origins(df: DataFrame, widths: Iterable[int], ts: str) -> dict[int, int]:
    """Second from which the buckets of each width count: midnight of the first day."""
    uneven = [w for w in widths if DAY_SECONDS % w]
    first = (df.agg(F.unix_date(F.to_date(F.min(ts)))).first()[0] or 0) if uneven else 0
    return {w: first * DAY_SECONDS % w if w in uneven else 0 for w in widths}


def _start(ts: str, width: int, origin: int) -> Column:
    """Start of the bucket of a row."""
    return F.window(ts, f"{width} seconds", startTime=f"{origin} seconds").getField("start")


def resample(
    df: DataFrame,
    job: ResampleJob,
    measures: Sequence[str],
    ts: str = "timestamp",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Aggregate ``measures`` per bucket; buckets with a missing measure are dropped."""
    aggregate, width = _AGGREGATES[job.aggregation], job.seconds
    origin = _origins(df, [width], ts)[width]
    return (
        df.groupBy(*keys, _start(ts, width, origin).alias(ts))
        .agg(*[aggregate(m).alias(m) for m in measures])
        .na.drop("any", subset=list(measures))
    )


PARTS = ("_sum", "_rest", "_n", "_max")


def _partials(df: DataFrame, measures: Sequence[str]) -> tuple[list[Column], list[Column]]:
    """Sum, count and maximum of each measure over rows, and over such partial results.

    A double is added up in two parts, its leading 24 bits and the rest. Such sums carry no
    rounding, so a mean does not depend on the buckets it was merged from.
    """
    rows, merged = [], []
    for m in measures:
        value, rest = F.col(m), F.lit(0.0)
        if not isinstance(df.schema[m].dataType, T.DecimalType):
            value = value.cast("double")
            lead, plain = value.cast("float").cast("double"), F.abs(value) < 1e38
            rest = F.when(plain, value - lead).otherwise(0.0)
            value = F.when(plain, lead).otherwise(value)
        rows += [f(c).alias(f"{name}_{m}") for name, f, c in zip(
            PARTS, (F.sum, F.sum, F.count, F.max), (value, rest, m, m))]
        merged += [f(f"{name}_{m}").alias(f"{name}_{m}") for name, f in zip(PARTS, (F.sum, F.sum, F.sum, F.max))]
    return rows, merged


def _mean(df: DataFrame, measure: str) -> Column:
    total = F.col(f"_sum_{measure}")
    if not isinstance(df.schema[measure].dataType, T.DecimalType):
        total = total + F.col(f"_rest_{measure}")
    return F.try_divide(total, F.col(f"_n_{measure}"))


def resample_all(
    df: DataFrame, jobs: Sequence[ResampleJob], measures: Sequence[str], ts: str = "timestamp",
    keys: Sequence[str] = (),
) -> DataFrame:
    """All jobs from one scan, told apart by ``interval`` and ``aggregation``.

    Buckets form a lattice: every width is a multiple of their greatest common divisor and starts
    where one of its buckets does. So rows are aggregated once, into partial results (sum, count and
    maximum) of buckets of that width, and all wider buckets are merged from these. No row is copied
    for a job; what is shuffled a second time are partial results, one per narrow bucket and width, folded
    before they leave their task. Mean and maximum of a bucket come from the same partial result.
    """
    widths = sorted({job.seconds for job in jobs})
    unit = math.gcd(*widths)
    origins = _origins(df, [*widths, unit], ts)
    rows, merged = _partials(df, measures)
    partial = [f"{name}_{m}" for m in measures for name in PARTS]
    fine = df.groupBy(*keys, _start(ts, unit, origins[unit]).alias(ts)).agg(*rows)
    # ``window`` is planned once per projection, so the bucket columns are added one by one.
    for width in widths:
        fine = fine.withColumn(f"_b{width}", _start(ts, width, origins[width]))
    starts = [F.struct(F.lit(w).alias("_width"), F.col(f"_b{w}").alias(ts)) for w in widths]
    dealt = fine.select(*keys, F.explode(F.array(*starts)).alias("_at"), *partial)
    both = dealt.groupBy(*keys, "_at._width", f"_at.{ts}").agg(*merged)
    shown = F.array(*[
        F.struct(
            F.lit(job.seconds).alias("width"), F.lit(job.interval).alias("interval"),
            F.lit(job.aggregation).alias("aggregation"),
            *[(F.col(f"_max_{m}") if job.aggregation == "max" else _mean(df, m)).cast(_kind(df, jobs, m)).alias(m)
              for m in measures])
        for job in jobs])
    out = both.select(*keys, ts, "_width", F.explode(shown).alias("_job")).where("_job.width = _width")
    return out.select(
        "_job.interval", "_job.aggregation", *keys, ts, *[F.col(f"_job.{m}").alias(m) for m in measures],
    ).na.drop("any", subset=list(measures))


def _kind(df: DataFrame, jobs: Sequence[ResampleJob], measure: str) -> T.DataType:
    """Type of a measure in the results of all jobs: its own if all of them are maxima."""
    kind = df.schema[measure].dataType
    if all(job.aggregation == "max" for job in jobs):
        return kind
    if isinstance(kind, T.DecimalType):  # as an average of decimals has
        return T.DecimalType(min(38, kind.precision + 4), min(38, kind.scale + 4))
    return T.DoubleType()
