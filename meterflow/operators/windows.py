"""Lag features, rolling statistics and sliding windows over ordered series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from meterflow.operators.series import Layout


def lag_features(
    df: DataFrame, layout: Layout, value: str, length: int = 7, last_step: Sequence[str] = ()
) -> DataFrame:
    """Lags 1 to 3, mean and population deviation of the ``length`` previous values, and the
    previous row's ``last_step`` columns. Rows without ``length`` predecessors are dropped.

    A window shorter than three repeats its oldest value as the missing lags.
    """

    def build(w: WindowSpec, pos: Column) -> dict[str, Column]:
        frame = w.rowsBetween(-length, -1)
        lags = {f"lag{k}": F.lag(value, min(k, length)).over(w) for k in (1, 2, 3)}
        last = {f"last_{c}": F.lag(c, 1).over(w) for c in last_step}
        return {
            **lags,
            "roll_mean": F.avg(value).over(frame),
            "roll_std": F.stddev_pop(value).over(frame),
            **last,
            "_full": pos > length,
        }

    return layout.over(df, build, preceding=length).where("_full").drop("_full")


def moving_average(df: DataFrame, layout: Layout, value: str, width: int) -> DataFrame:
    """Mean of the current and the ``width - 1`` previous values."""

    def build(w: WindowSpec, pos: Column) -> dict[str, Column]:
        return {"moving_average": F.avg(value).over(w.rowsBetween(1 - width, 0))}

    return layout.over(df, build, preceding=width)


def sliding_windows(
    df: DataFrame,
    layout: Layout,
    features: Sequence[str],
    length: int,
    ts: str,
    horizon: int = 1,
) -> DataFrame:
    """A window of the ``length`` previous rows for every target row.

    ``x`` holds one array of ``features`` per step, ``y`` the next ``horizon`` values of the
    first feature, ``window_start`` and ``ts`` the times of first step and target,
    ``position`` the target's place in its series. Windows that would leave the series are
    dropped.
    """
    step = F.array(*[F.col(c).cast("double") for c in features])

    def build(w: WindowSpec, pos: Column) -> dict[str, Column]:
        target = F.col(features[0]).cast("double")
        return {
            "x": F.collect_list(step).over(w.rowsBetween(-length, -1)),
            # structs, as a list of values would leave out nulls
            "_y": F.collect_list(F.struct(target.alias("v"))).over(w.rowsBetween(0, horizon - 1)),
            "window_start": F.lag(ts, length).over(w),
            "position": pos.cast("long"),
        }

    out = layout.over(df, build, preceding=length, following=horizon - 1)
    full = out.where((F.col("position") > length) & (F.size("_y") == horizon))
    places = {c: F.col("_y.v") if c == "y" else F.col(c) for c in [*df.columns, "x", "y", "window_start", "position"]}
    return full.select(*(column.alias(name) for name, column in places.items()))


def flat(window: str = "x") -> Column:
    """A window as one flat array, step by step."""
    return F.flatten(F.col(window))


def first_features(window: Column, n: int) -> Column:
    """The first ``n`` features of every step of a window."""
    return F.transform(window, lambda step: F.slice(step, 1, n))


def unfold(column: Column, size: int, prefix: str) -> list[Column]:
    """The elements of an array as columns ``prefix1`` .. ``prefixN``."""
    return [F.get(column, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(size)]
