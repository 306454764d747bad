"""Column expressions: units, bounds, parameter decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.constants import (
    CURRENT_SCALE, LAYERS_RANGE, LEARNING_RATE_RANGE, SEQUENCE_RANGE, UNITS_RANGE, VOLTAGE_SCALE,
)


def rescale_units(df: DataFrame) -> DataFrame:
    """Normalised household measures to watt, var, volt and ampere."""
    power = VOLTAGE_SCALE * CURRENT_SCALE
    factors = {"P": power, "Q": power, "V": VOLTAGE_SCALE, "I": CURRENT_SCALE}
    return df.withColumns({c: F.col(c) * f for c, f in factors.items() if c in df.columns})


def day_slice(df: DataFrame, day: str, ts: str = "timestamp") -> DataFrame:
    """Rows of one calendar day."""
    start = F.lit(day).cast("timestamp_ntz")
    return df.where((F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL 1 DAY")))


def numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to numbers; unreadable text becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def bounded(value: Column, low: float, high: float, mode: str = "clip", seed: int = 42) -> Column:
    """Bring an out-of-range value back inside ``[low, high]``.

    ``clip`` to the nearer bound, ``swap`` to the opposite bound, ``mirror`` the overshoot
    and clamp it, ``wrap`` by the remainder, ``redraw`` at random.
    """
    below, above, span = value < low, value > high, high - low
    if mode == "clip":
        return F.least(F.greatest(value, F.lit(low)), F.lit(high))
    if mode == "swap":
        return F.when(below, F.lit(high)).when(above, F.lit(low)).otherwise(value)
    if mode == "mirror":
        return (
            F.when(below, F.least(F.lit(high), 2 * low - value))
            .when(above, F.greatest(F.lit(low), 2 * high - value))
            .otherwise(value)
        )
    if mode == "wrap":
        return F.when(below | above, low + F.pmod(value, F.lit(span))).otherwise(value)
    if mode == "redraw":
        return F.when(below | above, low + F.rand(seed) * span).otherwise(value)
    raise ValueError(f"unknown mode {mode!r}")


def decode_params(vector: Column) -> dict[str, Column]:
    """Forecaster parameters from a vector of four numbers in [0, 1]."""

    def whole(i: int, bounds: tuple[int, int]) -> Column:
        low, high = bounds
        raw = (low + F.get(vector, F.lit(i)) * (high - low)).cast("int")
        return F.greatest(F.lit(low), F.least(raw, F.lit(high)))

    slow, fast = LEARNING_RATE_RANGE
    return {
        "units": whole(0, UNITS_RANGE),
        "num_layers": whole(1, LAYERS_RANGE),
        "seq": whole(2, SEQUENCE_RANGE),
        "learning_rate": slow + F.get(vector, F.lit(3)) * (fast - slow),
    }


def logistic_map(start: Column, steps: int, eta: float = 0.4) -> Column:
    """The chaotic sequence ``x -> eta x (1 - x)`` as an array of ``steps`` values."""
    def grow(seen: Column, _: Column) -> Column:
        last = F.element_at(seen, -1)
        return F.concat(seen, F.array(eta * last * (1 - last)))

    if steps <= 1:
        return F.array(start)
    return F.aggregate(F.sequence(F.lit(2), F.lit(steps)), F.array(start), grow)
