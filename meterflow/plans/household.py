"""Household preparation: calendar, split in time, scaling, windows inside each part."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.functions.calendar import calendar_features
from meterflow.operators import scaling, splits
from meterflow.operators.windows import sliding_windows

CALENDAR = ("minute", "weekday", "hour")


@dataclass(frozen=True)
class ScaledParts:
    """Scaled features of a household, labelled by part."""

    cut: splits.Cut
    features: Sequence[str]
    stats: scaling.ColumnStats
    ts: str

    def windows(self, length: int, features: Sequence[str] | None = None) -> DataFrame:
        """Windows of every part; none crosses from one part into the next.

        Parts are consecutive, so one pass over the whole series makes all windows, and
        those that start before their part are dropped. ``position`` counts inside the part.
        """
        columns = list(features or self.features)
        made = sliding_windows(self.cut.frame, self.cut.layout, columns, length, self.ts)
        placed = made.withColumn("position", self.cut.place(F.col("position")))
        return placed.where(F.col("position") > length)

    def target_stats(self) -> scaling.ColumnStats:
        """Statistics of the target, which is the first feature, as ``y``."""
        return self.stats.renamed(self.features[0], "y")


@dataclass(frozen=True)
class HouseholdData:
    windows: DataFrame
    parts: ScaledParts

    @property
    def sizes(self) -> Mapping[str, int]:
        return self.parts.cut.sizes


def scaled_parts(
    df: DataFrame,
    option: int = 3,
    measures: Sequence[str] = ("P", "Q", "V"),
    order: tuple[str, str] = ("timestamp", "event_id"),
    fit_on_validation: bool = False,
    rows_per_chunk: int | None = None,
) -> ScaledParts:
    """Measures and calendar columns, labelled by part and scaled from training rows.

    ``fit_on_validation`` also fits the scaler on the validation part.
    """
    features = [*measures, *CALENDAR]
    frame = calendar_features(df, order[0]).select(*dict.fromkeys(order), *features)
    cut = splits.cut_positions(frame, order, option=option, rows_per_chunk=rows_per_chunk)
    fitted = [p for p in cut.sizes if p != "test" and (p != "val" or fit_on_validation)]
    stats = scaling.ColumnStats.fit(splits.only_splits(cut.frame, *fitted), features)
    scaled = splits.Cut(stats.scale(cut.frame), cut.layout, cut.sizes)
    return ScaledParts(scaled, features, stats, order[0])


def household_data(
    df: DataFrame,
    option: int = 3,
    length: int = 7,
    measures: Sequence[str] = ("P", "Q", "V"),
    order: tuple[str, str] = ("timestamp", "event_id"),
    fit_on_validation: bool = False,
    external: DataFrame | None = None,
    rows_per_chunk: int | None = None,
) -> HouseholdData:
    """Windows of the parts of one option.

    Option 0 windows the look-back rows. Option 1 windows the rest and places the forecast
    of ``external`` (columns ``index`` from 0, and ``forecast``) of the same step beside
    each window.
    """
    parts = scaled_parts(df, option, measures, order, fit_on_validation, rows_per_chunk)
    sizes, windows = parts.cut.sizes, parts.windows(length)
    if option in (0, 1):
        wanted = ("lookback",) if option == 0 else ("train", "test")
        windows = splits.only_splits(windows, *wanted)
    if option == 1:
        if external is None or sizes["train"] <= 0:
            raise ValueError("option 1 needs training rows and an external forecast")
        # The series starts with the training part; the test part follows one step early.
        place = F.when(F.col("split") == "train", F.col("position") - 1)
        place = place.otherwise(F.col("position") + sizes["train"] - 2)
        windows = (
            windows.withColumn("_index", place)
            .join(external.withColumnRenamed("index", "_index"), "_index").drop("_index")
        )
    return HouseholdData(windows, parts)
