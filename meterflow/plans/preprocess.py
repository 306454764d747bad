"""Multi-building preparation: split, join, features, imputation, scaling in one pass.

All parts travel in one frame tagged with ``split``, so readings are scanned and joined
once and every part has the same columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.constants import DROPPED_COLUMNS, GROUP_SPLIT_FRACTIONS
from meterflow.functions.calendar import holiday_flag
from meterflow.operators import joins, scaling, splits


@dataclass(frozen=True)
class Prepared:
    """A frame with ``split``, ``y``, the identifying columns and the feature columns."""

    frame: DataFrame
    numeric: Sequence[str]
    dummies: Sequence[str]
    stats: scaling.ColumnStats | None = None

    @property
    def features(self) -> list[str]:
        return sorted([*self.numeric, *self.dummies])


def assign_splits(
    readings: DataFrame,
    fractions: Sequence[float] = GROUP_SPLIT_FRACTIONS,
    target_samples: int | None = None,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Disjoint building splits; by default the sample targets cover all readings."""
    targets = target_samples and splits.group_split_sizes(target_samples, fractions)
    return splits.disjoint_split(splits.group_counts(readings), targets or None, limits, fractions)


def prepare(
    readings: DataFrame,
    buildings: DataFrame,
    weather: DataFrame,
    split_ids: DataFrame,
    ids: Sequence[str] = ("event_id", "building_id", "timestamp"),
    hourly_weather: bool = False,
    check_weather: bool = True,
    include_group_id: bool = False,
    uses: Sequence[str] | None = None,
) -> Prepared:
    """Tagged readings with building, weather, calendar and one-hot features.

    ``uses`` are the building uses that get a column, by default those of split buildings.

    The target stays on its row through the joins; a repeated weather key would multiply
    rows, so it is refused.
    """
    if check_weather:
        joins.require_unique(weather, ["site_id", "timestamp"])
    if uses is None:
        uses = scaling.categories(joins.members_of(buildings, split_ids), "primary_use")
    kept = [c for c in weather.columns if c not in DROPPED_COLUMNS or c == "timestamp"]
    tagged = splits.tag_splits(readings, split_ids).withColumn("y", F.col("meter_reading"))
    joined = joins.join_weather(
        joins.join_buildings(tagged, buildings), weather.select(*kept), hourly_weather
    )
    frame = joined.withColumns({"hour": F.hour("timestamp"), "weekday": F.weekday("timestamp")})
    frame = holiday_flag(frame)
    frame = scaling.one_hot(frame, "primary_use", uses)
    frame = frame.drop(*[c for c in DROPPED_COLUMNS if c not in ids])
    dummies = [f"primary_use_{use}" for use in uses]
    if include_group_id:
        frame = frame.withColumn("group_id", F.col("building_id").cast("double"))
        dummies.append("group_id")
    numeric = [c for c in frame.columns if c not in {*ids, "split", "y", *dummies}]
    return Prepared(frame, numeric, dummies)


def finish(prepared: Prepared) -> Prepared:
    """Impute and scale features and target with statistics of the training part."""
    columns = [*prepared.numeric, "y"]
    stats = scaling.ColumnStats.fit(splits.only_splits(prepared.frame, "train"), columns)
    frame = stats.scale(stats.impute(prepared.frame))
    return Prepared(frame, prepared.numeric, prepared.dummies, stats)
