"""Joins. No broadcast hints: Spark broadcasts a side by its measured size and splits
skewed partitions at run time, so a large dimension or a hot key stays safe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.functions.calendar import hour_start
from meterflow.operators.series import Layout


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key repeats; a repeated weather hour would multiply readings."""
    repeated = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"keys {list(keys)} are not unique: {repeated[0].asDict()}")
    return df


def join_buildings(readings: DataFrame, buildings: DataFrame) -> DataFrame:
    """Add building attributes; readings without a building keep nulls."""
    return readings.join(buildings, "building_id", "left")


def join_weather(readings: DataFrame, weather: DataFrame, hourly: bool = False) -> DataFrame:
    """Add weather of the site at the reading's timestamp, or at its hour if ``hourly``."""
    if not hourly:
        return readings.join(weather, ["site_id", "timestamp"], "left")
    hours = weather.withColumnRenamed("timestamp", "_hour")
    keyed = readings.withColumn("_hour", hour_start(F.col("timestamp")))
    return keyed.join(hours, ["site_id", "_hour"], "left").drop("_hour")


def members_of(df: DataFrame, ids: DataFrame, key: str = "building_id") -> DataFrame:
    """Rows whose key is listed (semi join)."""
    return df.join(ids.select(key), key, "left_semi")


def positional_join(
    left: DataFrame, left_layout: Layout, right: DataFrame, right_layout: Layout, offset: int = 0
) -> DataFrame:
    """Pair row ``i`` of ``left`` with row ``i + offset`` of ``right``, both in series order.

    The runs of the left table are the tasks; each gets the slice of the right table that has its
    places, by bins whose first place is known, so every row is shuffled once (rows of a bin on a
    border twice). Inside a run both sides are numbered and a row meets the one that sorts next to
    it; nothing is joined on a row number. Both tables are single series. Columns of the left table
    come first; names that both have appear twice.
    """
    ranges = left_layout.ranges()
    sides = (
        (left, left_layout, ranges, 0, "_l"),
        (right, right_layout, [(n, lo + offset, hi + offset) for n, lo, hi in ranges], offset, "_r"),
    )
    frames = []
    for i, (table, layout, slices, shift, name) in enumerate(sides):
        order = [F.col(c).alias(f"{name}{k}") for k, c in enumerate(layout.series.order)]
        own = table.select(F.struct(*table.columns).alias(name), *order)
        # the layout finds its order columns under their names, the rest travels in one struct
        keyed = own.withColumnsRenamed({f"{name}{k}": c for k, c in enumerate(dict.fromkeys(layout.series.order))})
        dealt = layout.dealt(keyed, slices)
        frames.append(dealt.select(
            name, "_run", (F.col("_before") - shift).alias("_before"), F.lit(i).alias("_side"),
            *(F.col(c).alias(f"{name}{k}") for k, c in enumerate(layout.series.order))))
    both = frames[0].unionByName(frames[1], allowMissingColumns=True).repartition("_run")
    inside = Window.partitionBy("_run", "_side").orderBy("_l0", "_l1", "_r0", "_r1")
    both = both.withColumn("_at", F.col("_before") + F.row_number().over(inside)).select("_run", "_side", "_at", "_l", "_r")
    along = Window.partitionBy("_run").orderBy("_at", "_side")
    paired = both.withColumns({"_l": F.lag("_l").over(along), "_same": F.lag("_at").over(along) == F.col("_at")})
    return paired.where("_same AND _side = 1").select("_l.*", "_r.*")


def vector_distances(
    pairs: DataFrame, vectors: DataFrame, key: str, vector: str,
    left: str = "left_id", right: str = "right_id",
) -> DataFrame:
    """Euclidean distance of each listed pair of vectors."""
    us = vectors.select(F.col(key).alias(left), F.col(vector).alias("_u"))
    vs = vectors.select(F.col(key).alias(right), F.col(vector).alias("_v"))
    gaps = F.zip_with("_u", "_v", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap))
    return (
        pairs.join(us, left).join(vs, right)
        .withColumn("distance", distance).drop("_u", "_v")
    )


def param_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """Trial table: one row per combination of the listed parameter values."""
    grid, done = spark.range(1), []
    for name, values in axes.items():
        # dealt out by what is there before it grows again, so that no task makes the whole product
        grid = (grid.repartition(*done) if done else grid).withColumn(
            name, F.explode(F.array(*[F.lit(v) for v in values])))
        done.append(name)
    return grid.drop("id")
