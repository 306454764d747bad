"""Statistics fitted on training rows and applied to every row.

A fit is one aggregation that returns one row; a transform is a projection, so it fuses
with the surrounding stage and needs no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterflow.session import stored


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn NaN into null, so that aggregates skip it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


@dataclass(frozen=True)
class ColumnStats:
    """Mean, minimum and maximum of training columns; an all-null column counts as 0."""

    mean: Mapping[str, float]
    low: Mapping[str, float]
    high: Mapping[str, float]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> "ColumnStats":
        """One pass for imputation and scaling: filling gaps with the mean moves neither
        the minimum nor the maximum."""
        aggregates = [
            kind(F.col(c).cast("double")).alias(f"{label}_{i}")
            for i, c in enumerate(columns)
            for label, kind in (("mean", F.avg), ("low", F.min), ("high", F.max))
        ]
        row = train.agg(*aggregates).first()

        def pick(label: str) -> dict[str, float]:
            values = (row[f"{label}_{i}"] for i in range(len(columns)))
            return {c: 0.0 if v is None else v for c, v in zip(columns, values)}

        return cls(pick("mean"), pick("low"), pick("high"))

    def impute(self, df: DataFrame) -> DataFrame:
        """Fill gaps with the training mean."""
        return df.withColumns(
            {c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.mean.items()}
        )

    def scaled(self, column: str, to: tuple[float, float] = (0.0, 1.0)) -> Column:
        """Min-max scaled value; a constant column divides by 1 and nothing is clipped."""
        low, span = self.low[column], self._span(column)
        unit = (F.col(column) - F.lit(low)) / F.lit(span)
        return unit * (to[1] - to[0]) + to[0] if to != (0.0, 1.0) else unit

    def scale(self, df: DataFrame, to: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
        return df.withColumns({c: self.scaled(c, to) for c in self.low})

    def restored(self, column: str, value: Column | None = None) -> Column:
        """Back from the unit range to the scale of ``column``."""
        value = F.col(column) if value is None else value
        return value * F.lit(self.high[column] - self.low[column]) + F.lit(self.low[column])

    def renamed(self, column: str, name: str) -> "ColumnStats":
        """The statistics of one column under another name."""
        return ColumnStats(*[{name: part[column]} for part in (self.mean, self.low, self.high)])

    def _span(self, column: str) -> float:
        return (self.high[column] - self.low[column]) or 1.0


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a category, to become the names of columns.

    A column per value is a plan per value; ``sparse_one_hot`` takes any number of them.
    """
    rows = df.select(column).where(F.col(column).isNotNull()).distinct()
    return sorted(row[0] for row in rows.collect())


def one_hot(df: DataFrame, column: str, values: Sequence, keep: bool = False) -> DataFrame:
    """A 0/1 column per category value; a null category gives zeros."""
    out = df.withColumns({
        f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("double"), F.lit(0.0))
        for v in values
    })
    return out if keep else out.drop(column)


def value_positions(train: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The distinct values of ``column`` in ascending order with ``position`` from 0, and their number.

    A table like any other: values are dealt to ranges, numbered inside them, and the sizes of the
    ranges say where each begins. No list of values reaches the driver. Nulls have no position.
    """
    values = train.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = stored(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    numbered = ranged.join(F.broadcast(starts), "_part").select(
        column, (F.col("_start") + inside - 1).alias("position"))
    return numbered, ranged.count()


def positioned(train: DataFrame, df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``df`` with ``position``, where the value of ``column`` stands among those of ``train``, and the
    number of these; null and unseen values have none."""
    positions, size = value_positions(train, column)
    return df.join(positions, column, "left"), size


def sparse_one_hot(train: DataFrame, df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with a sparse 0/1 vector over the values that ``column`` has in ``train``.

    Null and unseen values give a vector of zeros. Any number of values will do.
    """
    found, size = positioned(train, df, column)
    found = found.withColumn("_index", F.coalesce("position", F.lit(size)).cast("double")).drop("position")
    # one index more than there are values stands for none of them, and has no place in the vector
    last = df.sparkSession.range(1).select(F.lit(float(size)).alias("_index"))
    encoder = OneHotEncoder(inputCol="_index", outputCol=name, dropLast=True).fit(last)
    return encoder.transform(found).select(*df.columns, name)


def align_columns(frames: Sequence[DataFrame], fill: float = 0.0) -> DataFrame:
    """Union of frames with different columns, gaps set to ``fill``, columns in name order."""
    names = {name for frame in frames for name in frame.columns}
    numeric = {
        name for frame in frames for name, kind in frame.dtypes if kind in ("double", "bigint", "int")
    }
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.na.fill(fill, subset=sorted(numeric)).select(*sorted(names))
