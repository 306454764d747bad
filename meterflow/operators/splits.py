"""Splits by position in time and by group, without leakage between parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.constants import (
    GROUP_SPLIT_FRACTIONS, LOOKBACK_ROWS, TRAIN_FRACTION, VALIDATION_WITHIN_TRAIN,
)
from meterflow.operators.series import Layout, Series
from meterflow.session import checkpointed

SPLITS = ("train", "val", "test")


def split_sizes(total: int, option: int = 2, train: float = TRAIN_FRACTION) -> dict[str, int]:
    """Row counts of the parts, in time order, for the household split options.

    0 and 1: look-back rows, train, test. 2: train, test. 3: train, validation, test.
    """
    train_rows = int(train * total)
    if option in (0, 1):
        lookback = min(LOOKBACK_ROWS, train_rows)
        return {"lookback": lookback, "train": train_rows - lookback, "test": total - train_rows}
    if option == 2:
        return {"train": train_rows, "test": total - train_rows}
    if option == 3:
        share = train * VALIDATION_WITHIN_TRAIN
        fit_rows, val_rows = int((train - share) * total), int(share * total)
        return {"train": fit_rows, "val": val_rows, "test": total - fit_rows - val_rows}
    raise ValueError(f"unsupported option {option}")


def group_split_sizes(total: int, fractions: Sequence[float]) -> dict[str, int]:
    """Sample targets of the group split; the last part takes the remainder."""
    first, second = (int(total * f) for f in fractions[:2])
    return dict(zip(SPLITS, (first, second, total - first - second)))


@dataclass(frozen=True)
class Cut:
    """A table labelled with ``split`` by position, and where its parts lie."""

    frame: DataFrame
    layout: Layout
    sizes: Mapping[str, int]

    def place(self, position: Column, split: str = "split") -> Column:
        """Position inside its part of a row at ``position`` in the whole table."""
        start, shift = 0, F.lit(0)
        for part, size in self.sizes.items():
            shift = F.when(F.col(split) == part, F.lit(start)).otherwise(shift)
            start += size
        return position - shift


def cut_positions(
    df: DataFrame,
    order: tuple[str, str],
    sizes: Mapping[str, int] | None = None,
    option: int = 2,
    rows_per_chunk: int | None = None,
) -> Cut:
    """Label rows by their position in the whole table.

    Only the first row of each part is looked up; the label is then a comparison with those
    few literals, so the wide table is neither sorted nor shuffled. Rows after the last
    part are dropped.
    """
    slim = df.select(*dict.fromkeys(order))
    layout = Series((), order, rows_per_chunk).measure(slim)
    wanted = dict(sizes) if sizes is not None else split_sizes(layout.total, option)
    ends, done = {}, 0
    for part, size in wanted.items():
        done = min(done + size, layout.total)
        ends[part] = done
    found = {
        row["_pos"]: row
        for row in layout.rows_at(slim, [end + 1 for end in ends.values()]).collect()
    }
    label = reduce(
        lambda made, part: made.when(_before(df, order, found.get(ends[part] + 1)), F.lit(part)),
        ends, F,
    )
    return Cut(df.withColumn("split", label).where(F.col("split").isNotNull()), layout, wanted)


def cut_by_position(
    df: DataFrame,
    order: tuple[str, str],
    sizes: Mapping[str, int] | None = None,
    option: int = 2,
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """The labelled table of ``cut_positions``."""
    return cut_positions(df, order, sizes, option, rows_per_chunk).frame


def _before(df: DataFrame, order: tuple[str, str], row) -> Column:
    """Strictly before ``row`` in the order; everything is before a missing row."""
    if row is None:
        return F.lit(True)
    primary, tie = order
    # Text keeps zone-less timestamps exact.
    at, tie_at = (
        F.lit(str(row[c])).cast(df.schema[c].dataType) if row[c] is not None else F.lit(None)
        for c in order
    )
    return (F.col(primary) < at) | ((F.col(primary) == at) & (F.col(tie) < tie_at))


def first_rows(
    df: DataFrame, order: tuple[str, str], n: int, rows_per_chunk: int | None = None
) -> DataFrame:
    """The first ``n`` rows in order, without a sort of the table."""
    return cut_by_position(df, order, {"head": n}, rows_per_chunk=rows_per_chunk).drop("split")


def group_counts(df: DataFrame, group: str = "building_id") -> DataFrame:
    """Samples per group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def count_stats(counts: DataFrame) -> DataFrame:
    """Number of groups and the spread of their sizes."""
    return counts.agg(
        F.count(F.lit(1)).alias("groups"), F.min("n").alias("min_n"),
        F.max("n").alias("max_n"), F.avg("n").alias("mean_n"),
    )


def disjoint_split(
    counts: DataFrame,
    targets: Mapping[str, int] | None = None,
    limits: Mapping[str, int] | None = None,
    fractions: Sequence[float] = GROUP_SPLIT_FRACTIONS,
    group: str = "building_id",
    rows_per_chunk: int | None = None,
) -> DataFrame:
    """Give whole groups, largest first, to train, then validation, then test.

    A part takes groups until it holds its target number of samples or its limit of groups.
    Both only grow, so a full part never reopens and the parts are consecutive runs of the
    size-ordered list: prefix sums of sizes say where each run ends. Equal sizes go by
    descending id. Without ``targets`` the parts are ``fractions`` of all samples.
    """
    limits = limits or {}
    # One row per group, read several times below; the readings themselves are read once.
    counts = checkpointed(counts.select(group, "n"))
    if targets is None:
        targets = group_split_sizes(counts.agg(F.sum("n")).first()[0] or 0, fractions)
    ordered = counts.select(
        group, "n", (-F.col("n")).alias("_size"), (-F.col(group)).alias("_id")
    )
    layout = Series((), ("_size", "_id"), rows_per_chunk).measure(ordered)
    ranked = layout.running(ordered, _upto=("sum", F.col("n")), _rank=("sum", F.lit(1)))
    ranked = checkpointed(ranked.select(group, "n", "_upto", "_rank"))
    ends, rank, samples = {}, 0, 0
    for part in SPLITS:
        takes = (F.col("_rank") > rank) & (F.col("_upto") - F.col("n") - samples < targets[part])
        if limits.get(part) is not None:
            takes = takes & (F.col("_rank") - rank <= limits[part])
        last, upto = ranked.where(takes).agg(F.max("_rank"), F.max("_upto")).first()
        rank, samples = (last, upto) if last is not None else (rank, samples)
        ends[part] = rank
    label = reduce(
        lambda made, part: made.when(F.col("_rank") <= ends[part], F.lit(part)), ends, F
    )
    return (
        ranked.withColumn("split", label).where(F.col("split").isNotNull())
        .select(group, "split", "n")
    )


def tag_splits(df: DataFrame, splits: DataFrame, group: str = "building_id") -> DataFrame:
    """Keep the rows of listed groups and label them with their split."""
    return df.join(splits.select(group, "split"), group)


def only_splits(df: DataFrame, *parts: str) -> DataFrame:
    """Rows of the named parts together."""
    return df.where(F.col("split").isin(*parts))
