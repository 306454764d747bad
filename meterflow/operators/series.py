"""Ordered series of any length: positions, sliding frames, running aggregates.

``Window.partitionBy(key)`` puts every row of a series into one task, which stalls a
cluster as soon as one series holds a large share of the table (a single household meter
holds all of it). ``Series.measure`` therefore counts rows per series first. When every
series fits a task, plain windows run with one shuffle. When some do not, only those are
cut, into bins: equal-width ranges of the order column, cut again wherever a range is
still too full, and by the tie-break column where all times are equal. Neighbouring bins
are merged into runs of about one chunk, and each run is one window partition. Bounds come
from exact counts, minima and maxima, so a re-run after a lost executor assigns every row
to the same run.

Order columns are a measure or time followed by a unique integer; neither may be null.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.functions.calendar import epoch_micros
from meterflow.session import small_table

# A chunk is a partition's share of the table, within these bounds.
MOST_ROWS_PER_CHUNK = 2_000_000
LEAST_ROWS_PER_CHUNK = 100_000
# Bounds every list the driver holds and every table broadcast here, whatever the input size.
MAX_CHUNKS = 20_000
MAX_FETCHED = 10_000
BINS_PER_CHUNK = 4
MAX_BINS = 4096

Build = Callable[[WindowSpec, Column], dict[str, Column]]


@dataclass(frozen=True)
class Series:
    """What makes a series: its key columns and its order (ascending, tie-break last)."""

    keys: Sequence[str]
    order: tuple[str, str]
    rows_per_chunk: int | None = None

    def measure(self, df: DataFrame, few: bool = False) -> "Layout":
        """Count the series of ``df`` and cut those too long for one task.

        ``few`` says that the series are few by nature, such as models: their counts are then
        fetched at once and kept as ``sizes``. More than ``MAX_FETCHED`` are counted as usual.
        """
        undated = F.count_if(F.col("_axis").isNull() | F.col("_tie").isNull())
        counts = self.with_axes(df).groupBy(*self.keys).agg(*_extent(), undated.alias("nulls"))
        fetched = None
        if few or not self.keys:
            fetched = counts.limit(MAX_FETCHED + 1).collect()
            if len(fetched) > MAX_FETCHED:
                fetched = None
        if fetched is None:
            total, longest, nulls = counts.agg(F.sum("n"), F.max("n"), F.sum("nulls")).first()
        else:
            total, nulls = (sum(row[c] for row in fetched) for c in ("n", "nulls"))
            longest = max((row.n for row in fetched), default=0)
        if nulls:
            raise ValueError(f"order columns {self.order} hold {nulls} nulls")
        chunk = max(self.rows_per_chunk or _share(df.sparkSession, total or 0), (total or 0) // MAX_CHUNKS)
        layout = Layout(self, total or 0, chunk)
        if fetched is not None:
            fields = [df.schema[k] for k in self.keys] + _longs("n").fields
            rows = [(*[row[k] for k in self.keys], row.n) for row in fetched]
            layout.sizes = small_table(df.sparkSession, rows, T.StructType(fields))
        if (longest or 0) > chunk:
            # No more than total / chunk series can be longer than a chunk.
            found = counts.where(F.col("n") > chunk).collect() if fetched is None else fetched
            layout.cut(df, [row for row in found if row.n > chunk])
        return layout

    def with_axes(self, df: DataFrame) -> DataFrame:
        """Add the order columns as numbers: ``_axis`` and ``_tie``."""
        primary, tie = self.order
        kind = df.schema[primary].dataType
        if isinstance(kind, T.TimestampNTZType):
            axis = epoch_micros(F.col(primary))
        elif isinstance(kind, T.TimestampType):
            axis = F.unix_micros(primary)
        elif isinstance(kind, T.DateType):
            axis = F.unix_date(primary)
        else:
            axis = F.col(primary)
        return df.withColumns({"_axis": axis, "_tie": F.col(tie)})


def _share(spark: SparkSession, rows: int) -> int:
    share = rows // int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_ROWS_PER_CHUNK, max(LEAST_ROWS_PER_CHUNK, share))


def _finite(axis: str = "_axis") -> Column:
    """Null for NaN and the infinities, which have bins of their own at the ends."""
    value = F.col(axis)
    return F.when(F.abs(value.cast("double")) < float("inf"), value)


def _extent() -> list[Column]:
    value = F.col("_axis").cast("double")
    return [
        F.count(F.lit(1)).alias("n"),
        F.min(_finite()).alias("lo"), F.max(_finite()).alias("hi"),
        F.count_if(value == float("-inf")).alias("below"), F.count_if(value == float("inf")).alias("above"),
        F.count_if(F.isnan(value)).alias("nans"),
        F.min("_tie").alias("tie_lo"), F.max("_tie").alias("tie_hi"),
    ]


@dataclass(frozen=True)
class Bin:
    """A slice of one long series; ``path`` sorts the slices of a series in order."""

    root: int
    path: tuple[int, ...]
    extent: Row

    def division(self, chunk: int) -> tuple[bool, float, float, int] | None:
        """Axis (True = tie-break), lower end, width and number of equal parts.

        By the order column, three more bins take -infinity, infinity and NaN. Each division
        parts rows that differ, so every round makes progress.
        """
        rows = self.extent
        parts = min(MAX_BINS, max(2, math.ceil(BINS_PER_CHUNK * rows.n / chunk)))
        finite = rows.n - rows.below - rows.above - rows.nans
        lo, hi = (float(rows.lo), float(rows.hi)) if finite else (0.0, 0.0)
        if hi > lo:
            return False, lo, min(hi - lo, sys.float_info.max), parts
        if sum(n > 0 for n in (finite, rows.below, rows.above, rows.nans)) > 1:
            return False, lo, 1.0, parts
        lo, hi = float(rows.tie_lo), float(rows.tie_hi)
        return (True, lo, hi - lo, parts) if hi > lo else None


@dataclass(frozen=True)
class Run:
    """Neighbouring bins of one series: rows ``start`` (exclusive) to ``end`` by position."""

    id: int
    root: int
    start: int
    end: int
    bins: tuple[tuple[int, int], ...]

    def spans(self) -> list[tuple[int, int, int]]:
        """Bins with the number of rows before them in the series and inside them."""
        starts = accumulate((n for _, n in self.bins), initial=self.start)
        return [(bin_id, start, n) for (bin_id, n), start in zip(self.bins, starts)]

    def edge(self, rows: int, last: bool) -> list[int]:
        """Bins that hold the last (or first) ``rows`` rows."""
        found, covered = [], 0
        for bin_id, n in reversed(self.bins) if last else self.bins:
            if covered >= rows:
                break
            found.append(bin_id)
            covered += n
        return found


@dataclass
class Layout:
    """How the series of one table are spread over tasks.

    It serves every table that holds the same rows of each series, with whatever columns;
    whole series may be absent.
    """

    series: Series
    total: int
    chunk: int
    levels: list[DataFrame | tuple] = field(default_factory=list)
    runs: list[Run] = field(default_factory=list)
    bins: DataFrame | None = None
    sizes: DataFrame | None = None

    @property
    def is_cut(self) -> bool:
        return bool(self.levels)

    # -- cutting ---------------------------------------------------------------

    def cut(self, df: DataFrame, long_series: list[Row]) -> None:
        spark, keys = df.sparkSession, list(self.series.keys)
        key_fields = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        pending = {
            i: (tuple(row[k] for k in keys), Bin(i, (), row)) for i, row in enumerate(long_series)
        }
        final: dict[int, Bin] = {}
        next_id = 0
        while pending:
            rows, children, first_new = [], {}, next_id
            for bin_id, (match, parent) in pending.items():
                division = parent.division(self.chunk)
                if division is None:
                    final[bin_id] = parent
                    continue
                rows.append((*match, next_id, *division))
                for part in range(division[3] + 3):
                    children[next_id + part] = (parent.root, parent.path + (part,))
                next_id += division[3] + 3
            if not rows:
                break
            if not keys and not self.levels:
                self.levels.append(rows[0])
            else:
                fields = [T.StructField("_k0", T.LongType())] if self.levels else key_fields
                schema = T.StructType(fields + _DIVISION.fields)
                self.levels.append(small_table(spark, rows, schema))
            found = (
                self._binned(df).where(F.col("_bin") >= first_new)
                .groupBy("_bin").agg(*_extent()).collect()
            )
            pending = {}
            for row in found:
                child = Bin(*children[row["_bin"]], row)
                if row.n > self.chunk:
                    pending[row["_bin"]] = ((row["_bin"],), child)
                else:
                    final[row["_bin"]] = child
        self._merge(spark, final)

    def _merge(self, spark: SparkSession, bins: dict[int, Bin]) -> None:
        ordered = sorted(bins.items(), key=lambda item: (item[1].root, item[1].path))
        for root, members in groupby(ordered, key=lambda item: item[1].root):
            done, held = 0, []
            for bin_id, part in members:
                n = part.extent.n
                if held and sum(size for _, size in held) + n > self.chunk:
                    done = self._close(root, done, held)
                    held = []
                held.append((bin_id, n))
            self._close(root, done, held)
        rows = [
            (bin_id, run.id, run.start) for run in self.runs for bin_id, _ in run.bins
        ]
        self.bins = small_table(spark, rows, _longs("_bin", "_run", "_start"))

    def _close(self, root: int, done: int, held: list[tuple[int, int]]) -> int:
        end = done + sum(n for _, n in held)
        self.runs.append(Run(len(self.runs), root, done, end, tuple(held)))
        return end

    def _binned(self, df: DataFrame) -> DataFrame:
        """Add ``_bin``: the slice of a long series, null for series left whole."""
        out = self.series.with_axes(df).withColumn("_bin", F.lit(None).cast("long"))
        for depth, level in enumerate(self.levels):
            if isinstance(level, tuple):
                # A single series: its one division needs no join.
                values = [F.lit(v).cast(f.dataType) for v, f in zip(level, _DIVISION.fields)]
                out = out.withColumn("_bin", _part_of(*values))
                continue
            on = list(self.series.keys) if depth == 0 else ["_bin"]
            match = reduce(
                Column.__and__, [out[name].eqNullSafe(level[f"_k{i}"]) for i, name in enumerate(on)]
            )
            found = _part_of(*[F.col(name) for name in _DIVISION.names])
            out = (
                out.join(F.broadcast(level), match, "left")
                .withColumn("_bin", F.coalesce(found, "_bin")).drop(*level.columns)
            )
        return out

    def placed(self, df: DataFrame) -> DataFrame:
        """Add ``_bin``, ``_run`` and the run's ``_start``, null for series left whole."""
        return self._binned(df).drop("_axis", "_tie").join(F.broadcast(self.bins), "_bin", "left")

    # -- use -------------------------------------------------------------------

    def positions(self, df: DataFrame, name: str = "_pos") -> DataFrame:
        """Number the rows of each series from 1 in order."""
        if not self.is_cut:
            return df.withColumn(name, F.row_number().over(self._window()).cast("long"))
        return (
            self.placed(df)
            .withColumn(name, self._position(self._window("_run")))
            .drop("_bin", "_run", "_start")
        )

    def _window(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self.series.keys, *extra).orderBy(*self.series.order)

    @staticmethod
    def _position(window: WindowSpec, reach: int = 0) -> Column:
        """Place in the series of a row whose run also holds up to ``reach`` rows before it."""
        before = F.greatest(F.col("_start") - reach, F.lit(0))
        return F.row_number().over(window).cast("long") + F.coalesce(before, F.lit(0))

    def first(self, df: DataFrame, n: int) -> DataFrame:
        """The first ``n`` rows of each series; of a cut series only the bins that hold them
        are shuffled."""
        if not self.is_cut:
            rank = F.row_number().over(self._window())
            return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
        near = [
            (bin_id, start) for run in self.runs
            for bin_id, start, _ in run.spans() if start < n
        ]
        starts = small_table(df.sparkSession, near, _longs("_bin", "_start"))
        return (
            self._binned(df).drop("_axis", "_tie").join(F.broadcast(starts), "_bin", "left")
            .where(F.col("_bin").isNull() | F.col("_start").isNotNull())
            .withColumn("_pos", self._position(self._window("_bin")))
            .where(F.col("_pos") <= n).drop("_bin", "_start", "_pos")
        )

    def over(
        self, df: DataFrame, build: Build, preceding: int = 0, following: int = 0
    ) -> DataFrame:
        """Add the window columns ``build(window, position)`` returns.

        Frames may reach ``preceding`` rows back and ``following`` rows ahead. A run of a cut
        series gets copies of the rows its frames reach in the neighbouring runs; they are
        dropped afterwards. All rows are shuffled once, as for whole series.
        """
        if not self.is_cut:
            whole = self._window()
            return df.withColumns(build(whole, F.row_number().over(whole)))
        inside = self._window("_run")
        return (
            self._spread(df, preceding, following).withColumns(build(inside, self._position(inside, preceding)))
            .where(~F.col("_copy")).drop("_run", "_start", "_copy")
        )

    def _spread(self, df: DataFrame, preceding: int, following: int) -> DataFrame:
        """Rows by run, with copies (``_copy``) of those that frames reach in neighbouring runs."""
        rows = self.placed(df)
        spread = rows.drop("_bin").withColumn("_copy", F.lit(False))
        for reach, last in ((preceding, True), (following, False)):
            if reach:
                spread = spread.unionByName(self._copies(rows, reach, last))
        return spread

    def apply(
        self, df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
        preceding: int = 0, following: int = 0,
    ) -> DataFrame:
        """Arbitrary code over every series: ``function`` maps ordered rows to as many rows.

        It sees a whole series or, of a cut one, a run with the ``preceding`` rows before it and the
        ``following`` rows after it; what it returns for these is dropped. So no task holds a long
        series, and a function that looks no further gives the same either way.
        """
        order, columns = list(self.series.order), df.columns
        rows = self._spread(df, preceding, following) if self.is_cut else df.withColumns(
            {"_run": F.lit(None).cast("long"), "_copy": F.lit(False)})

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(list(dict.fromkeys(order)), kind="stable")
            own = ~frame["_copy"].to_numpy()
            found = function(frame[columns].reset_index(drop=True))
            if len(found) != len(own):
                raise ValueError(f"{len(found)} rows returned for {len(own)}")
            return found[own]

        return rows.groupBy(*self.series.keys, "_run").applyInPandas(run, schema)

    def _copies(self, rows: DataFrame, reach: int, last: bool) -> DataFrame:
        """The last (or first) rows of every run, once for each run whose frames reach them.

        Only the outer bins of a run are sorted, and each task keeps ``reach`` rows of a run.
        """
        links, edges = [], set()
        for run in self.runs:
            step = 1 if last else -1
            other, gap = run.id + step, 0
            while gap < reach and 0 <= other < len(self.runs) and self.runs[other].root == run.root:
                links.append((run.id, other, reach - gap))
                edges.update(run.edge(reach - gap, last))
                gap += self.runs[other].end - self.runs[other].start
                other += step
        spark = rows.sparkSession
        near = small_table(spark, [(b,) for b in sorted(edges)], _longs("_bin"))
        targets = small_table(spark, links, _longs("_run", "_to", "_rows"))
        primary, tie = self.series.order
        order = [F.col(c).desc() if last else F.col(c).asc() for c in (primary, tie)]
        outer = Window.partitionBy("_run").orderBy(*order)
        return (
            rows.join(F.broadcast(near), "_bin", "left_semi").drop("_bin")
            .withColumn("_rank", F.row_number().over(outer)).where(F.col("_rank") <= reach)
            .join(F.broadcast(targets), "_run").where(F.col("_rank") <= F.col("_rows"))
            .withColumns({"_run": F.col("_to"), "_copy": F.lit(True)})
            .drop("_to", "_rows", "_rank")
        )

    def running(self, df: DataFrame, **totals: tuple[str, Column]) -> DataFrame:
        """Running ``sum``, ``min`` or ``max`` from the start of each series.

        ``totals`` maps a new column to ``(kind, value)``. A cut series runs inside each
        run and adds what the earlier runs carry over, one small row per run.
        """
        rows = self.placed(df).drop("_bin", "_start") if self.is_cut else df
        upto = self._window(*(["_run"] if self.is_cut else []))
        upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = rows.withColumns(
            {name: _KINDS[kind](value).over(upto) for name, (kind, value) in totals.items()}
        )
        if not self.is_cut:
            return local
        per_run = (
            rows.where(F.col("_run").isNotNull()).groupBy("_run")
            .agg(*[_KINDS[kind](value).alias(f"_c_{name}") for name, (kind, value) in totals.items()])
            .join(F.broadcast(self._roots(df.sparkSession)), "_run")
        )
        earlier = (
            Window.partitionBy("_root").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
        )
        # One row per run: their number is bounded, so the result can be broadcast.
        carried = per_run.select(
            "_run",
            *[_KINDS[kind](f"_c_{name}").over(earlier).alias(f"_c_{name}")
              for name, (kind, _) in totals.items()],
        )
        merged = {}
        for name, (kind, _) in totals.items():
            before = F.col(f"_c_{name}")
            if kind == "sum":
                merged[name] = F.when(before.isNull(), F.col(name)).otherwise(
                    F.coalesce(F.col(name), F.lit(0)) + before
                )
            else:
                merged[name] = (F.least if kind == "min" else F.greatest)(F.col(name), before)
        joined = local.join(F.broadcast(carried), "_run", "left")
        return joined.withColumns(merged).drop("_run", *[f"_c_{name}" for name in totals])

    def _roots(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, [(r.id, r.root) for r in self.runs], _longs("_run", "_root"))

    def rows_at(self, df: DataFrame, positions: Sequence[int]) -> DataFrame:
        """The rows at the given 1-based positions of a table that is one single series.

        Of a cut series only the bins that hold a wanted position are sorted.
        """
        if self.series.keys:
            raise ValueError("rows_at needs a series without keys")
        wanted = [int(p) for p in positions]
        if not self.is_cut:
            return self.positions(df).where(F.col("_pos").isin(wanted))
        near = [
            (bin_id, start) for run in self.runs for bin_id, start, n in run.spans()
            if any(start < p <= start + n for p in wanted)
        ]
        starts = small_table(df.sparkSession, near, _longs("_bin", "_start"))
        return (
            self._binned(df).drop("_axis", "_tie").join(F.broadcast(starts), "_bin")
            .withColumn("_pos", self._position(self._window("_bin")))
            .where(F.col("_pos").isin(wanted)).drop("_bin", "_start")
        )


    def ranges(self) -> list[tuple[int, int, int]]:
        """Runs of a table that is one single series: number, first place (from 0) and end."""
        if self.series.keys:
            raise ValueError("ranges of places need a series without keys")
        return [(run.id, run.start, run.end) for run in self.runs] or [(0, 0, self.total)]

    def dealt(self, df: DataFrame, ranges: Sequence[tuple[int, int, int]]) -> DataFrame:
        """Rows of a single series dealt to ranges of places (number, start, end), in order.

        A row goes to every range that its bin reaches: to one, or at a border to both sides of it.
        ``_run`` is the range, ``_before`` the rows of the series before the first one dealt to it.
        Rows of bins that no range reaches are left out.
        """
        if self.series.keys:
            raise ValueError("ranges of places need a series without keys")
        bins = [span for run in self.runs for span in run.spans()] or [(None, 0, self.total)]
        reached, first = [], 0
        for number, start, end in ranges:
            while first < len(bins) and bins[first][1] + bins[first][2] <= start:
                first += 1
            at, before = first, None
            while at < len(bins) and bins[at][1] < end:
                before = bins[at][1] if before is None else before
                reached.append((bins[at][0], number, before))
                at += 1
        if not self.is_cut:
            # few rows: at most two of the other table's runs have places among them, besides short ones
            to = F.array(*[F.lit(run).cast("long") for _, run, _ in reached]).cast("array<long>")
            return df.withColumn("_run", F.explode(to)).withColumn("_before", F.lit(0).cast("long"))
        table = small_table(df.sparkSession, reached, _longs("_bin", "_run", "_before"))
        return self._binned(df).drop("_axis", "_tie").join(F.broadcast(table), "_bin").drop("_bin")


def _part_of(base: Column, by_tie: Column, lo: Column, width: Column, parts: Column) -> Column:
    """Bin of a row: the equal part of a division its order value falls into."""
    value = F.when(by_tie, F.col("_tie").cast("double")).otherwise(F.col("_axis").cast("double"))
    share = F.least((value - lo) / width, F.lit(1.0))
    part = F.least(F.floor(share * parts), parts - 1) + 1
    return base + (
        F.when(value == float("-inf"), 0).when(value == float("inf"), parts + 1)
        .when(F.isnan(value), parts + 2).otherwise(part).cast("long"))


def _longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.LongType()) for name in names])


_DIVISION = T.StructType([
    T.StructField("_base", T.LongType()),
    T.StructField("_by_tie", T.BooleanType()),
    T.StructField("_lo", T.DoubleType()),
    T.StructField("_width", T.DoubleType()),
    T.StructField("_parts", T.IntegerType()),
])

_KINDS = {"sum": F.sum, "min": F.min, "max": F.max}
