"""Exact order statistics by counting, without ranking all rows.

``percentile`` keeps every value of a group in one task and a sort moves every row. Here the
rows stay where they are: each round counts the values of a group in equal parts of its range,
a partial aggregate of at most ``PARTS`` rows a task, and goes on with the parts that hold a
wanted rank, between their exact least and greatest value. Parts of equal values are done. Once
no more than ``FEW`` rows are left in all open parts together, their values are counted one by
one. Parts are equally wide in one round and equally wide in the logarithm in the next. The former
part the least from the greatest value, so the search ends for any data; the latter make it short
for values of very different size. For smooth distributions the second round is the last.

NaN is greater than any other value, infinities have parts of their own, nulls do not count.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.operators.series import MAX_FETCHED
from meterflow.session import small_table, stored

#: Parts of a range, besides those of -infinity, infinity and NaN.
PARTS = 1024
#: Rows in open parts that are counted value by value.
FEW = 200_000


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def _extent(value: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
            F.min(_finite(value)).alias("from"), F.max(_finite(value)).alias("to")]


def _magnitude(value: Column) -> Column:
    """A measure that grows with the logarithm of a value's size, on both sides of zero."""
    return F.signum(value) * (F.log(F.greatest(F.abs(value), F.lit(5e-324))) + 745.0)


def _part(value: Column, by_size: bool) -> Column:
    """Part of its range that a value falls into; greater values never fall into a smaller one."""
    scale = _magnitude if by_size else lambda x: x  # the logarithm of the JVM never falls
    low, high = scale(F.col("from")), scale(F.col("to"))
    width = F.least(high - low, F.lit(sys.float_info.max))
    share = F.least(F.coalesce(F.try_divide(scale(value) - low, width), F.lit(0.0)), F.lit(1.0))
    inside = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)) + 1
    return (F.when(value == float("-inf"), 0).when(F.isnan(value), PARTS + 2)
            .when(value == float("inf"), PARTS + 1).otherwise(inside).cast("int"))


def _numbered(parts: DataFrame) -> tuple[DataFrame, int]:
    """Parts with a number each, by which rows are counted, and the rows of those still open.

    A few parts become part of the plan; the table of more of them is written down.
    """
    schema = T.StructType([*parts.schema.fields, T.StructField("id", T.LongType())])
    fetched = parts.limit(MAX_FETCHED + 1).collect()
    if len(fetched) <= MAX_FETCHED:
        rows = [(*row, i) for i, row in enumerate(fetched)]
        return small_table(parts.sparkSession, rows, schema), sum(r.n for r in fetched if r.hi != r.lo and not (r.lo != r.lo))
    table = stored(parts.withColumn("id", F.monotonically_increasing_id()))
    return table, table.where("lo < hi").agg(F.sum("n")).first()[0] or 0


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, ranks: Column, few: int = FEW) -> DataFrame:
    """Values at the given ranks of each group: ``by``, ``n`` rows of the group, and ``at``, a map
    from rank to value.

    ``rows`` is read once a round, so it should be a table and no long computation. ``ranks`` is an
    array of ranks from 0, computed from ``n``.
    """
    own = [f"_g{i}" for i in range(len(by))]
    slim = rows.select(*(F.col(c).alias(g) for c, g in zip(by, own)), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    v = F.col("_v")
    found = slim.groupBy(*own).agg(*_extent(v)).withColumns({
        "total": F.col("n"), "before": F.lit(0).cast("long")})
    found = found.withColumn("ranks", F.array_distinct(ranks.cast("array<long>")))
    parts, left = _numbered(found)
    done, by_size = [parts.where("lo = hi")], False
    while left:
        # a part of equal values has its answer; the others are counted, once few rows are left value by value
        open_parts = parts.where("lo < hi")
        ranges = open_parts.select(*(F.col(g).alias(f"o{i}") for i, g in enumerate(own)), "id", "lo", "hi", "from", "to")
        match = [slim[g].eqNullSafe(ranges[f"o{i}"]) for i, g in enumerate(own)] + [v.between(F.col("lo"), F.col("hi"))]
        part = v if left <= few else _part(v, by_size)
        by_size = not by_size
        counted = slim.join(ranges, match).groupBy("id", part.alias("part")).agg(*_extent(v))
        earlier = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("part")
        placed = counted.join(open_parts.select("id", *own, "total", "before", "ranks"), "id").withColumn(
            "before", F.col("before") + F.col("earlier")).drop("id", "earlier")
        parts, left = _numbered(placed.where(F.exists(
            "ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))))
        done.append(parts.where("lo = hi"))
    known = done[0]
    for more in done[1:]:
        known = known.unionByName(more)
    held = known.select(*own, "total", F.col("lo").alias("_v"), F.explode(F.filter(
        "ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).alias("_rank"))
    return held.groupBy(*own).agg(
        F.max("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("at"),
    ).withColumnsRenamed(dict(zip(own, by)))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, probabilities: Mapping[str, float], few: int = FEW) -> DataFrame:
    """Exact quantiles of each group, interpolated between the two nearest values."""
    place = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in probabilities.items()}
    ranks = F.array(*(end(at).cast("long") for at in place.values() for end in (F.floor, F.ceil)))
    found = order_statistics(rows, by, value, ranks, few)

    def between(at: Column) -> Column:
        low, high = (F.element_at("at", end(at).cast("long")) for end in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return found.select(*by, *(between(at).alias(name) for name, at in place.items()))
