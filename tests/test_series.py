"""Series cut into cells must give what plain windows give."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterflow.operators import joins
from meterflow.operators.series import Series


def frames(spark):
    """Series of very different shapes, each a table of (k, t, id, v)."""
    base = spark.range(600).withColumnRenamed("id", "i")
    yield "one key holds most rows", base.selectExpr(
        "IF(i % 3 < 2, 0, i % 50) AS k", "i * 7 % 600 AS t", "i AS id", "i % 11 AS v")
    yield "half the rows share one time", base.selectExpr(
        "0 AS k", "IF(i % 2 = 0, 100, i) AS t", "i AS id", "i % 11 AS v")
    yield "times bunch up", base.selectExpr(
        "i % 2 AS k", "exp(i % 200 / 10.0) AS t", "i AS id", "i % 11 AS v")
    yield "null key", base.selectExpr(
        "IF(i % 2 = 0, NULL, 1) AS k", "i AS t", "i AS id", "i % 11 AS v")
    yield "zone-less times", base.selectExpr(
        "0 AS k", "TIMESTAMP_NTZ '2016-01-01' + make_dt_interval(0, 0, 0, i * 1.5) AS t",
        "i AS id", "i % 11 AS v")


def same(left, right):
    order = sorted(left.columns)
    return sorted(map(repr, left.select(order).collect())) == sorted(
        map(repr, right.select(order).collect()))


def build(w, pos):
    return {
        "mean": F.round(F.avg("v").over(w.rowsBetween(-4, -1)), 9),
        "next": F.lead("v", 2).over(w),
        "place": pos.cast("long"),
    }


@pytest.mark.parametrize("chunk", [7, 64])
def test_cut_equals_whole(spark, chunk):
    for name, df in frames(spark):
        df = df.cache()
        whole = Series(["k"], ("t", "id")).measure(df)
        cut = Series(["k"], ("t", "id"), chunk).measure(df)
        assert cut.is_cut and not whole.is_cut, name
        assert same(cut.positions(df), whole.positions(df)), name
        assert same(cut.over(df, build, 4, 2), whole.over(df, build, 4, 2)), name
        totals = {"s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("id"))}
        assert same(cut.running(df, **totals), whole.running(df, **totals)), name
        df.unpersist()


def test_no_run_is_longer_than_a_chunk(spark):
    for name, df in frames(spark):
        layout = Series(["k"], ("t", "id"), 20).measure(df)
        assert max(run.end - run.start for run in layout.runs) <= 20, name


def test_frames_may_be_longer_than_runs(spark):
    df = spark.range(60).selectExpr("0 AS k", "id AS t", "id", "id % 7 AS v")

    def wide(w, pos):
        return {"s": F.sum("v").over(w.rowsBetween(-25, 11)), "p": pos.cast("long")}

    whole = Series(["k"], ("t", "id")).measure(df).over(df, wide, 25, 11)
    assert same(Series(["k"], ("t", "id"), 4).measure(df).over(df, wide, 25, 11), whole)


def test_rows_at(spark):
    df = spark.range(500).selectExpr("id", "(id * 37) % 500 AS t")
    for chunk in (10, 10_000):
        layout = Series((), ("t", "id"), chunk).measure(df)
        found = {r._pos: r.t for r in layout.rows_at(df, [1, 250, 500, 501]).collect()}
        assert found == {1: 0, 250: 249, 500: 499}


def test_partition_count_does_not_matter(spark):
    df = spark.range(300).selectExpr("id % 3 AS k", "(id * 7) % 300 AS t", "id", "id % 5 AS v")
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spread = df.repartition(n)
            layout = Series(["k"], ("t", "id"), 25).measure(spread)
            results.append(sorted(map(repr, layout.over(spread, build, 4, 2).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=30, max_size=80), st.integers(2, 12))
def test_positions_of_any_values(spark, values, chunk):
    rows = [(v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "t double, id long").coalesce(1)
    layout = Series((), ("t", "id"), chunk).measure(df)
    found = [(r.t, r.id) for r in layout.positions(df).orderBy("_pos").collect()]
    assert found == sorted(rows)


@pytest.mark.parametrize("chunk", [3, 10])
def test_values_without_end(spark, chunk):
    odd = [float("nan"), float("inf"), float("-inf"), 1.7e308, -1.7e308, 0.0]
    for values in ([float(i) for i in range(60)] + odd[:1], [float(i % 7) for i in range(60)] + odd * 3,
                   [5.0] * 40, odd[:1] * 40, odd[1:3] * 20, odd * 8):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(3)
        whole, cut = Series((), ("v", "id"), 10**6).measure(df), Series((), ("v", "id"), chunk).measure(df)
        assert cut.is_cut and not whole.is_cut
        assert same(cut.positions(df), whole.positions(df))
        assert max(run.end - run.start for run in cut.runs) <= chunk


@pytest.mark.parametrize("nl, nr, offset, cl, cr", [
    (1000, 1200, 5, None, None), (1000, 1200, 5, 100, 90), (600, 200, -7, 100, None), (200, 900, 700, None, 100),
    (500, 500, 0, 30, 400), (50, 5, 100, 10, 2), (0, 5, 0, None, None),
])
def test_positional_join_of_cut_tables(spark, nl, nr, offset, cl, cr):
    draw = random.Random(1)
    left = [(float(draw.randrange(200)), i) for i in range(nl)]
    right = [(draw.randrange(50), i) for i in range(nr)]
    l = spark.createDataFrame(left, "t double, i long").repartition(3)  # noqa: E741
    r = spark.createDataFrame(right, "t long, i long").repartition(4)
    order = ("t", "i")
    joined = joins.positional_join(
        l, Series((), order, cl).measure(l), r, Series((), order, cr).measure(r), offset)
    left.sort(), right.sort()
    want = [(*left[i], *right[i + offset]) for i in range(nl) if 0 <= i + offset < nr]
    assert sorted(tuple(row) for row in joined.collect()) == sorted(want)


def test_positional_join_shuffles_each_side_once(spark):
    l = spark.range(3000).select(F.col("id"), (F.col("id") % 7).alias("t"))  # noqa: E741
    layouts = [Series((), ("t", "id"), chunk).measure(l) for chunk in (200, 300)]
    plan = joins.positional_join(l, layouts[0], l, layouts[1], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_code_over_cut_and_whole_series(spark):
    """A third of the rows in one group: runs with their halo give what whole groups give."""
    df = spark.range(900).selectExpr(
        "IF(id % 3 = 0, 0, IF(id % 50 = 1, NULL, id % 20)) AS k", "id * 37 % 301 AS t", "id", "CAST(id * 13 % 97 AS DOUBLE) AS v")

    def smooth(frame):
        mean = frame["v"].rolling(7, center=True, min_periods=1).mean()
        return frame[["id"]].assign(mean=mean)

    results = []
    for chunk in (40, 100_000):
        layout = Series(["k"], ("t", "id"), chunk).measure(df)
        assert layout.is_cut == (chunk == 40)
        results.append({r.id: r["mean"] for r in layout.apply(df, smooth, "id long, mean double", 3, 3).collect()})
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-3, 3)
    plain = {r.id: r["m"] for r in df.select("id", F.avg("v").over(w).alias("m")).collect()}
    for found in results:
        assert found.keys() == plain.keys()
        assert all(found[i] == pytest.approx(plain[i]) for i in plain)
    with pytest.raises(Exception, match="rows returned"):
        Series(["k"], ("t", "id")).measure(df).apply(df, lambda f: f[["id"]].head(1), "id long").collect()
