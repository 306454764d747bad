"""Edge rules on tiny literal tables."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meterflow.functions import scalars
from meterflow.functions.calendar import calendar_features, holiday_flag, parse_timestamps
from meterflow.operators import joins, metrics, reports, resample, scaling, splits, windows
from meterflow.operators.series import Series
from meterflow.plans import household
from meterflow.sources import results

TS = "TIMESTAMP_NTZ"


def at(spark, *rows, columns):
    return spark.createDataFrame(list(rows), columns)


def test_constant_column_scales_to_differences(spark):
    train = at(spark, (5.0,), (5.0,), columns="x double")
    stats = scaling.ColumnStats.fit(train, ["x"])
    rest = at(spark, (5.0,), (8.0,), columns="x double")
    assert [r.x for r in stats.scale(train).collect()] == [0.0, 0.0]
    assert sorted(r.x for r in stats.scale(rest).collect()) == [0.0, 3.0]
    wide = scaling.ColumnStats({"x": 0.0}, {"x": 0.0}, {"x": 2.0})
    assert wide.scale(at(spark, (1.0,), columns="x double"), (-1.0, 1.0)).first().x == 0.0


def test_missing_mean_is_zero(spark):
    train = at(spark, (None,), columns="x double")
    stats = scaling.ColumnStats.fit(train, ["x"])
    assert stats.impute(train).first().x == 0.0


def test_nan_becomes_null_before_a_fit(spark):
    df = at(spark, (float("nan"),), (3.0,), columns="x double")
    assert scaling.ColumnStats.fit(scaling.nan_to_null(df, ["x"]), ["x"]).mean == {"x": 3.0}


def test_short_groups_have_no_windows(spark):
    rows = [(g, i, float(i)) for g, n in (("a", 3), ("b", 4)) for i in range(n)]
    df = at(spark, *rows, columns="g string, i long, v double")
    for chunk in (10, 2):
        layout = Series(["g"], ("i", "i"), chunk).measure(df)
        out = windows.sliding_windows(df, layout, ["v"], 3, "i").collect()
        assert [(r.g, r.x, r.y, r.window_start) for r in out] == [
            ("b", [[0.0], [1.0], [2.0]], [3.0], 0)]


def test_windows_do_not_cross_groups(spark):
    rows = [(i % 2, i, float(i)) for i in range(40)]
    df = at(spark, *rows, columns="g long, i long, v double")
    layout = Series(["g"], ("i", "i"), 6).measure(df)
    out = windows.sliding_windows(df, layout, ["v"], 4, "i", horizon=2).collect()
    assert len(out) == 2 * (20 - 4 - 1)
    for row in out:
        assert {int(s[0]) % 2 for s in row.x} | {int(y) % 2 for y in row.y} == {row.g}


def test_lags_of_a_short_window_repeat_the_oldest(spark):
    df = at(spark, *[(i, float(i)) for i in range(5)], columns="i long, v double")
    layout = Series((), ("i", "i")).measure(df)
    row = windows.lag_features(df, layout, "v", length=2).orderBy("i").first()
    assert (row.i, row.lag1, row.lag2, row.lag3) == (2, 1.0, 0.0, 0.0)


def test_resample_gaps_and_missing_measures(spark):
    df = at(spark, ("2016-01-01 00:00:01", 1.0, 1.0), ("2016-01-01 00:00:02", 3.0, 1.0),
            ("2016-01-01 00:10:00", 5.0, 1.0), ("2016-01-01 00:20:00", 5.0, None),
            columns="timestamp string, P double, Q double")
    df = parse_timestamps(df)
    out = resample.resample(df, resample.ResampleJob("5T"), ["P", "Q"]).orderBy("timestamp").collect()
    assert [(r.timestamp.minute, r.P) for r in out] == [(0, 2.0), (10, 5.0)]
    both = resample.resample_all(
        df, resample.make_jobs(["5T", "1h"], include_max=True), ["P", "Q"])
    assert both.where("interval = '1h' AND aggregation = 'max'").first().P == 5.0
    assert both.count() == 2 + 2 + 1 + 1


def test_buckets_count_from_midnight_of_the_first_day(spark):
    df = at(spark, ("2016-01-01 03:00:00", 1.0), ("2016-01-02 01:00:00", 2.0),
            columns="timestamp string, P double")
    out = resample.resample(
        parse_timestamps(df), resample.ResampleJob("7h"), ["P"]).orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [datetime(2016, 1, 1, 0), datetime(2016, 1, 1, 21)]


def test_unknown_aggregation_and_interval():
    with pytest.raises(ValueError):
        resample.ResampleJob("5T", "median")
    with pytest.raises(ValueError):
        resample.ResampleJob("five").seconds


def greedy(counts, targets, limits):
    """The split as a plain loop."""
    taken = {p: [] for p in splits.SPLITS}
    samples = dict.fromkeys(splits.SPLITS, 0)
    for g, n in sorted(counts, key=lambda c: (-c[1], -c[0])):
        for p in splits.SPLITS:
            if samples[p] < targets[p] and (limits.get(p) is None or len(taken[p]) < limits[p]):
                taken[p].append(g)
                samples[p] += n
                break
        else:
            break
    return taken


def test_group_split_of_equal_buildings(spark):
    counts = spark.range(30).selectExpr("id AS building_id", "8784L AS n")
    targets = {"train": 100_000, "val": 50_000, "test": 100_000}
    out = splits.disjoint_split(counts, targets, {"train": 6}, rows_per_chunk=8)
    sizes = {r.split: (r.groups, r.total) for r in out.groupBy("split").agg(
        F.count("*").alias("groups"), F.sum("n").alias("total")).collect()}
    assert sizes == {"train": (6, 52_704), "val": (6, 52_704), "test": (12, 105_408)}
    assert {r.building_id for r in out.where("split = 'train'").collect()} == set(range(24, 30))


@pytest.mark.parametrize("seed", range(4))
def test_group_split_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    counts = [(g, rng.randint(1, 9)) for g in range(40)]
    targets = {p: rng.randint(0, 80) for p in splits.SPLITS}
    limits = {p: rng.choice([None, rng.randint(0, 12)]) for p in splits.SPLITS}
    df = at(spark, *counts, columns="building_id long, n long")
    out = splits.disjoint_split(df, targets, limits, rows_per_chunk=5).collect()
    found = {p: sorted(r.building_id for r in out if r.split == p) for p in splits.SPLITS}
    assert found == {p: sorted(g) for p, g in greedy(counts, targets, limits).items()}


@pytest.mark.parametrize("chunk", [16, 10_000])
def test_position_splits(spark, chunk):
    df = spark.range(100).selectExpr("id", "(id * 7) % 100 DIV 3 AS t")
    order = sorted((r.t, r.id) for r in df.collect())
    for option, sizes in ((2, [80, 20]), (3, [56, 24, 20]), (1, [80, 0, 20])):
        out = splits.cut_by_position(df, ("t", "id"), option=option, rows_per_chunk=chunk)
        label = {(r.t, r.id): r.split for r in out.collect()}
        names = list(splits.split_sizes(100, option))
        expected = [n for n, s in zip(names, sizes) for _ in range(s)]
        assert [label[key] for key in order] == expected
    assert {r.id for r in splits.first_rows(df, ("t", "id"), 7, chunk).collect()} == {
        i for _, i in order[:7]}


def test_split_sizes():
    assert splits.split_sizes(82_944, 3) == {"train": 46448, "val": 19906, "test": 16590}
    assert splits.split_sizes(10_000, 0)["lookback"] == 720
    assert splits.group_split_sizes(11, (0.4, 0.2, 0.4)) == {"train": 4, "val": 2, "test": 5}
    with pytest.raises(ValueError):
        splits.split_sizes(10, 9)


def row_of(spark, *pairs):
    df = at(spark, *[("m", float(y), float(p)) for y, p in pairs],
            columns="model string, y_true double, y_pred double")
    return metrics.metrics(df).first()


def test_percentage_errors_skip_small_truths(spark):
    row = row_of(spark, (0, 1), (0.5, 1), (2, 3))
    assert row.MAPE == pytest.approx(75.0)
    assert row.MAPE_abs1 == pytest.approx(50.0)
    assert row.MAPE_clipped == pytest.approx(100 * (1e9 + 1 + 0.5) / 3)


def test_all_zero_truth(spark):
    row = row_of(spark, (0, 1), (0, 2))
    assert math.isinf(row.MAPE) and math.isinf(row.MAPE_abs1) and row.R2 == 0.0


def test_negative_predictions(spark):
    assert row_of(spark, (0, -1)).RMSLE == 0.0


def test_box_numbers(spark):
    errors = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = at(spark, *[("m", i, e, 0.0) for i, e in enumerate(errors)],
            columns="model string, row_id long, y_true double, y_pred double")
    for chunk in (2, 100):
        row = metrics.error_boxes(df, rows_per_chunk=chunk).first()
        assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
        assert (row.whisker_low, row.whisker_high) == (1.0, 4.0)


def test_anova_of_known_groups(spark):
    groups = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    df = at(spark, *[(g, float(x)) for g, xs in groups.items() for x in xs],
            columns="model string, abs_error double")
    row = metrics.anova(df).first()
    assert row.f == pytest.approx(9.264706, abs=1e-6) and (row.df1, row.df2) == (2, 15)
    one = metrics.anova(df.where("model = 'a'")).first()
    assert one.f is None and one.df1 == 0


def test_null_groups_have_boxes(spark):
    df = at(spark, *[(m, i, float(i), 0.0) for m in ("m", None) for i in range(5)],
            columns="model string, row_id long, y_true double, y_pred double")
    for chunk in (2, 100):
        rows = metrics.error_boxes(df, rows_per_chunk=chunk).collect()
        assert {(r.model, r.q1, r.median, r.q3) for r in rows} == {("m", 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0)}


def test_unknown_fitness_never_wins(spark):
    df = at(spark, ("a", 1, 5.0), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, 3.0), ("b", 1, None),
            columns="algorithm string, eval_num long, VAL_RMSE_orig double")
    assert [(r.algorithm, r.eval_num) for r in reports.best_trial(df).collect()] == [("a", 4)]


def test_repeated_labels_appear_once(spark):
    df = spark.range(1).selectExpr("1 AS rmse", "2 AS mae", "3 AS rmse", "4 AS other")
    out = reports.columns_like(df, ["rmse", "mae"])
    assert out.columns == ["rmse", "mae"] and tuple(out.first()) == (1, 2)


def test_windows_keep_null_targets(spark):
    df = spark.range(20).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2016-01-01' + make_dt_interval(0, 0, id) AS t",
        "CASE WHEN id <> 9 THEN CAST(id AS DOUBLE) END AS P")
    for chunk in (4, 100):
        layout = Series((), ("t", "event_id"), chunk).measure(df)
        for horizon, count in ((1, 17), (2, 16)):
            out = windows.sliding_windows(df, layout, ["P"], 3, "t", horizon).collect()
            assert len(out) == count
            for r in out:
                want = [None if k == 9 else float(k) for k in range(r.event_id - 3, r.event_id + horizon)]
                assert [v[0] for v in r.x] + r.y == want


def test_many_categories(spark):
    df = spark.range(1001).selectExpr("id", "concat('c', id) AS c")
    assert len(scaling.categories(df, "c")) == 1001
    out = scaling.sparse_one_hot(df, df.union(spark.sql("SELECT 5000L, 'new'")), "c", "v").collect()
    assert {int(r.v.size) for r in out} == {1001}
    assert sorted(int(r.v.indices[0]) for r in out if r.id < 1001) == list(range(1001))
    assert next(r for r in out if r.id == 5000).v.numNonzeros() == 0


def test_undated_predictions_count_as_newest(spark):
    df = at(spark, ("a", datetime(2020, 1, 1), 1.0, 2.0), ("a", datetime(2021, 1, 1), 3.0, -4.0), ("b", None, 5.0, 6.0),
            ("b", datetime(2022, 1, 1), 7.0, 8.0), columns="algorithm string, run_ts timestamp_ntz, y_true double, y_pred double")
    assert {(r.algorithm, r.y_true, r.y_pred) for r in results.latest_predictions(df).collect()} == {("a", 3.0, 0.0), ("b", 5.0, 6.0)}


def test_undated_run_counts_as_latest(spark):
    df = at(spark, ("m", datetime(2020, 1, 1), 1, 5.0), ("m", None, 2, 7.0),
            columns="Model string, timestamp timestamp_ntz, id long, RMSE double")
    assert reports.latest_per_group(df, ["Model"], "timestamp", "id").first().RMSE == 7.0


def test_calendar(spark):
    df = at(spark, ("2016-10-05 23:05:00",), ("2016-07-04 10:00:00",), ("2016-07-05 10:00:00",),
            columns="timestamp string")
    out = holiday_flag(calendar_features(parse_timestamps(df))).orderBy("timestamp").collect()
    assert [r.is_holiday for r in out] == [1, 0, 0]
    assert (out[2].minute, out[2].weekday, out[2].hour) == (5, 2, 23)


def test_timestamp_parsing(spark):
    df = at(spark, ("2016-10-05 23:05:00.25",), ("bad",), (None,), columns="timestamp string")
    assert [r.timestamp for r in parse_timestamps(df).collect()] == [
        datetime(2016, 10, 5, 23, 5, 0, 250_000)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        parse_timestamps(df, strict=True).collect()
    with pytest.raises(ValueError):
        parse_timestamps(df, "time")


def test_bound_modes(spark):
    df = at(spark, (-1.0,), (0.5,), (3.5,), columns="x double")
    expected = {"clip": [0, 0.5, 2], "swap": [2, 0.5, 0], "mirror": [1, 0.5, 0.5], "wrap": [1, 0.5, 1.5]}
    for mode, values in expected.items():
        out = df.select(scalars.bounded(F.col("x"), 0.0, 2.0, mode).alias("y"))
        assert [r.y for r in out.collect()] == values, mode
    drawn = df.select(scalars.bounded(F.col("x"), 0.0, 2.0, "redraw").alias("y")).collect()
    assert all(0 <= r.y <= 2 for r in drawn) and 0.5 in {r.y for r in drawn}
    with pytest.raises(ValueError):
        scalars.bounded(F.col("x"), 0, 1, "other")


def test_logistic_map(spark):
    row = spark.range(1).select(scalars.logistic_map(F.lit(0.5), 3).alias("m")).first()
    assert row.m == pytest.approx([0.5, 0.1, 0.036])


def test_repeated_weather_keys_are_refused(spark):
    df = at(spark, (1, 1), (1, 1), columns="site_id long, timestamp long")
    with pytest.raises(ValueError):
        joins.require_unique(df, ["site_id", "timestamp"])


@pytest.mark.parametrize("chunk", [8, 10_000])
def test_convergence_and_its_steps(spark, chunk):
    df = spark.range(1, 121).selectExpr(
        "IF(id % 4 = 0, 'b', 'a') AS algorithm", "id AS eval_num",
        "1000.0D / sqrt(id) + (id * 37 % 11) * 20 AS VAL_RMSE_orig")
    series = Series(["algorithm"], ("eval_num", "eval_num"), chunk)
    layout = series.measure(df)
    curve = reports.convergence(df, layout)
    best, steps = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.eval_num):
        best[r.algorithm] = min(best.get(r.algorithm, math.inf), r.VAL_RMSE_orig)
        seen = steps.setdefault(r.algorithm, [])
        if not seen or best[r.algorithm] < seen[-1][1]:
            seen.append((r.eval_num, best[r.algorithm]))
    events = reports.improvements(curve, layout)
    found = sorted((r.algorithm, r.eval_num, r.best_so_far) for r in events.collect())
    assert found == sorted((a, *step) for a, seen in steps.items() for step in seen)
    filled = reports.step_fill(events.select("algorithm", "eval_num", "best_so_far"), series)
    expected = []
    for a, seen in steps.items():
        for (start, value), (stop, _) in zip(seen, [*seen[1:], (seen[-1][0] + 1, 0)]):
            expected += [(a, i, value) for i in range(start, stop)]
    assert sorted((r.algorithm, r.eval_num, r.best_so_far) for r in filled.collect()) == sorted(expected)


@pytest.mark.parametrize("chunk", [10, 10_000])
def test_first_rows_of_groups(spark, chunk):
    df = spark.range(500).selectExpr("IF(id % 3 = 0, 0, id % 7) AS k", "id", "(id * 13) % 250 AS v")
    out = Series(["k"], ("v", "id"), chunk).measure(df, few=True).first(df, 35).collect()
    expected = {}
    for r in sorted(df.collect(), key=lambda r: (r.v, r.id)):
        expected.setdefault(r.k, []).append(r.id)
    assert sorted(r.id for r in out) == sorted(i for ids in expected.values() for i in ids[:35])


def test_order_without_nulls_is_required(spark):
    df = spark.range(5).selectExpr("id", "nullif(id, 3) AS t")
    with pytest.raises(ValueError, match="1 nulls"):
        Series((), ("t", "id")).measure(df)


def test_external_forecast_is_placed_by_position(spark):
    """Reading n of the training part meets forecast n; the test part follows one step early."""
    n, length = 1000, 3
    df = spark.range(n).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ '2016-01-01' + make_dt_interval(0, 0, id) AS timestamp",
        "CAST(id AS DOUBLE) AS P")
    external = spark.range(n).selectExpr("id AS index", "CAST(id AS DOUBLE) AS forecast")
    data = household.household_data(
        df, option=1, length=length, measures=("P",), external=external, rows_per_chunk=100)
    assert data.sizes == {"lookback": 720, "train": 80, "test": 200}
    found = {r.event_id: r.forecast for r in data.windows.collect()}
    assert len(found) == 80 - length + 200 - length
    for i in range(80 - length):
        assert found[720 + length + i] == length + i
    for j in range(200 - length):
        assert found[800 + length + j] == 80 + length - 1 + j


def test_restored_undoes_scaled(spark):
    df = at(spark, (1.0,), (4.0,), (9.5,), columns="x double")
    stats = scaling.ColumnStats.fit(df, ["x"])
    back = stats.scale(df).select(stats.restored("x").alias("x"))
    assert [r.x for r in back.collect()] == pytest.approx([1.0, 4.0, 9.5])


def test_defaults_and_column_choice(spark):
    df = at(spark, ("m", 1.0, 5), columns="Model string, train_time_min double, other int")
    out = reports.with_defaults(df, {"train_time_min": 0.0, "Epochs": 0}, ["Model"])
    assert out.columns == ["Model", "train_time_min", "Epochs"]
    assert reports.columns_like(df, ["time", "epoch"], ["Model"]).columns == ["Model", "train_time_min"]


def test_resample_lattice_equals_single_jobs(spark):
    """Wider buckets merged from narrow ones: uneven widths, NaN, infinity, nulls, integers, keys."""
    draw = random.Random(8)
    rows = [(datetime(2016, 1, 1, 5) + timedelta(seconds=draw.randrange(400_000)), draw.choice(["a", "b", None]),
             draw.choice([draw.random(), 1e300, None, float("nan"), float("inf"), -1e-9]), draw.randrange(2**62))
            for _ in range(800)]
    df = spark.createDataFrame(rows, "timestamp timestamp, k string, P double, N long").repartition(3)
    jobs = resample.make_jobs(["7T", "5T", "1h", "1D", "9h"], include_max=True)
    both = resample.resample_all(df, jobs, ["P", "N"], keys=["k"])
    for job in jobs:
        one = resample.resample(df, job, ["P", "N"], keys=["k"])
        want = {(r.k, r.timestamp): (r.P, float(r.N)) for r in one.collect()}
        got = {(r.k, r.timestamp): (r.P, r.N) for r in both.where(
            (F.col("interval") == job.interval) & (F.col("aggregation") == job.aggregation)).collect()}
        assert got.keys() == want.keys()
        for key, values in want.items():
            assert got[key] == pytest.approx(values, rel=1e-12, nan_ok=True)


def test_means_do_not_depend_on_the_lattice(spark):
    draw = random.Random(9)
    values = [draw.uniform(0, 1) / 460 for _ in range(5000)]
    df = spark.createDataFrame([(datetime(2016, 1, 1) + timedelta(seconds=i), v) for i, v in enumerate(values)],
                               "timestamp timestamp, P double").repartition(7)
    day = resample.resample_all(df, resample.make_jobs(["1T", "1D"]), ["P"]).where("interval = '1D'").first()
    assert day.P == math.fsum(values) / len(values)


def test_positions_of_values(spark):
    train = at(spark, ("b",), ("é",), ("b",), (None,), ("",), ("B",), columns="c string").repartition(4)
    df = at(spark, (1, "b"), (2, None), (3, "new"), (4, ""), (5, "é"), (6, "b"), columns="id long, c string")
    found, size = scaling.positioned(train, df, "c")
    assert size == 4
    assert {r.id: r.position for r in found.collect()} == {1: 2, 2: None, 3: None, 4: 0, 5: 3, 6: 2}
    empty = scaling.sparse_one_hot(train.where("c IS NULL"), df, "c", "v").collect()
    assert len(empty) == 6 and all(r.v.numNonzeros() == 0 for r in empty)


def test_long_gaps_are_expanded_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(reports, "PIECE", 8)
    events = at(spark, ("a", 1, 9.0), ("a", 2000, 5.0), ("b", -70, 3.0), ("b", 0, 2.0), columns="k string, i int, v double")
    filled = reports.step_fill(events, Series(["k"], ("i", "i")))
    assert filled.columns == events.columns and dict(filled.dtypes)["i"] == "int"
    want = [("a", i, 9.0) for i in range(1, 2000)] + [("a", 2000, 5.0)]
    want += [("b", i, 3.0) for i in range(-70, 0)] + [("b", 0, 2.0)]
    assert sorted(map(tuple, filled.collect())) == sorted(want)


def test_a_gap_of_a_hundred_million_steps(spark):
    events = at(spark, ("a", 1, 9.0), ("a", 10**8, 5.0), columns="k string, i long, v double")
    filled = reports.step_fill(events, Series(["k"], ("i", "i")))
    row = filled.agg(F.count("i").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.sum("i").alias("s")).first()
    assert (row.n, row.lo, row.hi, row.s) == (10**8, 1, 10**8, 10**8 * (10**8 + 1) // 2)
