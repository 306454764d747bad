"""What the plans must and must not contain."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from catalog.registry import SQL  # noqa: E402
from catalog.views import Views  # noqa: E402
from meterflow.operators import metrics, reports, resample, splits, windows  # noqa: E402
from meterflow.operators.series import Series  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
ORDER = ("timestamp", "event_id")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_query_multiplies_tables(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(entry.queries()["filter_meter"](spark, FOLDER))
    assert "EqualTo(event_type,view)" in plan and "props" not in plan
    plan = plan_of(entry.queries()["resample_mean"](spark, FOLDER))
    assert "user_id" not in plan and len(exchanges(plan)) == 1


def test_whole_series_are_shuffled_once(spark):
    v = Views(spark, FOLDER)
    plan = plan_of(windows.lag_features(v.readings(), v.readings_layout(), "meter_reading", 7))
    assert len(exchanges(plan)) == 1


def test_cut_series_are_shuffled_once_and_copies_are_limited(spark):
    v = Views(spark, FOLDER)
    layout = Series((), ORDER, 1000).measure(v.household())
    plan = plan_of(windows.moving_average(v.household(), layout, "P", 5))
    assert len(exchanges(plan)) == 2 and "WindowGroupLimit" in plan


def test_position_split_does_not_move_the_table(spark):
    v = Views(spark, FOLDER)
    plan = plan_of(splits.cut_by_position(v.household(), ORDER, rows_per_chunk=1000))
    assert "Exchange" not in plan and "Window" not in plan


def test_latest_rows_are_aggregated_before_the_shuffle(spark):
    v = Views(spark, FOLDER)
    plan = plan_of(reports.latest_per_group(v.metrics_runs(), ["Model"], "timestamp", "o_orderkey"))
    assert "partial_max_by" in plan and "Window" not in plan


def test_first_rows_are_limited_before_the_shuffle(spark):
    v = Views(spark, FOLDER)
    ids = v.buildings()
    layout = Series(["primary_use"], ("building_id", "building_id")).measure(ids)
    assert "WindowGroupLimit" in plan_of(layout.first(ids, 5))


def test_resample_copies_partial_results_not_rows(spark):
    v = Views(spark, FOLDER)
    jobs = resample.make_jobs(["1T", "1h", "1D"], include_max=True)
    plan = plan_of(resample.resample_all(v.household(), jobs, ("P", "Q")))
    rows, partials = plan.rindex("FileScan"), [m.start() for m in re.finditer("Generate explode", plan)]
    last = plan.rindex("Exchange hashpartitioning", 0, rows)
    assert partials and all(at < last for at in partials)  # nothing is copied between the scan and its shuffle


def test_error_boxes_neither_sort_nor_move_rows(spark):
    v = Views(spark, FOLDER)
    plan = plan_of(metrics.error_boxes(v.predictions()))
    assert "Sort [abs_error" not in plan and "row_number" not in plan
