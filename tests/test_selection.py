"""Order statistics by counting against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.operators import selection
from meterflow.session import stored


def expected(values, p):
    ordered = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    at = (len(ordered) - 1) * p
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    if low == high or math.isnan(low) and math.isnan(high):
        return low
    return low + (high - low) * (at - math.floor(at))


def same(a, b):
    return a == b or math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-12)


INF, NAN = math.inf, math.nan
GROUPS = {
    "ties": [1.0] * 500 + [2.0] * 500 + [3.0],
    "one": [7.5],
    "two": [1.0, 2.0],
    "wide": [(-1) ** i * 10.0 ** (i % 600 - 300) for i in range(1200)],
    "odd": [NAN, INF, -INF, None, 0.0, -0.0, 1e-320, -1e308, 1e308, 2.0, NAN],
    "infinite": [INF] * 5 + [-INF] * 5,
    "nan": [NAN] * 4,
    "smooth": [random.Random(1).gauss(0, 1) for _ in range(3000)],
    None: [4.0, 5.0, None, 9.0],
}


@pytest.mark.parametrize("few", [2, 50, selection.FEW])
def test_quantiles(spark, few):
    rows = [(g, v) for g, values in GROUPS.items() for v in values] + [("empty", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(4)
    asked = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    got = {r.g: r for r in selection.quantiles(table, ["g"], "v", asked, few).collect()}
    assert set(got) == set(GROUPS)
    for g, values in GROUPS.items():
        for name, p in asked.items():
            assert same(got[g][name], expected(values, p)), (g, name)


def test_no_groups_and_two_keys(spark):
    table = spark.range(10_001).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("a"), F.lit("x").alias("b"))
    assert selection.quantiles(table, [], "v", {"m": 0.5}, 10).first().m == 5000.0
    got = selection.quantiles(table, ["a", "b"], "v", {"m": 0.5}, 10).collect()
    for r in got:
        assert r.m == np.median(np.arange(r.a, 10_001, 3))
    assert len(got) == 3
    assert selection.quantiles(table.limit(0), ["a"], "v", {"m": 0.5}).count() == 0


def test_rows_are_not_ranked(spark, monkeypatch):
    """Rounds shuffle counts: the only windows run over parts, and no plan sorts or moves the rows."""
    plans = []
    keep = selection._numbered

    def watched(parts):
        plans.append(parts._jdf.queryExecution().executedPlan().toString())
        return keep(parts)

    monkeypatch.setattr(selection, "_numbered", watched)
    table = stored(spark.range(50_000).select(F.rand(3).alias("v"), (F.col("id") % 2).alias("g")))
    selection.quantiles(table, ["g"], "v", {"q1": 0.25, "q3": 0.75}, 500).collect()
    assert len(plans) >= 3
    for plan in plans:
        first = plan[plan.rindex("Exchange hashpartitioning"):]  # the shuffle nearest to the rows
        assert "partial_count" in first.replace("\n", " ") and "Window" not in first and "Sort" not in first


def test_many_groups_are_written_down(spark, monkeypatch):
    monkeypatch.setattr(selection, "MAX_FETCHED", 3)
    table = spark.range(3000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 30).alias("g"))
    got = {r.g: r.m for r in selection.quantiles(table, ["g"], "v", {"m": 0.5}, 10).collect()}
    assert got == {g: float(np.median(np.arange(g, 3000, 30))) for g in range(30)}
