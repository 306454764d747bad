"""Error metrics, error distributions and model comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.operators import selection
from meterflow.session import stored

METRICS = ("MSE", "RMSE", "MAE", "MAPE", "MAPE_abs1", "MAPE_clipped", "R2", "RMSLE")


def metric_columns(y: str = "y_true", p: str = "y_pred") -> list[Column]:
    """Every metric as an aggregate, so one pass serves all of them.

    ``MAPE`` uses rows with a non-zero truth, ``MAPE_abs1`` rows with an absolute truth
    above 1 (infinity when no row qualifies), ``MAPE_clipped`` a denominator of at least
    1e-9. ``R2`` is 0 for a constant truth.
    """
    truth, guess = F.col(y), F.col(p)
    error = guess - truth
    squared = error * error
    mse = F.avg(squared)

    def percentage(rows: Column) -> Column:
        share = F.abs(F.try_divide(error, truth))
        return F.coalesce(100 * F.avg(F.when(rows, share)), F.lit(math.inf))

    spread = F.var_pop(truth)
    logs = F.log1p(F.greatest(guess, F.lit(0.0))) - F.log1p(F.greatest(truth, F.lit(0.0)))
    return [
        F.count(F.lit(1)).alias("n"),
        mse.alias("MSE"),
        F.sqrt(mse).alias("RMSE"),
        F.avg(F.abs(error)).alias("MAE"),
        percentage(truth != 0).alias("MAPE"),
        percentage(F.abs(truth) > 1).alias("MAPE_abs1"),
        (100 * F.avg(F.abs(error / F.greatest(truth, F.lit(1e-9))))).alias("MAPE_clipped"),
        F.when(spread > 0, 1 - mse / F.nullif(spread, F.lit(0.0))).otherwise(0.0).alias("R2"),
        F.sqrt(F.avg(logs * logs)).alias("RMSLE"),
        F.min(truth).alias("y_min"), F.max(truth).alias("y_max"),
        F.min(guess).alias("p_min"), F.max(guess).alias("p_max"),
    ]


def metrics(
    df: DataFrame, by: Sequence[str] = ("model",), y: str = "y_true", p: str = "y_pred"
) -> DataFrame:
    """All metrics per group."""
    return df.groupBy(*by).agg(*metric_columns(y, p))


def clamped(column: str = "y_pred") -> Column:
    """Predictions below zero count as zero."""
    return F.greatest(F.col(column), F.lit(0.0))


def error_boxes(df: DataFrame, by: str = "model", rows_per_chunk: int | None = None) -> DataFrame:
    """Box-plot numbers of the absolute error: quartiles and whiskers inside 1.5 IQR.

    The errors are written once; quartiles are found by counting them, whiskers in one more pass.
    No more than ``rows_per_chunk`` rows are ever counted value by value.
    """
    errors = stored(df.select(by, F.abs(F.col("y_true") - F.col("y_pred")).alias("abs_error")))
    boxes = selection.quantiles(errors, [by], "abs_error", {"q1": 0.25, "median": 0.5, "q3": 0.75},
                                rows_per_chunk or selection.FEW)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    error = F.col("abs_error")
    inside = error.between(F.col("q1") - reach, F.col("q3") + reach)
    boxes = boxes.withColumnRenamed(by, "_of")
    return errors.join(boxes, errors[by].eqNullSafe(boxes["_of"])).groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, error)).alias("whisker_low"),
        F.max(F.when(inside, error)).alias("whisker_high"),
    )


def anova(df: DataFrame, by: str = "model", value: str = "abs_error") -> DataFrame:
    """One-way analysis of variance: F and its degrees of freedom, from group moments."""
    groups = df.groupBy(by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")
    )
    n, mean = F.col("n"), F.col("mean")
    total = F.sum(n)
    between = F.sum(n * mean * mean) - F.sum(n * mean) * F.sum(n * mean) / total
    within = F.sum(n * F.col("var"))
    df1, df2 = F.count(F.lit(1)) - 1, total - F.count(F.lit(1))
    return groups.agg(
        F.try_divide(F.try_divide(between, df1), F.try_divide(within, df2)).alias("f"), df1.alias("df1"), df2.alias("df2")
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every two measures, one row per pair, from one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r"))
        for a, b in pairs
    ])
    return wide.select(F.explode(cells).alias("_c")).select("_c.a", "_c.b", "_c.r")


def scatter_bins(df: DataFrame, width: float, by: str = "model") -> DataFrame:
    """Counts of (truth, prediction) per square of the given width."""
    return df.groupBy(
        by,
        F.floor(F.col("y_true") / width).alias("y_bin"),
        F.floor(F.col("y_pred") / width).alias("p_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))
