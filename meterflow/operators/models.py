"""Forecast models on Spark ML: fit, score, restore the scale, measure."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.operators.forest import Forest, ForestModel
from meterflow.operators.metrics import clamped, metric_columns
from meterflow.operators.scaling import ColumnStats


def one_feature_fit(df: DataFrame, by: str, target: str, feature: str) -> DataFrame:
    """Least-squares line per group, as one aggregation."""
    return df.groupBy(by).agg(
        F.regr_slope(target, feature).alias("slope"),
        F.regr_intercept(target, feature).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def assembled(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("split", "y")) -> DataFrame:
    """Feature columns in name order as one vector."""
    vectors = VectorAssembler(inputCols=sorted(features), outputCol="features", handleInvalid="error")
    return vectors.transform(df).select(*keep, "features")


def window_vector(window: str = "x") -> Column:
    """A flat window array as a feature vector."""
    return array_to_vector(F.col(window))


def linear() -> LinearRegression:
    """Ordinary least squares with intercept."""
    return LinearRegression(labelCol="y", fitIntercept=True)


def robust_linear(regularization: float = 1e-3, tolerance: float = 1e-4) -> LinearRegression:
    """Linear fit whose loss grows linearly for large errors."""
    return LinearRegression(
        labelCol="y", loss="huber", regParam=regularization, maxIter=100, tol=tolerance
    )


def forest(trees: int = 100, depth: int = 30, seed: int = 0) -> Forest:
    """Random forest over square-root feature subsets. Trees stop at depth 30."""
    return Forest(trees, min(depth, 30), seed)


def boosted(
    iterations: int = 20, depth: int = 3, bins: int = 64, step: float = 0.1,
    tolerance: float = 0.01, validation: str | None = None, seed: int = 0,
) -> GBTRegressor:
    """Boosted trees; with a ``validation`` column, stops once its loss no longer falls."""
    model = GBTRegressor(
        labelCol="y", maxIter=iterations, maxDepth=depth, maxBins=bins, stepSize=step, seed=seed,
        validationTol=tolerance,
    )
    return model.setValidationIndicatorCol(validation) if validation else model


def vector_size(df: DataFrame, column: str = "features") -> int:
    """Length of a vector column, from its metadata where an assembler left it there."""
    known = df.schema[column].metadata.get("ml_attr", {}).get("num_attrs")
    return known or df.select(F.size(vector_to_array(column))).first()[0]


def fourier_features(
    df: DataFrame, count: int = 100, gamma: float | None = None, seed: int = 42
) -> DataFrame:
    """Random Fourier features of the radial kernel (Rahimi and Recht, 2007).

    A linear fit on ``sqrt(2 / D) cos(w x + b)`` approaches a fit with the kernel
    ``exp(-gamma |x - z|^2)``. The default gamma is 1 / (features x their variance), from
    the training rows. A matrix product per Arrow batch is far cheaper here than nested array
    expressions; the matrix travels with the function.
    """
    size = vector_size(df)
    if gamma is None:
        vector = vector_to_array("features")
        total = lambda f: F.sum(F.aggregate(vector, F.lit(0.0), lambda a, x: a + f(x)))
        sums = df.where("split = 'train'").agg(
            total(lambda x: x), total(lambda x: x * x), F.sum(F.size(vector))).first()
        spread = (sums[1] / sums[2] - (sums[0] / sums[2]) ** 2 if sums[2] else 0.0) or 1.0
        gamma = 1.0 / (size * spread)
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, math.sqrt(2 * gamma), (size, count))
    phases = rng.uniform(0.0, 2 * math.pi, count)

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="object")
        waves = np.cos(np.stack(vectors.to_numpy()) @ directions + phases)
        return pd.Series(list(math.sqrt(2.0 / count) * waves))

    return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


@dataclass(frozen=True)
class Scored:
    """A fitted model, its predictions on the original scale and its metrics."""

    model: Model | ForestModel
    predictions: DataFrame
    metrics: DataFrame


def score(model: Transformer | ForestModel, rows: DataFrame, stats: ColumnStats, clamp: bool = True) -> DataFrame:
    """Predictions and truth on the original scale; negative predictions count as zero."""
    out = model.transform(rows).withColumns({
        "y_true": stats.restored("y"), "y_pred": stats.restored("y", F.col("prediction")),
    })
    return out.withColumn("y_pred", clamped()) if clamp else out


def fit_and_score(
    estimator: Estimator | Forest,
    rows: DataFrame,
    stats: ColumnStats,
    name: str,
    train: Sequence[str] = ("train", "val"),
    test: str = "test",
) -> Scored:
    """Fit on some parts of ``rows`` (columns ``split``, ``y``, ``features``), score another.

    The estimators keep the training rows themselves for the passes of a fit.
    """
    model = estimator.fit(rows.where(F.col("split").isin(*train)))
    predictions = score(model, rows.where(F.col("split") == test), stats)
    metrics = predictions.agg(*metric_columns()).withColumn("model", F.lit(name))
    return Scored(model, predictions.drop("features"), metrics)


def importance(model: Model, features: Sequence[str], df: DataFrame, top: int | None = 10) -> DataFrame:
    """Features with the largest absolute coefficient; all of them without ``top``."""
    names = sorted(features)
    rows = [(i, names[i], float(c)) for i, c in enumerate(model.coefficients.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature_index int, feature string, coefficient double")
    ranked = table.withColumn("importance", F.abs("coefficient")).orderBy(F.col("importance").desc(), "feature_index")
    return ranked if top is None else ranked.limit(top)


def training_info(scored: Scored, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: rows of each part, number of features, intercept and metrics of a linear fit."""
    parts = [F.count_if(F.col("split") == p).alias(f"{p}_rows") for p in ("train", "val", "test")]
    counts = rows.agg(*parts).withColumns({
        "n_features": F.lit(len(features)), "intercept": F.lit(float(scored.model.intercept))})
    return counts.join(scored.metrics)


def save_model(model: Model | ForestModel, path: str) -> None:
    (model if isinstance(model, ForestModel) else model.write().overwrite()).save(path)


def load_model(kind: type[Model | ForestModel], path: str) -> Model | ForestModel:
    return kind.load(path)
