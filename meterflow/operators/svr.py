"""Linear support vector regression: the epsilon-insensitive loss, fitted by passes over the rows.

The objective is ``|v|^2 / 2 + C * sum(max(0, |y - x v| - epsilon))`` with the intercept as one more
weight of a constant feature, regularised like the others. Corners of the loss are rounded by a
softplus of width ``delta``, which adds at most ``2 ln 2 * delta`` a row; Newton steps solve the rounded
problem, and ``delta`` falls by four until that is a small share of the objective. Each pass is one
partial aggregate: tasks add up loss, gradient and curvature of Arrow batches, or the losses of eight
step lengths, and what reaches the driver has the size of the square of the number of features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.session import stored

STEPS = 0.5 ** np.arange(8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass(frozen=True)
class Loss:
    """The loss of residuals and its rounded form."""

    epsilon: float
    delta: float

    def exact(self, r: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(r) - self.epsilon, 0)

    def smooth(self, r: np.ndarray) -> np.ndarray:
        return self.delta * (np.logaddexp(0, (r - self.epsilon) / self.delta) + np.logaddexp(0, (-r - self.epsilon) / self.delta))

    def slopes(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = _sigmoid((r - self.epsilon) / self.delta), _sigmoid((-r - self.epsilon) / self.delta)
        return up - down, (up * (1 - up) + down * (1 - down)) / self.delta


def _summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of the ``size`` numbers that ``of`` makes of a batch (features with 1, target)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            n = batch.num_rows
            if n:
                x = np.ones((n, len(batch.column(0).flatten()) // n + 1))
                x[:, :-1] = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                total += of(x, batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["cell", "total"])

    found = np.zeros(size)
    for cell, total in rows.mapInArrow(add, "cell long, total double").groupBy("cell").agg(F.sum("total")).collect():
        found[cell] = total
    return found


@dataclass(frozen=True)
class SupportVectorFit:
    """Weights of the features, intercept, objective and passes over the rows."""

    coefficients: DenseVector
    intercept: float
    objective: float
    passes: int

    def predicted(self, features: str = "features") -> Column:
        weights = F.array(*[F.lit(float(w)) for w in self.coefficients.toArray()])
        products = F.zip_with(vector_to_array(features), weights, lambda a, b: a * b)
        return F.aggregate(products, F.lit(self.intercept), lambda total, p: total + p)


def linear_svr(
    rows: DataFrame, c: float = 1.0, epsilon: float = 0.0, tolerance: float = 1e-3, max_passes: int = 200,
) -> SupportVectorFit:
    """Fit ``y`` on the vector ``features``; the objective is within about ``tolerance`` of the least.

    Rows are written once as arrays and read in every pass. No rows give weights of 0.
    """
    table = stored(rows.select(vector_to_array("features").alias("x"), F.col("y").cast("double").alias("y")))
    first = table.select(F.size("x")).first()
    width = (first[0] if first else 0) + 1
    v, passes = np.zeros(width), 1
    n, total = _summed(table, lambda x, y: np.array([len(y), Loss(epsilon, 1.0).exact(y).sum()]), 2)
    if not total:  # nothing lies outside the tube around 0
        return SupportVectorFit(DenseVector(v[:-1]), 0.0, 0.0, passes)
    loss = Loss(epsilon, total / n)
    best = (c * total, v)
    while passes < max_passes:
        def at(x, y, v=v, loss=loss):
            r = y - x @ v
            slope, curve = loss.slopes(r)
            return np.concatenate([[loss.smooth(r).sum()], x.T @ slope, ((x * curve[:, None]).T @ x).ravel()])

        sums = _summed(table, at, 1 + width + width * width)
        gradient = v - c * sums[1:1 + width]
        step = -np.linalg.solve(np.eye(width) + c * sums[1 + width:].reshape(width, width), gradient)
        tried = v + STEPS[:, None] * step
        both = _summed(table, lambda x, y, tried=tried, loss=loss: np.concatenate(
            [f(y[:, None] - x @ tried.T).sum(0) for f in (loss.smooth, loss.exact)]), 2 * len(STEPS))
        passes += 2
        smooth, exact = (0.5 * (tried**2).sum(1) + c * part for part in both.reshape(2, -1))
        least = int(exact.argmin())
        best = min(best, (float(exact[least]), tried[least]), key=lambda b: b[0])
        now, then = 0.5 * v @ v + c * sums[0], float(smooth.min())
        if then < now:
            v = tried[int(smooth.argmin())]
        if now - then <= tolerance / 4 * best[0]:
            if 2 * np.log(2) * loss.delta * n * c <= tolerance * best[0]:
                break
            loss = Loss(epsilon, loss.delta / 4)
    return SupportVectorFit(DenseVector(best[1][:-1]), float(best[1][-1]), best[0], passes)
