"""Linear least squares from cross products: one pass over the rows, whatever their number.

Imputation by the mean and min-max scaling are linear in (value or 0, is missing, 1). So the sums of
products of these columns, taken per part of the data in one partial aggregate, hold everything a fit
needs: means and ranges of the training part, the normal equations of the imputed and scaled features,
and the solution, which is a matter of one small matrix. Tasks add up matrix products of Arrow
batches; one row per task, part and matrix cell is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.operators.scaling import ColumnStats

#: A column whose rest after all earlier columns is no larger a share of it depends on them.
DEPENDENT = 1e-9


@dataclass(frozen=True)
class Moments:
    """Sums of products over one part: of 1, the values, their gaps and the plain columns, in this
    order, and least and greatest values."""

    columns: tuple[str, ...]
    plain: tuple[str, ...]
    products: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def stats(self) -> ColumnStats:
        """Mean, least and greatest value of the columns with gaps; 0 for a column of gaps only."""
        k, n = len(self.columns), self.products[0, 0]
        seen = n - self.products[0, 1 + k:1 + 2 * k]
        with np.errstate(invalid="ignore"):
            mean = np.where(seen > 0, self.products[0, 1:1 + k] / np.maximum(seen, 1), 0.0)
        low, high = (np.where(seen > 0, side, 0.0) for side in (self.low, self.high))
        return ColumnStats(*(dict(zip(self.columns, map(float, side))) for side in (mean, low, high)))


def moments(frame: DataFrame, columns: Sequence[str], plain: Sequence[str], part: str = "split") -> dict[str, Moments]:
    """``Moments`` of every part of ``frame``. ``columns`` may have gaps, ``plain`` columns may not."""
    k, size = len(columns), 1 + 2 * len(columns) + len(plain)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), dtype=object)
            wide = np.empty((batch.num_rows, size))
            wide[:, 0] = 1.0
            for i in range(k):
                values = batch.column(1 + i)
                wide[:, 1 + k + i] = values.is_null().to_numpy(zero_copy_only=False)
                wide[:, 1 + i] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
            for i in range(len(plain)):
                wide[:, 1 + 2 * k + i] = batch.column(1 + k + i).to_numpy(zero_copy_only=False)
            for name in set(parts):
                rows = wide[parts == name]
                gaps = rows[:, 1 + k:1 + 2 * k] > 0
                values = rows[:, 1:1 + k]
                low = np.where(gaps, np.inf, values).min(0, initial=np.inf)
                high = np.where(gaps, -np.inf, values).max(0, initial=-np.inf)
                if name in found:
                    old = found[name]
                    found[name] = (old[0] + rows.T @ rows, np.minimum(old[1], low), np.maximum(old[2], high))
                else:
                    found[name] = (rows.T @ rows, low, high)
        cells = size * size
        for name, (products, low, high) in found.items():
            value = np.concatenate([products.ravel(), np.zeros(2 * k)])
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(value), pa.string()), pa.array(np.arange(len(value)), pa.int64()), pa.array(value),
                pa.array(np.concatenate([np.zeros(cells), low, high]))], ["part", "cell", "total", "edge"])

    slim = frame.select(F.col(part).cast("string").alias("part"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*columns, *plain])))
    partial = slim.mapInArrow(sums, "part string, cell long, total double, edge double")
    rows = partial.groupBy("part", "cell").agg(
        F.sum("total").alias("total"), F.min("edge").alias("low"), F.max("edge").alias("high")).collect()
    cells, out = size * size, {}
    for name in {r.part for r in rows}:
        value, edge = np.zeros(cells + 2 * k), np.zeros(2 * k)
        for r in rows:
            if r.part == name:
                value[r.cell] = r.total
                if r.cell >= cells:
                    edge[r.cell - cells] = r.low if r.cell < cells + k else r.high
        out[name] = Moments(tuple(columns), tuple(plain), value[:cells].reshape(size, size), edge[:k], edge[k:])
    return out


def solved(products: np.ndarray) -> np.ndarray:
    """Least-squares weights of the first columns for the last one, from their cross products.

    Columns are taken one by one; one that depends on earlier ones weighs 0.
    """
    left, size = products.astype(float).copy(), len(products) - 1
    weights, used = np.zeros(size), []
    for k in range(size):
        if left[k, k] <= DEPENDENT * products[k, k]:
            continue
        used.append(k)
        others = np.arange(size + 1) != k
        left[others] -= np.outer(left[others, k] / left[k, k], left[k])
    weights[used] = left[used, size] / left[used, used]
    return weights


@dataclass(frozen=True)
class LinearFit:
    """A linear function of scaled features, by name in ascending order."""

    features: tuple[str, ...]
    coefficients: DenseVector
    intercept: float

    def predicted(self) -> Column:
        """The prediction as a projection over scaled columns."""
        out = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients.toArray()):
            if weight:
                out = out + F.col(name) * F.lit(float(weight))
        return out


def fit_linear(
    frame: DataFrame, numeric: Sequence[str], plain: Sequence[str], target: str = "y",
    scale_on: str = "train", train: Sequence[str] = ("train", "val"), part: str = "split",
) -> tuple[LinearFit, ColumnStats]:
    """Ordinary least squares with intercept over the parts ``train``, and the statistics of the part
    ``scale_on`` by which ``numeric`` and the target are imputed and scaled; one pass for both.

    Raises ValueError on NaN or infinity, which no fit can use.
    """
    columns = [*numeric, target]
    found = moments(frame, columns, plain, part)
    size = 1 + 2 * len(columns) + len(plain)
    empty = Moments(tuple(columns), tuple(plain), np.zeros((size, size)), np.zeros(len(columns)), np.zeros(len(columns)))
    stats = found.get(scale_on, empty).stats()
    products = sum((found[p].products for p in train if p in found), np.zeros((size, size)))
    if not np.isfinite(products).all():
        raise ValueError("features or target hold NaN or infinity")
    # rows: the intercept, the features by name, the target; columns as in the products
    k, features = len(columns), sorted([*numeric, *plain])
    to = np.zeros((len(features) + 2, size))
    to[0, 0] = 1.0
    for row, name in enumerate([*features, target], 1):
        if name in columns:
            at, span = columns.index(name), (stats.high[name] - stats.low[name]) or 1.0
            to[row, [1 + at, 1 + k + at, 0]] = np.array([1.0, stats.mean[name], -stats.low[name]]) / span
        else:
            to[row, 1 + 2 * k + list(plain).index(name)] = 1.0
    weights = solved(to @ products @ to.T)
    return LinearFit(tuple(features), DenseVector(weights[1:]), float(weights[0])), stats
