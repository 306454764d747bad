"""Functions of whole vectors that built-in expressions do not cover."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def rowwise(function: Callable[[np.ndarray], np.ndarray]):
    """A column function from one for arrays of shape (rows, dimension).

    Arrow hands over many rows per call, so ``function`` should work on all of them at once.
    """

    @F.pandas_udf("double")
    def apply(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="float64")
        return pd.Series(function(np.stack(vectors.to_numpy())))

    return apply
