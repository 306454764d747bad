"""Parameter search: every candidate is one Spark fit over the whole windowed table.

The driver holds a declared list of candidates of four numbers; what costs, windowing,
fitting and scoring, runs on the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.constants import FAILED_TRIAL_FITNESS
from meterflow.functions.scalars import decode_params
from meterflow.operators.metrics import metric_columns
from meterflow.operators.models import Scored, boosted, fit_and_score, score
from meterflow.operators.scaling import ColumnStats
from meterflow.schema import TRIALS

Windowing = Callable[[int], DataFrame]
LOGGED = ("MSE", "RMSE", "MAE", "MAPE", "R2")


@dataclass(frozen=True)
class Params:
    """Parameters of the sequence forecaster and what they mean for boosted trees: histogram
    bins, tree depth, window length and step size."""

    units: int
    num_layers: int
    seq: int
    learning_rate: float


@dataclass(frozen=True)
class Objective:
    """Scores a candidate by its validation error on the original scale.

    ``windowing`` turns a window length into rows of ``split``, ``y`` and ``features``.
    """

    windowing: Windowing
    stats: ColumnStats
    epochs: int = 20

    def estimator(self, params: Params):
        return boosted(self.epochs, params.num_layers, params.units, params.learning_rate,
                       validation="_held_out")

    def evaluate(self, params: Params) -> dict:
        """One trial row; a candidate whose windows leave nothing to fit scores badly."""
        failed = {"VAL_RMSE_orig": FAILED_TRIAL_FITNESS, **vars(params)}
        rows = self.windowing(params.seq).withColumn("_held_out", F.col("split") == "val").persist()
        try:
            model = self.estimator(params).fit(rows.where(F.col("split").isin("train", "val")))
            scored = score(model, rows.where(F.col("split") == "val"), self.stats, clamp=False)
            both = scored.agg(
                F.struct(*metric_columns("y", "prediction")).alias("scaled"),
                F.struct(*metric_columns()).alias("orig"),
            ).first()
        except Exception:
            if rows.where("split = 'train'").isEmpty():
                return failed
            raise
        finally:
            rows.unpersist()
        if not both["orig"]["n"]:
            return failed
        found = {f"VAL_{m}_scaled": both["scaled"][m] for m in LOGGED}
        found |= {f"VAL_{m}_orig": both["orig"][m] for m in LOGGED if m != "MSE"}
        return {**vars(params), **found, "epochs_trained": model.getNumTrees}

    def refit(self, params: Params, name: str) -> Scored:
        """Fit the best candidate on train and validation rows and score it on test rows."""
        rows = self.windowing(params.seq)
        rows = rows.withColumn("_held_out", F.col("split") == "val")
        return fit_and_score(self.estimator(params), rows, self.stats, name)


def trial_table(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Trial log rows as a table with the declared columns."""
    return spark.createDataFrame([tuple(r.get(n) for n in TRIALS.names) for r in rows], TRIALS)


def candidates(vectors: DataFrame, vector: str = "x") -> DataFrame:
    """Distinct parameters that a table of vectors in the unit cube stands for."""
    return vectors.select(*(
        c.alias(name) for name, c in decode_params(F.col(vector)).items())).distinct()


def score_candidates(
    spark: SparkSession,
    evaluate: Callable[[Params], dict],
    table: DataFrame,
    algorithm: str = "grid",
    parallelism: int = 1,
    log: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """The trial of every candidate of ``table``, in the order of their parameters.

    Each candidate is a fit over the whole windowed table, so their list is short beside the
    work it stands for; ``parallelism`` of them are fitted at a time, as jobs of one session.
    ``log`` receives the trials at the end.
    """
    evaluate = inheritable_thread_target(spark)(evaluate)
    names = ("units", "num_layers", "seq", "learning_rate")
    listed = [Params(*row) for row in table.select(*names).orderBy(*names).collect()]
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(evaluate, listed))
    stamp = datetime.now(timezone.utc).replace(tzinfo=None)
    trials = trial_table(spark, [
        {**trial, "algorithm": algorithm, "eval_num": i, "timestamp": stamp} for i, trial in enumerate(found, 1)])
    if log:
        log(trials)
    return trials
