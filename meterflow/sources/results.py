"""Result tables: metrics, predictions, trials and keyed information."""

from __future__ import annotations

import csv
import time
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.operators.metrics import clamped
from meterflow.operators.reports import label_from_name
from meterflow.operators.resample import ResampleJob, resample
from meterflow.operators.splits import first_rows
from meterflow.schema import TRIALS


def latest_predictions(artifacts: DataFrame, by: str = "algorithm") -> DataFrame:
    """Predictions of the newest run of each algorithm, never below zero.

    Values may stand on the row or inside a ``payload``. An undated run counts as newest.
    """
    age = F.struct(F.col("run_ts").isNull(), "run_ts")
    newest = artifacts.groupBy(F.col(by).alias("_of")).agg(F.max_by("run_ts", age).alias("_at"))
    same = artifacts[by].eqNullSafe(newest["_of"]) & artifacts["run_ts"].eqNullSafe(newest["_at"])
    rows = artifacts.join(newest, same, "left_semi")
    if "payload" in artifacts.columns:
        rows = rows.withColumns({
            c: F.coalesce(F.col(f"payload.{c}"), F.col(c)) for c in ("y_true", "y_pred")
        }).drop("payload")
    return rows.withColumn("y_pred", clamped())


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the values of ``new`` where a key occurs in both, plus the new keys."""
    values = [c for c in new.columns if c not in keys]
    fresh = new.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in values], F.lit(True).alias("_is_new")
    )
    merged = old.join(fresh, list(keys), "full")
    kept = [c for c in old.columns if c not in keys and c not in values]
    return merged.select(
        *keys,
        *kept,
        *[
            F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in old.columns else None)
            .alias(c)
            for c in values
        ],
    )


class ResultsStore:
    """Parquet tables under one folder, appended run by run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, table: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{table}")

    def exists(self, table: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.folder}/{table}")
            return True
        except AnalysisException:
            return False

    def append(self, df: DataFrame, table: str, *partitions: str) -> None:
        df.write.mode("append").partitionBy(*partitions).parquet(f"{self.folder}/{table}")

    def append_fixed(self, df: DataFrame, table: str) -> None:
        """Append to a table whose columns must not change; a mismatch is an error."""
        if self.exists(table):
            have = self.spark.read.parquet(f"{self.folder}/{table}").columns
            if sorted(have) != sorted(df.columns):
                raise ValueError(f"{table} has columns {have}, not {df.columns}")
        self.append(df, table)

    def save_metrics(self, metrics: DataFrame, algorithm: str) -> None:
        """Append metrics of a run; later runs may add columns."""
        stamped = metrics.withColumns(
            {"algorithm": F.lit(algorithm), "timestamp": F.lit(time.time())}
        )
        self.append(stamped, "metrics")

    def save_predictions(self, predictions: DataFrame, algorithm: str, model_name: str) -> None:
        stamped = predictions.withColumns({
            "algorithm": F.lit(algorithm),
            "model_name": F.lit(model_name),
            "run_ts": F.current_timestamp(),
        })
        self.append(stamped, "predictions", "algorithm")

    def predictions(self, models: Sequence[str] | None = None) -> DataFrame:
        """Newest predictions, of all or of the named algorithms; only their folders are read."""
        rows = self.read("predictions")
        return latest_predictions(rows if models is None else rows.where(F.col("algorithm").isin(*models)))

    def save_trials(self, trials: DataFrame) -> None:
        self.append(trials, "trials", "algorithm")

    def save_info(self, info: Mapping[str, str], table: str = "info") -> None:
        """Set keys, over earlier values of the same keys."""
        new = self.spark.createDataFrame(
            [(str(k), str(v)) for k, v in info.items()], "key string, value string"
        )
        self.append(new.withColumn("saved", F.lit(time.time())), table)

    def info(self, table: str = "info") -> DataFrame:
        """The newest value of every key."""
        return self.read(table).groupBy("key").agg(F.max_by("value", "saved").alias("value"))

    def save_run(
        self,
        metrics: DataFrame,
        predictions: DataFrame,
        algorithm: str,
        model_name: str,
        info: Mapping[str, str] | None = None,
        training_log: Mapping[str, str] | None = None,
        comparison: Mapping[str, str] | None = None,
    ) -> None:
        """Everything one run produced."""
        self.save_metrics(metrics, algorithm)
        self.save_predictions(predictions, algorithm, model_name)
        for table, entries in (
            ("info", info), ("training_log", training_log), ("comparison", comparison)
        ):
            if entries:
                self.save_info(entries, table)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_resampled(
    df: DataFrame,
    jobs: Sequence[ResampleJob],
    measures: Sequence[str],
    folder: str,
    raw: bool = False,
    first: int | None = None,
    order: tuple[str, str] = ("timestamp", "event_id"),
) -> list[str]:
    """Write one sorted table per job and, on request, the raw rows and the first rows.

    Every output has a path of its own.
    """
    written = []

    def save(out: DataFrame, name: str) -> None:
        export_csv(out.orderBy(*[c for c in order if c in out.columns]), f"{folder}/{name}")
        written.append(f"{folder}/{name}")

    if raw:
        save(df, "raw")
    if first:
        save(first_rows(df, order, first), "first_rows")
    for job in jobs:
        save(resample(df, job, measures, order[0]), job.table_name)
    return written


def read_trials(spark: SparkSession, path: str, labels: Sequence[tuple[str, str]]) -> DataFrame:
    """Trial logs ``search_iterations_*.csv`` as one table; empty files add nothing.

    The algorithm is the label of the longest marker in the file name, else the file name.
    """
    columns = T.StructType([f for f in TRIALS if f.name != "algorithm"])
    name = F.col("_metadata.file_name")
    return spark.read.csv(
        path, header=True, schema=columns, pathGlobFilter="search_iterations_*.csv",
    ).withColumn("algorithm", label_from_name(name, labels, name))


def read_labelled(
    spark: SparkSession,
    path: str,
    labels: Sequence[tuple[str, str]],
    column: str = "Model",
) -> DataFrame:
    """CSV files of several models as one table, labelled by file name.

    Files may differ in columns: each distinct header is read once and the parts are joined
    by column name.
    """
    files = spark.read.csv(path, header=False, schema="value string", recursiveFileLookup=True,
                           pathGlobFilter="*.csv").inputFiles()
    if not files:
        raise FileNotFoundError(f"no CSV files in {path}")
    heads = spark.read.text(files).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"),
    ).where("at = 0").groupBy("file").agg(F.min_by("value", "place").alias("head")).orderBy("file")
    by_header: dict[tuple[str, ...], list[str]] = {}
    for row in heads.collect():  # one job for all files, one row for each
        if row["head"].strip():
            by_header.setdefault(tuple(next(csv.reader([row["head"]]))), []).append(row["file"])
    merged = None
    for names, group in by_header.items():
        columns = ", ".join(f"`{n}` string" for n in names)
        name = F.col("_metadata.file_path")
        part = spark.read.csv(group, header=True, schema=columns).withColumn(
            column, label_from_name(name, labels, F.col("_metadata.file_name"))
        )
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    return merged
