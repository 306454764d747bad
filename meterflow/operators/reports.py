"""Leaderboards, trial logs and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.constants import MINUTES_PER_TRIAL
from meterflow.operators.series import Layout, Series

def latest_per_group(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each group; a row without a timestamp counts as newest, and the
    largest ``tie`` decides where there are no timestamps.

    An aggregate, not a sort: every task keeps one row per group before the shuffle.
    """
    at = F.col(ts) if ts in df.columns else F.lit(None)
    age = F.struct(at.isNull().alias("undated"), at.alias("at"), F.col(tie).alias("tie"))
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), age).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def largest(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest value; ties go to the smaller id."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).limit(k)


def diverse(df: DataFrame, category: str, key: str, k: int) -> DataFrame:
    """About ``k`` rows spread evenly over categories, at least one of each, cut at ``k``."""
    firsts = df.groupBy(category).agg(F.min(key).alias("_first"))
    layout = Series([category], (key, key)).measure(df, few=True)
    picked = layout.first(df, max(1, k // max(1, firsts.count())))
    return picked.join(firsts, category).orderBy("_first", key).limit(k).drop("_first")


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows chosen by a hash of key and seed: the same rows however data is laid out."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_draw", draw).orderBy("_draw", key).limit(k).drop("_draw")


def mapped(column: str, labels: Mapping[str, str]) -> Column:
    """Display label of a value, the value itself when unmapped."""
    if not labels:
        return F.col(column)
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column))


def leaderboard(
    df: DataFrame,
    labels: Mapping[str, str],
    renames: Mapping[str, str] | None = None,
    digits: int = 4,
    model: str = "Model",
) -> DataFrame:
    """Rounded, labelled table of one row per model, ready to export."""
    numbers = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    out = df.withColumns({c: F.bround(c, digits) for c in numbers})
    out = out.withColumn(model, mapped(model, labels))
    return out.withColumnsRenamed(dict(renames or {}))


def with_defaults(df: DataFrame, defaults: Mapping[str, object], first: Sequence[str]) -> DataFrame:
    """Add missing columns as constants and fix the column order."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    out = df.withColumns(missing) if missing else df
    return out.select(*first, *defaults)


def columns_like(df: DataFrame, words: Sequence[str], always: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains one of ``words``, each once."""
    places = {}
    for i, c in enumerate(df.columns):
        if c in always or any(w in c.lower() for w in words):
            places.setdefault(c, i)  # of a repeated label the first column
    single = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return single.select(*(F.col(f"_{i}").alias(c) for c, i in places.items()))


def trial_summary(trials: DataFrame, by: str = "algorithm") -> DataFrame:
    """Evaluations, epochs and estimated minutes per search algorithm."""
    return trials.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        F.round(F.avg("epochs_trained"), 1).alias("avg_epochs_per_eval"),
        F.sum("epochs_trained").alias("total_epochs"),
        F.round(F.count(F.lit(1)) * MINUTES_PER_TRIAL, 1).alias("estimated_train_time_min"),
    )


def best_epoch(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Epoch of the lowest validation loss, or training loss where none was recorded."""
    def lowest(loss: str) -> Column:
        pair = F.struct(F.col(loss).alias("loss"), F.col("epoch").alias("epoch"))
        return F.min(F.when(F.col(loss).isNotNull(), pair))

    return (
        history.groupBy(*keys).agg(F.coalesce(lowest("val_loss"), lowest("loss")).alias("_best"))
        .select(*keys, F.col("_best.epoch").alias("best_epoch"), F.col("_best.loss").alias("best_loss"))
    )


def best_trial(
    trials: DataFrame, by: Sequence[str] = ("algorithm",), fitness: str = "VAL_RMSE_orig"
) -> DataFrame:
    """The trial with the lowest fitness per group, the earliest of equals.

    A fitness that is null or NaN never wins; a group without any other has no row.
    """
    rest = [c for c in trials.columns if c not in by]
    known = F.col(fitness).isNotNull() & ~F.isnan(fitness)
    rank = F.when(known, F.struct(fitness, "eval_num"))
    return (
        trials.groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("_best")).where("_best IS NOT NULL")
        .select(*by, *[F.col(f"_best.{c}").alias(c) for c in rest])
    )


def convergence(trials: DataFrame, layout: Layout, fitness: str = "VAL_RMSE_orig") -> DataFrame:
    """Best fitness so far after every evaluation."""
    return layout.running(trials, best_so_far=("min", F.col(fitness)))


def improvements(curve: DataFrame, layout: Layout) -> DataFrame:
    """Evaluations at which the best fitness fell."""
    def build(w, pos):
        return {"_before": F.lag("best_so_far").over(w)}

    fell = F.col("_before").isNull() | (F.col("best_so_far") < F.col("_before"))
    return layout.over(curve, build, preceding=1).where(fell).drop("_before")


#: Steps that one row is expanded to at a time; longer gaps are first cut, and the pieces dealt out.
PIECE = 1 << 20


def step_fill(events: DataFrame, series: Series) -> DataFrame:
    """One row per evaluation from improvement events: each holds until the next one.

    A gap is cut into pieces, these are shuffled, and each is expanded where it ends up: no array is
    longer than the pieces of a gap or the steps of a piece, whatever the gap.
    """
    at = series.order[0]
    filled = series.measure(events, few=True).over(
        events, lambda w, pos: {"_next": F.lead(at).over(w)}, following=1
    )
    spans = filled.withColumns({
        "_from": F.col(at).cast("long"), "_to": F.coalesce(F.col("_next") - 1, F.col(at)).cast("long")})
    for size in (PIECE * PIECE, PIECE):
        spans = spans.withColumn("_start", F.explode(F.sequence("_from", "_to", F.lit(size).cast("long"))))
        left = F.least(F.col("_to") - F.col("_start"), F.lit(size - 1))
        spans = spans.withColumns({"_to": F.col("_start") + left, "_from": F.col("_start")})
    dealt = spans.repartition(*series.keys, "_from")
    step = F.explode(F.sequence("_from", "_to"))
    return dealt.withColumn("_step", step).withColumn(at, F.col("_step").cast(events.schema[at].dataType)).select(*events.columns)


def label_from_name(name: Column, labels: Sequence[tuple[str, str]], default: Column) -> Column:
    """Label of the longest marker a file name contains."""
    ordered = sorted(labels, key=lambda pair: -len(pair[0]))
    return reduce(
        lambda found, pair: found.when(name.contains(pair[0]), F.lit(pair[1])), ordered, F
    ).otherwise(default)


def payload_metrics(
    df: DataFrame, payload: str, wanted: Sequence[str] = ("RMSE", "MAE", "MAPE", "R2")
) -> DataFrame:
    """Best validation metrics of a JSON payload as columns.

    A metric is read from ``<name>_orig``, else ``VAL_<name>_orig``; rows with none are dropped.
    """
    keys = [k for name in wanted for k in (f"{name}_orig", f"VAL_{name}_orig")]
    schema = "struct<" + ",".join(f"{k}:double" for k in keys) + ">"
    parsed = df.withColumn("_p", F.from_json(payload, schema))
    out = parsed.withColumns({
        name: F.coalesce(F.col(f"_p.{name}_orig"), F.col(f"_p.VAL_{name}_orig")) for name in wanted
    })
    return out.drop("_p", payload).na.drop("all", subset=list(wanted))


def params_table(df: DataFrame, params: str = "params") -> DataFrame:
    """Columns from a parameter map; the first three are whole numbers."""
    value = F.col(params)
    return df.withColumns({
        "units": value["units"].cast("int"),
        "num_layers": value["num_layers"].cast("int"),
        "seq": value["seq"].cast("int"),
        "learning_rate": value["learning_rate"],
    }).drop(params)
