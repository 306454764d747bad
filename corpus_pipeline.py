"""A corpus pipeline: the stages, in order, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm import decontam, neardup, quality, sentencepiece_fst, suffixes
from meterflow.llm.common import stored, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier scores 0.5 or more."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.quality_column(docs, model)["quality"] >= 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    found = neardup.near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"))
    kept = found.where("kept").select(F.xxhash64("id", "text_hash").alias("__key")).distinct()
    keyed = docs.select("*", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("__key"))
    # a repeated row is a copy too, so one row of each key stays
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 200 bytes that stand elsewhere too."""
    cut = suffixes.remove_repeats(docs, id_column="doc_id", cut_column="__cut")
    kept = F.col("__cut.kept_text")
    changed = {"text": kept, "n_chars": F.length(kept).cast(docs.schema["n_chars"].dataType)}
    return cut.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not contain a benchmark item."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.struct(*docs.columns).alias("row"))
    found = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.where(~F.col("contaminated")).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text back."""
    return sentencepiece_fst.encode(docs.select("doc_id", "text"), MODEL_PATH).drop("text")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokens),
]

#: Training a classifier and a tokenizer's path cannot be said in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
