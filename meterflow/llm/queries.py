"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import os
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from meterflow.llm import (
    ann, classlm, convtrie, decontam, licenses, merkle, neardup, oracle, quality, sentencepiece_fst,
    suffixes, toxicity, urltree, warc,
)
from meterflow.llm.common import table

ROOT = str(Path(__file__).resolve().parents[2])


def importable(build):
    """``build`` with this repository on the path of the Python workers, where it lies there."""
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
        return build(spark, folder)

    return run


QUERIES = {"pipeline": importable(corpus_pipeline.run)}
SQL = {
    "op2_near_duplicates": oracle.NEAR_DUPLICATES,
    "op7_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op12_merkle_manifest": oracle.MERKLE,
    "op13_conversation_trie": oracle.CONVERSATION_TRIE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def query(build):
    QUERIES[build.__name__] = importable(build)
    return build


@query
def op1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return ann.search(ann.build_index(vectors), vectors.where(F.col("id") % 100 == 0))


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are similar at 0.8 or more."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    found = neardup.near_duplicates(documents, width=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by both views and their combination."""
    documents = table(spark, folder, "documents")
    model = quality.learn(documents, table(spark, folder, "labels"))
    scored = quality.score(documents.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return scored.select("doc_id", "quality", "content_score", "metadata_score",
                         F.when(F.col("quality") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that each document contains."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    found = decontam.contamination(documents, table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


#: A public BPE model with byte fallback; any other path may be given to the operator.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return sentencepiece_fst.encode(documents, MODEL_PATH).drop("text")


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return warc.build_derivatives(warc.responses(pages), keep=("page_id",))


@query
def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 200-byte strings that stand elsewhere too."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    found = suffixes.remove_repeats(documents, texts_too=False)
    return found.select(F.col("id").alias("doc_id"), *(
        F.col(f"cut.{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document; rows with crc32 of the id divisible by 5 teach nothing."""
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    held_out = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), "toxic")
    lexicon = toxicity.learn(documents, labels.where(~held_out))
    scored = toxicity.score(documents, lexicon)
    return scored.select(
        F.col("id").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


#: The rules of the query's contract.
URL_RULES = (
    urltree.Rule("allow", "org", "/"),
    urltree.Rule("block", "example.org", "/es/"),
    urltree.Rule("block", "example.org", "/en/1"),
    urltree.Rule("allow", "com", "/fr/"),
    urltree.Rule("block", "com", "/de/"),
)


@query
def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page; the labels of its number tell good pages from bad."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1.0).when(
        F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0.0)
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), bad.alias("bad"))
    return urltree.judge_urls(table(spark, folder, "pages"), labels, URL_RULES)


@query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License of every document; its source and language stand for its directories."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    files = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return licenses.scan(files).withColumnRenamed("id", "doc_id")


def crc_of(column: str) -> Column:
    """Unsigned CRC-32 of a number in decimal."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


@query
def op11_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document; rows with crc32 of the id 2 modulo 7 teach nothing."""
    held_out = F.coalesce(crc_of("doc_id") % 7 == 2, F.lit(False))
    documents = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = classlm.learn(documents.select("text", (~F.col("held_out")).alias("learns")))
    scored = classlm.score(documents, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score", classlm.perplexity().alias("perplexity"))


@query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Digest tree of all documents by source, every row's proof, and what tampering does to it."""
    rows = merkle.manifest(
        table(spark, folder, "documents"), where=crc_of("doc_id") % 2 == 0,
        tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    return merkle.proofs(rows).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Prefix trie of the conversations, each forked from the first of its five."""
    turns = convtrie.numbered(table(spark, folder, "conversations"))
    return convtrie.trie(*convtrie.forked(turns, F.expr("conv_id - conv_id % 5"), crc_of("conv_id") % 9, most_shared=8))
