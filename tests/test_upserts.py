"""Keyed tables: merged values, and buckets that are left alone."""

import hashlib

import pytest
from pyspark.sql import functions as F

from meterflow.sources.upserts import KeyedTable


def files(folder):
    return {str(p): (p.stat().st_mtime_ns, hashlib.sha256(p.read_bytes()).hexdigest()) for p in folder.rglob("*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    place = tmp_path / "table"
    table = KeyedTable(spark, str(place), ["k"], buckets=8)
    assert len(table.upsert(spark.range(100).select(F.col("id").alias("k"), F.lit(1.0).alias("v"), F.lit("old").alias("w")))) == 8
    before = files(place)
    new = spark.createDataFrame([(5, 2.0), (1000, 3.0)], "k long, v double")
    touched = table.upsert(new)
    after = files(place)
    gone, kept = set(before) - set(after), set(before) & set(after)
    assert {p.split("_bucket=")[1].split("/")[0] for p in gone} <= {str(b) for b in touched} and len(touched) <= 2
    assert len(kept) >= 6 and all(before[p] == after[p] for p in kept)
    got = {r.k: (r.v, r.w) for r in table.read().collect()}
    assert got == {**{k: (1.0, "old") for k in range(100)}, 5: (2.0, "old"), 1000: (3.0, None)}


def test_new_columns_and_two_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), ["a", "b"], buckets=3)
    table.upsert(spark.createDataFrame([("x", 1, 1.0), ("y", 1, 2.0)], "a string, b long, v double"))
    table.upsert(spark.createDataFrame([("x", 1, "n"), ("x", 2, "m")], "a string, b long, w string"))
    got = {(r.a, r.b): (r.v, r.w) for r in table.read().collect()}
    assert got == {("x", 1): (1.0, "n"), ("y", 1): (2.0, None), ("x", 2): (None, "m")}


def test_ambiguous_keys_are_refused(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "table"), ["k"])
    for rows in ([(1, 1.0), (1, 2.0)], [(None, 1.0)]):
        with pytest.raises(ValueError):
            table.upsert(spark.createDataFrame(rows, "k long, v double"))
    assert not table.exists()
    assert table.upsert(spark.createDataFrame([], "k long, v double")) == []
