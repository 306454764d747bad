import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import ann

SCHEMA = "id long, vector array<float>, shard long, node string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)


def nearest(rows, query, k):
    """Brute force over distinct usable rows."""
    own = dict(rows)[query]
    found = sorted({(float(np.sqrt(((np.float32(v).astype(float) - np.float32(own).astype(float)) ** 2).sum())), i)
                    for i, v in rows if i != query})
    return [(i, d) for d, i in found[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    df = frame(spark, rows)
    index = ann.build_index(df, shard_rows=400)
    assert index.select(F.explode("ids")).distinct().count() == 1500  # every row is indexed
    found = {}
    for r in ann.search(index, df.where("id % 20 = 0"), block_rows=30).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for query, got in found.items():
        want = nearest(rows, query, 10)
        assert sorted(got) == list(range(1, 11))
        scores = [got[r][1] for r in range(1, 11)]
        assert scores == sorted(scores)
        assert query not in {i for i, _ in got.values()}
        hits += len({i for i, _ in want} & {i for i, _ in got.values()})
    assert len(found) == 75 and hits / 750 >= 0.95


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]),
            (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]),
            (9, [1.0, None]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = frame(spark, rows)
    got = ann.search(ann.build_index(df), df, k=10).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert found == {
        (0, 1): (1, 0.0), (0, 2): (2, 0.0), (0, 3): (3, pytest.approx(5**0.5)),
        (1, 1): (0, 0.0), (1, 2): (2, 0.0), (1, 3): (3, pytest.approx(5**0.5)),
        (2, 1): (0, 0.0), (2, 2): (1, 0.0), (2, 3): (3, pytest.approx(5**0.5)),
        (3, 1): (0, pytest.approx(5**0.5)), (3, 2): (1, pytest.approx(5**0.5)), (3, 3): (2, pytest.approx(5**0.5))}


def test_frequent_vector_keeps_smallest_ids(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(1000 + i, [float(i + 2), 5.0]) for i in range(50)]
    df = frame(spark, rows)
    got = ann.search(ann.build_index(df, shard_rows=64), df.where("id in (7, 1000)"), k=5).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(found[7])] == [0, 1, 2, 3, 4]


def test_empty(spark):
    df = frame(spark, [])
    assert ann.search(ann.build_index(df), df).count() == 0
