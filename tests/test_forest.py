"""The forest: cuts, draws, tops and what tasks grow below them."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meterflow.operators import forest, models
from meterflow.operators.scaling import ColumnStats

STATS = ColumnStats({"y": 0.0}, {"y": 0.0}, {"y": 1.0})


def table(spark, n: int):
    """Whole-number targets, so that sums are exact in any order."""
    x = F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(m)).cast("double") for i, m in enumerate((2, 7, 24, 1000, 1000))])
    y = (10 * x[1] + F.floor(x[3] / 50) + F.pmod(F.xxhash64("id"), F.lit(9))).cast("double")
    part = F.expr("elt(id % 3 + 1, 'train', 'val', 'test')")
    return spark.range(n).select("id", part.alias("split"), y.alias("y"), array_to_vector(x).alias("features"))


def best_cut(codes, w, y, features):
    """By trying all."""
    best = (0.0, -1, -1)
    for f in features:
        for cut in np.unique(codes[:, f])[:-1]:
            left = codes[:, f] <= cut
            a, b = w[left].sum(), w[~left].sum()
            gain = a * b / (a + b) * ((w * y)[left].sum() / a - (w * y)[~left].sum() / b) ** 2
            if gain > best[0]:
                best = gain, f, cut
    return best


@pytest.mark.parametrize("rows", [2, 3, 7, 16, 17, 200])
def test_cuts_equal_those_of_trying_all(rows):
    rng = np.random.default_rng(rows)
    sizes, starts = np.array([rows, rows]), np.array([0, rows])
    codes = rng.integers(0, 32, (2 * rows, 9)).astype(np.uint8)
    w, y = rng.integers(1, 4, 2 * rows).astype(float), rng.integers(0, 50, 2 * rows).astype(float)
    features = np.array([[0, 3, 8], [1, 2, 4]])
    large = forest.cuts_of_large(codes, w, w * y, sizes, starts, features, 32)
    made = [large, forest.cuts_of_small(codes, w, w * y, sizes, starts, features, 16)] if rows <= 16 else [large]
    for gain, feature, cut in made:
        for i in (0, 1):
            at = slice(i * rows, (i + 1) * rows)
            assert (gain[i], feature[i], cut[i]) == pytest.approx(best_cut(codes[at], w[at], y[at], features[i]))


def test_draws_are_poisson():
    keys = forest.mixed(np.arange(200_000, dtype=np.uint64))
    copies = np.repeat([1, 5], 100_000)
    drawn = forest.draws(keys, copies, 3)
    for mean in (1, 5):
        assert drawn[copies == mean].mean() == pytest.approx(mean, rel=0.02)
        assert drawn[copies == mean].var() == pytest.approx(mean, rel=0.03)
    assert np.corrcoef(drawn, forest.draws(keys, copies, 4))[0, 1] < 0.99
    assert forest.draws(keys[:1], np.array([10**6]), 0)[0] == pytest.approx(10**6, rel=0.01)


def test_deep_tree_holds_the_mean_of_every_bin(spark):
    df = spark.range(600).selectExpr("double(id % 30) AS a", "double(id % 7) AS y").select(
        "y", array_to_vector(F.array("a")).alias("features"))
    model = forest.Forest(trees=1, task_rows=20).fit(df)
    means = {float(r.a): r.y for r in spark.range(600).groupBy((F.col("id") % 30).alias("a")).agg(F.avg(F.col("id") % 7).alias("y")).collect()}
    got = model.transform(df).collect()
    assert len(got) == 600 and all(r.prediction == pytest.approx(means[r.features[0]]) for r in got)


def test_trees_do_not_depend_on_where_they_grow(spark):
    df = table(spark, 3000)
    train, asked = df.where("split <> 'test'"), df.where("split = 'test'")
    found = []
    for task_rows in (100_000, 60):
        model = forest.Forest(trees=8, task_rows=task_rows).fit(train.repartition(1 + task_rows % 7))
        found.append({r.id: r.prediction for r in model.transform(asked).collect()})
    assert len(model.tops[0].feature) > 1 and found[0].keys() == found[1].keys() and len(found[0]) == 1000
    assert [found[0][k] for k in sorted(found[0])] == pytest.approx([found[1][k] for k in sorted(found[1])])


def test_driver_holds_the_tops_alone(spark, tmp_path):
    """Trees of unlimited depth have about as many leaves as rows; none of these nodes is kept."""
    df = table(spark, 6000).cache()
    scored = models.fit_and_score(models.forest(20), df, STATS, "forest")
    assert sum(len(t.feature) for t in scored.model.tops) == 20
    row = scored.metrics.first()
    assert row.n == 2000 and row.R2 > 0.9
    models.save_model(scored.model, str(tmp_path / "model"))
    loaded = models.load_model(forest.ForestModel, str(tmp_path / "model"))
    asked = df.where("split = 'test'")
    assert {r.id: r.prediction for r in loaded.transform(asked).collect()} == pytest.approx({r.id: r.prediction for r in scored.model.transform(asked).collect()})


def test_depth_and_unusable_rows(spark):
    df = table(spark, 300)
    flat = forest.Forest(trees=3, depth=0, task_rows=10).fit(df).transform(df).select("prediction").distinct().collect()
    assert len(flat) == 1
    for bad in (df.limit(0), df.withColumn("y", F.lit(float("nan"))), df.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            forest.Forest(trees=3).fit(bad)


def test_values_of_trees_are_added_in_arrays(spark):
    """A row of Spark for each tree and row to predict would be a hundred times the table."""
    df = table(spark, 600)
    plan = forest.Forest(trees=4).fit(df).transform(df)._jdf.queryExecution().toString()
    assert "avg(value" not in plan and "MapInArrow means" in plan.replace("mapInArrow", "MapInArrow")


@pytest.mark.parametrize("size", range(1, 20))
def test_network_sorts(size):
    lines = np.random.default_rng(size).integers(0, 40, (size, 500))
    wanted = np.sort(lines, axis=0)
    forest.exchanged(lines, forest.network(size))
    assert (lines == wanted).all()


@pytest.mark.parametrize("nodes", [3, 5000])
def test_features_of_a_node_are_those_of_the_least_marks(nodes):
    paths = forest.mixed(np.arange(nodes, dtype=np.uint64))
    for size in (1, 2, 18, 40):
        marks = forest.mixed(paths[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        assert (forest.drawn_features(paths, size) == np.sort(np.argsort(marks, axis=1)[:, : int(np.ceil(np.sqrt(size)))], axis=1)).all()


def test_draws_of_mixed_copies_are_those_of_each_row():
    rng = np.random.default_rng(0)
    keys, copies = forest.mixed(np.arange(3000, dtype=np.uint64)), rng.choice([1, 2, 7, 9, 360], 3000)
    alone = [forest.draws(keys[i : i + 1], copies[i : i + 1], 5)[0] for i in range(3000)]
    assert forest.draws(keys, copies, 5).tolist() == alone
    assert len(forest.draws(keys[:0], copies[:0], 5)) == 0


@pytest.mark.parametrize("chunk", [20, 300, 10**6])
def test_tree_equals_that_of_growing_node_by_node(chunk, monkeypatch):
    """However many rows are looked at together, and with small nodes that wait for others."""
    monkeypatch.setattr(forest, "CHUNK", chunk)
    monkeypatch.setattr(forest, "FEW_NODES", 2)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, [2, 3, 7, 32, 32, 32], (900, 6)).astype(np.uint8)
    w, y = rng.integers(1, 4, 900), rng.integers(0, 1000, 900).astype(float)
    tree = forest.grow(codes, w, y, forest.root_path(0, 0), 9, 32)
    node_count, waiting = 0, [(0, np.arange(900), forest.root_path(0, 0), 9)]
    while waiting:
        node, rows, path, depth = waiting.pop()
        node_count += 1
        assert tree.value[node] == pytest.approx((w[rows] * y[rows]).sum() / w[rows].sum())
        gain = best_cut(codes[rows], w[rows], y[rows], forest.drawn_features(path, 6)[0])[0] if depth else 0.0
        if tree.feature[node] < 0:
            assert gain == pytest.approx(0.0, abs=1e-6)
            continue
        f, cut = tree.feature[node], tree.cut[node]
        side = codes[rows, f] > cut
        assert f in forest.drawn_features(path, 6)[0] and side.any() and not side.all()
        assert best_cut(np.where(codes[rows][:, [f]] > cut, 1, 0), w[rows], y[rows], [0])[0] == pytest.approx(gain)
        waiting += [(tree.left[node] + k, rows[side == k], forest.child_paths(path)[k : k + 1], depth - 1) for k in (0, 1)]
    assert node_count == len(tree.feature)
    found = np.empty(900, np.int64)
    for leaf, rows in tree.parted(codes, np.arange(900)):
        found[rows] = leaf
    assert (tree.leaves(codes) == found).all()
    some = np.unique(found)[::5]
    assert {leaf for leaf, _ in tree.parted(codes, np.arange(900), tree.leading_to(some))} >= set(some)


def test_quantiles_of_many_rows(spark):
    for n in (4000, 60_000):
        rows = spark.range(n).select(F.array(F.pmod("id", F.lit(5)).cast("double"), F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double"), F.lit(3.0)).alias("x"))
        few, many, one = forest.bin_thresholds_of_many(rows.repartition(3), 3, 32)
        assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(one) == 0 and len(many) == 31
        values = np.array([r.x[1] for r in rows.collect()])
        assert np.abs((values[:, None] <= many).mean(0) - np.arange(1, 32) / 32).max() < 2 / min(n, forest.RANKS)


def test_values_at_equal_ranks_stand_for_all(monkeypatch):
    monkeypatch.setattr(forest, "RANKS", 500)
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=20_000) for _ in range(3)]
    kept = [forest.ranked(x) for x in parts]
    values, counts = forest.ranked(*map(np.concatenate, zip(*kept)))
    assert len(values) == 500 and counts.sum() == 60_000 and (np.diff(values) > 0).all()
    there = np.sort(np.concatenate(parts))
    assert np.abs(np.searchsorted(there, values) - (np.cumsum(counts) - counts / 2)).max() < 60_000 / 250
    assert [x.tolist() for x in forest.ranked(np.array([3.0, 1.0, 3.0]), np.array([5, 2, 1]))] == [[1.0, 3.0], [2, 6]]


def test_forest_with_batch_quantiles(spark, monkeypatch):
    monkeypatch.setattr(forest, "MANY", 10)  # the driver chooses
    df = table(spark, 6000)
    assert models.fit_and_score(models.forest(20), df, STATS, "forest").metrics.first().R2 > 0.9
