import random

import numpy as np

from meterflow.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, quality string"


def corpus(seed, count=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(count):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 80))]
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        text = " ".join(words)
        source = f"s{rng.randrange(3) + (0 if good else 2)}"
        rows.append((i, text, "en", source, len(text), 0, "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_replaced_columns(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int")
    scored = quality.score(docs, quality.learn(docs, known))
    assert scored.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", "quality", "content_score", "metadata_score"]
    truth = dict(labels)
    got = [(r.doc_id, r.quality) for r in scored.collect()]
    held = [(q >= 0.5) == truth[i] for i, q in got if i % 3 == 0]
    assert np.mean(held) >= 0.97 and all(0 <= q <= 1 for _, q in got)


def test_pseudo_labels_teach_the_other_view():
    rng = np.random.default_rng(2)

    def draw(n):
        y = rng.integers(0, 2, n).astype(float)
        content, metadata = rng.normal(size=(n, quality.CONTENT)), np.zeros((n, quality.METADATA))
        content[:, 0] += 6 * y
        metadata[np.arange(n), 3 + (10 + y + 2 * (rng.random(n) < 0.1)).astype(int)] = 1
        return content, metadata, y

    content, metadata, y = draw(24)
    pool = draw(2000)
    alone = quality.cotrain(content, metadata, y, pool[:2], rounds=0)
    taught = quality.cotrain(content, metadata, y, pool[:2], rounds=8)
    test = draw(2000)
    right = [np.mean((m.scores(*test[:2])[2] >= 0.5) == test[2]) for m in (alone, taught)]
    assert right[1] >= right[0] and right[1] > 0.85


def test_edges(spark):
    rows, labels = corpus(3, 80)
    odd = [(1000, None, None, None, None, None, None), (1001, "", "", "", 0, 0, ""), (1001, "", "", "", 0, 0, ""),
           (None, "text of no number", "en", "s0", 17, 1, "y"), (1002, "very long " * 50_000, "en", "s1", 500_000, 1, "z")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    known = spark.createDataFrame(labels[:60] + [(None, 1), (5, None), (7, 0), (7, 1)], "doc_id long, quality int")
    got = {(r.doc_id, r.quality) for r in quality.score(docs, quality.learn(docs, known)).collect()}
    assert len(got) == 84 and all(0 <= q <= 1 for _, q in got)


def test_one_class_and_empty(spark):
    rows, _ = corpus(4, 20)
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    ones = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert {r.quality for r in quality.score(docs, quality.learn(docs, none)).collect()} == {0.5}
    assert all(r.quality > 0.9 for r in quality.score(docs, quality.learn(docs, ones)).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.learn(empty, ones)).count() == 0


def test_class_shares_survive_the_bound_of_fit_rows(spark):
    rng = random.Random(5)
    rows, _ = corpus(5, 300)
    labels = [(i, int(rng.random() < 0.85)) for i in range(300)]  # noise: only the share can be learned

    def means(copies, fit_rows):
        docs = spark.createDataFrame([(c * 1000 + r[0], *r[1:]) for c in range(copies) for r in rows], SCHEMA)
        known = spark.createDataFrame([(c * 1000 + i, y) for c in range(copies) for i, y in labels], "doc_id long, quality int")
        scored = quality.score(docs.where("doc_id < 1000"), quality.learn(docs, known, fit_rows=fit_rows))
        return np.mean([[r.quality, r.content_score, r.metadata_score] for r in scored.collect()], axis=0)

    assert np.abs(means(1, 8000) - means(10, 300)).max() < 0.05
