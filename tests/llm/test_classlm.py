"""The class model against counts in plain Python, full sums and planted classes."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import classlm

SCHEMA = "doc_id long, text string, learns boolean"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [None]


@pytest.fixture(scope="module")
def rows():
    """Sentences of two languages and two word classes that take turns."""
    draw = random.Random(4)
    kinds = [[f"{stem}{i}" for i in range(30)] for stem in ("ga", "bo", "xi", "ku")]
    out = []
    for i in range(400):
        a, b = (kinds[:2], kinds[2:])[i % 2]
        out.append((i, " ".join(draw.choice((a, b)[t % 2]) for t in range(draw.randrange(1, 30))), i % 7 != 2))
    out += [(1000, None, True), (1001, "", False), (1002, "Never Seen ga1\tGA1", False), (1003, "ga1 " * 30000, False)]
    return out + [out[0], out[0], (None, "bo1 bo2", None)]


@pytest.fixture(scope="module")
def scored(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = classlm.learn(docs, n_classes=6, rounds=9, most_frequent=1000)
    return model, classlm.score(docs, model, ["doc_id", "text"]).collect()


def test_counts_and_base(rows, scored):
    model, got = scored
    counts = collections.Counter(t for _, text, learns in rows if learns for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    assert (model.tokens, model.types) == (n, v)
    assert len(got) == len(rows)
    for r in got:
        words = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(words), sum(counts[w] > 0 for w in words))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))


def test_score_is_the_chain_of_classes(rows, scored):
    model, got = scored
    counts = collections.Counter(t for _, text, learns in rows if learns for t in tokens(text))

    def units(words):
        raw = "\n".join(words).encode()
        hashes, forms, _ = classlm.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return model.units.of(hashes, forms)[0]

    kinds = sorted(w for w in counts if w is not None)
    of = model.classes[units(kinds)]
    size = collections.Counter()
    for word, c in zip(kinds, of):
        size[c] += counts[word] + 1
    for r in got[::17]:
        words = tokens(r.text)[:-1]
        classes = [0, *(model.classes[units(words)] if words else ()), 0]
        want = sum(math.log10(model.steps[a, b]) for a, b in zip(classes, classes[1:]))
        want += sum(math.log10((counts[w] + 1) / (size[c] + 1)) for w, c in zip(words, classes[1:]))
        assert r.score == pytest.approx(want, rel=1e-9)


def test_probabilities_sum_to_one(scored):
    model, _ = scored
    assert model.steps.sum(1) == pytest.approx(np.ones(len(model.steps)))
    assert (model.steps > 0).all()


def test_exchange_finds_planted_classes(rows, scored):
    model, got = scored
    assert model.trace[-1] > model.trace[0]
    held = [r for r in got if r.doc_id is not None and r.doc_id % 7 == 2 and r.doc_id < 400]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * n


def test_gain_is_the_change_of_likelihood():
    draw = np.random.default_rng(5)
    chain = draw.integers(0, 12, 3000)
    classes = draw.integers(0, 4, 12)

    def matrix(of):
        out = np.zeros((4, 4))
        np.add.at(out, (of[chain[:-1]], of[chain[1:]]), 1)
        return out

    for unit in range(12):
        after = np.bincount(classes[chain[1:][chain[:-1] == unit]], minlength=4)
        before = np.bincount(classes[chain[:-1][chain[1:] == unit]], minlength=4)
        itself = float(((chain[:-1] == unit) & (chain[1:] == unit)).sum())
        gain = classlm.gains(matrix(classes), before, after, itself, classes[unit])
        for to in range(4):
            moved = classes.copy()
            moved[unit] = to
            change = classlm.likelihood(matrix(moved)) - classlm.likelihood(matrix(classes))
            assert gain[to] == pytest.approx(change, abs=1e-6)


def test_nothing_to_learn_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, False)], SCHEMA).withColumns(
        {c: F.lit(7) for c in ("row", "rare", "kept", "hash", "more")})
    model = classlm.learn(docs, n_classes=3, rounds=1)
    got = {r.doc_id: r for r in classlm.score(docs, model, ["doc_id", "row", "rare", "kept", "hash", "more"]).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].base_score, got[2].n_tokens) == (3, 0, 0.0, 1)
    assert math.isfinite(got[1].score)
    empty = docs.limit(0)
    assert classlm.score(empty, classlm.learn(empty, 3, 1), ["doc_id"]).count() == 0
