"""Each stage of the pipeline against brute force on its own input, and its odd rows."""

import random

import pytest
import sentencepiece

import corpus_pipeline
from meterflow.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        found = stored(stage(spark, docs, FOLDER))
        out.append((name, docs, found))
        docs = found
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(outputs):
    for name, (before, after) in list(outputs.items())[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString(), name


def test_quality_follows_labels(outputs, spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = rows(outputs["quality"][1])
    assert all((i in kept) == bool(q) for i, q in labels.items())


def test_near_duplicates(outputs):
    from tests.llm.test_neardup import brute

    before, after = outputs["near_duplicates"]
    known = [(i, r.text) for i, r in rows(before).items()]
    assert set(rows(after)) == {i for i, _, component in brute(known, 5) if i == component}


def test_repeats(outputs):
    from tests.llm.test_suffixes import brute

    before, after = outputs["suffix_dedup"]
    left, right = rows(before), rows(after)
    assert set(left) == set(right)
    order = sorted(left)
    for i, (n_bytes, n_removed, _, _) in zip(order, brute([left[i].text for i in order], 200)):
        assert right[i].n_chars == len(right[i].text)
        assert 0 <= n_bytes - n_removed - len(right[i].text.encode()) <= 6
        assert n_removed or right[i].text == left[i].text


def test_leaks(outputs, spark):
    items = [r.text.lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, after = outputs["decontamination"]
    kept = rows(after)
    for i, r in rows(before).items():
        text = " " + " ".join(r.text.lower().split()) + " "
        if any(" " + " ".join(item) + " " in text for item in items):
            assert i not in kept
        elif not any(" " + " ".join(item[k:k + 4]) + " " in text for item in items for k in range(len(item) - 3)):
            assert i in kept


def test_tokens(outputs):
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL_PATH)
    texts = rows(outputs["sentencepiece"][0])
    got = rows(outputs["sentencepiece"][1])
    assert set(got) == set(texts)
    assert all(r.ids == library.encode(texts[i].text) and r.lossless for i, r in got.items())


def test_odd_rows(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    odd = [(10**6, None, None, None, None, 1), (10**6 + 1, "", "", "", 0, 2), (None, text, "en", "s", 5, 3), (10**6 + 2, text[::-1], "en", "s", 7, 4),
           (10**6 + 2, text[::-1], "en", "s", 7, 4), (10**6 + 3, "very long text " * 20_000, "en", "s", 9, 5)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    for name, stage in corpus_pipeline.STAGES[1:]:
        found = stored(stage(spark, docs, FOLDER))
        assert found.columns == docs.columns or name == "sentencepiece"
        if name == "near_duplicates":
            assert sorted(r.doc_id or 0 for r in found.collect()) == [0] + [10**6 + i for i in range(4)]
        docs = found
    assert docs.count() == 5
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
