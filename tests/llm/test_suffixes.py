import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from meterflow.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def found(df, **how):
    return {r.id: (r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans, r.cut.kept_sha256)
            for r in suffixes.remove_repeats(df, **how).collect()}


def mixture(seed, length):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefgh é\n"])
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pool = [some(rng.randrange(5, 4 * length)) for _ in range(12)]
    return ["".join(rng.choice(pool) if rng.random() < 0.6 else some(rng.randrange(1, length))
                    for _ in range(rng.randrange(0, 6))) for _ in range(40)]


@pytest.mark.parametrize("seed, length, hot, part_rows", [(0, 8, 5, 20), (1, 20, 100_000, 50_000), (2, 50, 5, 20), (3, 20, 100_000, 30)])
def test_matches_brute_force(texts, seed, length, hot, part_rows):
    rows = mixture(seed, length) + [None, "", "a" * 300]
    got = found(texts(rows), length=length, hot=hot, part_rows=part_rows)
    assert [got[i] for i in range(len(rows))] == brute(rows, length)


def test_many_contexts_of_one_gram():
    rng = random.Random(4)
    line = "".join(rng.choice("abcdef") for _ in range(70))
    some = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [some(80) + line + some(80) for _ in range(120)]
    length, gram = 100, suffixes.GRAM
    place = 80 + 15
    rows = np.vstack([suffixes.contexts(np.frombuffer(t.encode(), np.uint8), np.array([place]), length) for t in texts])
    rows = np.unique(rows, axis=0)
    shared, _ = suffixes.front_coded(rows)
    strings, sure = [r.tobytes() for r in rows], [False] * len(rows)
    swept = suffixes.reaches(strings, shared.tolist(), sure, length, gram)
    limit, suffixes.PAIRWISE = suffixes.PAIRWISE, 10**6
    try:
        assert suffixes.reaches(strings, shared.tolist(), sure, length, gram) == swept
    finally:
        suffixes.PAIRWISE = limit


def test_merge_sorts_and_knows_prefixes():
    rng = random.Random(5)
    runs, everything = [], []
    for _ in range(7):
        rows = sorted({bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randrange(1, 60))})
        everything += rows
        runs.append(suffixes.Run(*suffixes.front_coded(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 12)), 12))
    got = list(suffixes.merge(runs))
    assert [s for _, _, s, _ in got] == sorted(everything)
    for (_, _, a, _), (_, _, b, known) in zip(got, got[1:]):
        assert known == suffixes.common(a, b, 0)


def test_two_hundred_bytes(texts):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    passage, long = some(320), some(50_000)
    rows = [some(500) + passage + some(30), passage[:199] + some(300), passage[60:290] + some(10), some(199),
            long, some(9) + long, passage]
    got = found(texts(rows))
    assert [got[i] for i in range(len(rows))] == brute(rows, 200)


def test_repeated_rows_and_clashing_columns(spark):
    text = "".join(random.Random(7).choice("abcdefgh") for _ in range(400))
    rows = [(1, text, "a", 5), (1, text, "b", 6), (None, text[:100], "c", 7), (3, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, text_key string, place int")
    got = suffixes.remove_repeats(df)
    assert got.columns == ["id", "text", "text_key", "place", "cut"]
    assert sorted((r.text_key or "", r.cut.n_removed, r.cut.kept_text) for r in got.collect()) == [
        ("", 0, ""), ("a", 400, ""), ("b", 400, ""), ("c", 0, text[:100])]


def test_empty(texts):
    assert suffixes.remove_repeats(texts([])).count() == 0
