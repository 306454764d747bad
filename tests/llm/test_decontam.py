import random

import numpy as np

from meterflow.llm import decontam


def brute_tiles(item, text, least):
    """Greedy string tiling by looking at every pair of places."""
    a, b, out = [True] * len(item), [True] * len(text), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if not found:
            return sorted(out)
        for i, j in found:
            if all(a[i:i + best]) and all(b[j:j + best]):
                a[i:i + best] = b[j:j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_match_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randrange(1, 5) for _ in range(rng.randrange(3, 25))]
        text = [rng.randrange(1, 5) for _ in range(rng.randrange(3, 40))]
        got = decontam.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert sorted(got) == brute_tiles(item, text, 3)


ITEM = "the quick brown fox jumps over the lazy dog while nine wise owls watch from a tall old oak"


def run(spark, docs, items, **how):
    documents = spark.createDataFrame(docs, "id long, text string, items string, part_0 int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    return {r.id: (r.contaminated, round(r.coverage, 3), list(r["items"])) for r in
            decontam.contamination(documents, benchmark, **how).collect()}


def test_reordered_and_partial_passages(spark):
    words = ITEM.split()
    docs = [(0, f"Before it. {ITEM} And after.", "x", 1), (1, " ".join(words[9:] + ["mark"] + words[:9]).upper(), "x", 1),
            (2, " ".join(words[:6]), "x", 1), (3, "nothing of the kind in here at all", "x", 1),
            (4, "start " * 40_000 + ITEM, "x", 1), (5, " ".join(words[4:15]), "x", 1)]
    got = run(spark, docs, [(7, ITEM), (8, ITEM), (9, "an item that no document holds at all")])
    assert got[0] == got[4] == (True, 1.0, [7, 8])
    assert got[1][0] and got[1][1] == 1.0
    assert got[2] == (False, round(6 / 19, 3), []) and got[3] == (False, 0.0, [])
    assert got[5] == (True, round(11 / 19, 3), [7, 8])


def test_blocks_give_the_same(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcdefghijkl") * 2 for _ in range(12))) for i in range(30)]
    docs = [(i, " ".join(t for _, t in rng.sample(items, 2)) if i % 3 else "zz " * 20, "x", 0) for i in range(40)]
    whole = run(spark, docs, items)
    assert whole == run(spark, docs, items, block_rows=4)
    assert sum(w[0] for w in whole.values()) == sum(1 for i in range(40) if i % 3)


def test_edges(spark):
    docs = [(0, None, "x", 1), (1, "", "x", 1), (2, "short one here", "x", 1), (2, "short one here", "x", 1), (3, "one", "x", 1),
            (None, ITEM, "x", 1)]
    items = [(1, None), (2, ""), (3, "short one"), (None, ITEM), (5, "one two three four five")]
    got = run(spark, docs, items)
    assert got == {0: (False, 0.0, []), 1: (False, 0.0, []), 2: (True, 1.0, [3]), 3: (False, 0.0, []), None: (True, 1.0, [])}
    assert run(spark, docs, []) == {i: (False, 0.0, []) for i in (0, 1, 2, 3, None)}
    assert run(spark, [], items) == {}
