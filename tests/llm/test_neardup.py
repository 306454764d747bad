import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from meterflow.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    size = min(width, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if size else set()


def brute(rows, width, percent=80):
    """(id, size, component) by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    return sorted((i, len(s), min(rows[j][0] for j in range(len(rows)) if find(j) == find(n)))
                  for n, ((i, _), s) in enumerate(zip(rows, sets)))


def check(df, rows, width):
    got = neardup.near_duplicates(df, width=width).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == brute(rows, width)
    assert all(r.kept == (r.id == r.component_id) for r in got)


def family(seed, copies=40):
    """Copies of some texts with a growing number of words replaced."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(5):
        base = [rng.choice(words) for _ in range(rng.choice([12, 60, 150]))]
        for n in range(copies // 5):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy).upper() if n % 7 == 0 else "\t".join(copy))
    return out


def test_components_match_brute_force(texts):
    rows = list(enumerate(family(1) + family(2, 60)))
    for width in (2, 5):
        check(texts(rows), rows, width)


def test_bitmaps_never_rule_out_a_link(spark):
    rng = np.random.default_rng(1)
    rows, links = [], []
    for n in (3, 40, 400, 5000):
        for share in (0.5, 0.75, 0.8, 0.85, 1.0):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            b[int(n * share):] = rng.integers(0, 2**63, n - int(n * share)).astype(np.uint64)
            both = len(np.intersect1d(a, b))
            links.append(100 * both >= 80 * (2 * n - both))
            rows.append((n, neardup.bitmap(a).tolist(), neardup.bitmap(b).tolist()))
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    n = F.col("n")
    words = [[F.col(c)[i] for i in range(neardup.BITMAP_WORDS)] for c in "ab"]
    allowed = [r[0] for r in df.select(neardup._bits_allow(n, words[0], n, words[1], 80)).collect()]
    assert all(x or not link for x, link in zip(allowed, links))
    assert not any(allowed[i] for i in (5, 6, 10))


def test_chain_of_links(texts):
    words = [f"x{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i:6 * i + 120])) for i in range(40)]
    check(texts(rows), rows, 2)


def test_edges(texts):
    rows = [(5, None), (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "ONE"), (11, "one two"), (3, "é É"),
            (2, "é É"), (4, "é é"), (12, "long " * 30000), (13, "long " * 20000), (11, "one two")]
    check(texts(rows), rows, 2)


def test_null_id_and_clashing_columns(spark):
    rows = [(1, "a b c", "x", 1), (None, "a b c", "x", 2), (None, "d e f", "y", 3), (4, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, set string, kept int").select("id", "text")
    got = {(r.id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, width=2).collect()}
    assert got == {(1, 2, 1, True), (None, 2, 1, False), (None, 2, None, True), (4, 0, 4, True)}


def test_same_id_different_texts(texts):
    base = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(base)), (1, "quite another text of its own"), (2, " ".join(base[:-1] + ["end"]))]
    got = sorted((r.id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(texts(rows), width=2).collect())
    assert got == [(1, 5, 1), (1, 49, 1), (2, 49, 1)]


def test_empty(texts):
    assert neardup.near_duplicates(texts([])).count() == 0
