"""Merkle manifests against trees built in plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from meterflow.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i:i + 3]) for i in range(0, len(below), 3)])
    return levels


def path(levels, i):
    found = []
    for nodes in levels[:-1]:
        a = i // 3 * 3
        found.append(("".join(nodes[a:i]), "".join(nodes[i + 1:a + 3])))
        i //= 3
    return found


def brute(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for group in groups.values():
        group.sort(key=lambda r: (-(2**63) if r[0] is None else r[0], leaf(r)))
    trees = [tree([leaf(r) for r in groups[s]]) for s in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, source in enumerate(order):
        for i, row in enumerate(groups[source]):
            sides = path(trees[k], i) + path(top, k)
            changed = leaf(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                changed = leaf((*row[:4], row[4].replace("\n", "")))
            for before, after in sides:
                changed = digest(before, changed, after)
            out.append((row[0], leaf(row), trees[k][-1][0], top[-1][0], digest(*(b + a for b, a in sides)),
                        changed, changed == top[-1][0]))
    return out


def found(spark, rows, extra=False):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        table = table.withColumns({c: F.lit(1) for c in ("pos", "leaf", "key", "box", "n", "group", "id", "path", "total")})
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    shown = merkle.proofs(merkle.manifest(
        table, tampered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, where=hit))
    return [tuple(r) for r in shown.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_all_kinds_of_rows(spark):
    draw = random.Random(1)
    rows = [(draw.choice([i, i * 1000003, -i, None]), draw.choice(["a", "b", "é", None, "a"]), "en", i,
             draw.choice(["x\ny", "z", "", None, "long " * 5000])) for i in range(1500)]
    rows += [(7, "a", "en", 1, f"t{i % 40}") for i in range(900)]  # one id, 40 texts, many copies
    rows += [(2**63 - 1, "a", "x", 1, "y"), (-(2**63), "a", "x", 1, "y"), (5, "lone", "x", 1, "y\n")]
    got, want = found(spark, rows), brute(rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 3, 4, 28])
def test_small_trees(spark, n):
    rows = [(i, f"s{i % 4}" if n > 4 else "s", None, None, f"{i}\n") for i in range(n)]
    assert sorted(found(spark, rows, extra=True), key=repr) == sorted(brute(rows), key=repr)


def test_empty(spark):
    assert found(spark, []) == []


def test_ranks_of_scattered_ids(spark):
    draw = random.Random(2)
    ids = sorted({draw.randrange(-(2**63), 2**63) for _ in range(400)} | {0, 63, 64, 4095, 4096, -1, -64})
    table = spark.createDataFrame([("g", i, 1) for i in ids], "g string, key long, n long").repartition(5)
    got = {r.key: (r.first, r.same, r.total) for r in merkle.ranked(table, ["g"]).collect()}
    assert got == {k: (i, 1, len(ids)) for i, k in enumerate(ids)}
