"""Prefix tries against dictionaries of prefixes."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from meterflow.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-(2**63) if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute(conversations):
    members = collections.defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for node, ids in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(ids) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(conversations[c]) == len(node))))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children[node],
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows, chunk=None, extra=False):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        table = table.withColumns({c: F.lit(1) for c in ("depth", "pos", "x1", "tie", "length", "h", "base", "digest")})
    turns = convtrie.numbered(table, chunk)
    base, shared = F.expr("conv_id - conv_id % 5"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return sorted((tuple(r) for r in convtrie.trie(*convtrie.forked(turns, base, shared, 8)).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    out = [(c, t if (t, c) != (3, 7) else None, draw.choice(["u", None]), draw.choice(["a", "é", "", None]))
           for c in range(-20, 150) if c % 13 != 4 for t in range(draw.choice([1, 3, 8, 12, 40]))]
    # long conversations that part after 200 turns, one of them deeper than two bands of bands
    out += [(c, t, "u", f"x{t}" if t < 200 else f"{c}{t}") for c, n in ((300, 210), (301, 210), (305, 270)) for t in range(n)]
    return out + [(None, 1, "a", "b")]


def test_bands_of_bands(spark, rows):
    want = sorted(brute(rebuilt(rows)), key=repr)
    assert max(r[1] for r in want) > convtrie.BAND**2
    assert found(spark, rows) == want


def test_conversations_cut_into_ranges(spark, rows):
    assert found(spark, rows, chunk=50, extra=True) == sorted(brute(rebuilt(rows)), key=repr)


def test_chunks_and_hot_parents(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "CHUNK_BITS", 2)
    monkeypatch.setattr(convtrie, "MANY_CHILDREN", 3)
    monkeypatch.setattr(convtrie, "ENDS_BITS", 2)
    rows = [(c, t, "u", f"{c % 4}" if t < 11 else f"{c % 7}") for c in range(60) for t in range(13)]
    assert found(spark, rows) == sorted(brute(rebuilt(rows)), key=repr)


def test_copies_and_turnless(spark):
    rows = [(c, 0, "u", "same") for c in range(3000)]
    assert found(spark, rows) == sorted(brute(rebuilt(rows)), key=repr)
    lone = [(3, 0, "u", "a")]  # nothing is left of its own turns, and there is no conversation 0
    assert found(spark, lone) == sorted(brute(rebuilt(lone)), key=repr)


def test_as_they_are(spark):
    rows = [(c, t, "u", "a" * (t + 1)) for c in range(5) for t in range(c)]
    own = collections.defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role, text))
    turns = convtrie.numbered(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in convtrie.trie(*convtrie.as_they_are(turns)).collect()), key=repr)
    assert got == sorted(brute(own), key=repr)


def test_empty(spark):
    assert found(spark, []) == []
