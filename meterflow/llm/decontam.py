"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item if tiles cover ``threshold`` of the item's
words or more. Tiles are common runs of ``least`` words or more that overlap neither in the
document nor in the item; the longest are marked first, so passages whose parts were put in
another order are found as well. Words are runs of other characters than white space, A-Z
lower-cased. Defined cases: items and documents that are null, empty or shorter than one tile
match nothing, except that an item of fewer than ``least`` words is one tile if the document
holds all of it; repeated rows get equal results; items with a null id are judged, but a
match carries no id for them; ties between runs go to the first place in the item, then in
the document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm.common import list_array, mixed, steps, text_bytes, word_hashes

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``size`` words."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for k in range(1, size):
        out *= _FACTOR
        out += words[k:k + count]
    return mixed(out)


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (place in the item, place in the text, words)."""
    out: list[tuple[int, int, int]] = []
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    size = min(len(item), len(text))
    while size >= least:
        places = defaultdict(list)
        for i, key in enumerate(run_hashes(text, size).tolist()):
            if free_text[i:i + size].all():
                places[key].append(i)
        longest, matches = 0, []
        for i, key in enumerate(run_hashes(item, size).tolist()):
            if key in places and free_item[i:i + size].all():
                for j in places[key]:
                    if (item[i:i + size] != text[j:j + size]).any():
                        continue
                    n = size
                    while (i + n < len(item) and j + n < len(text) and free_item[i + n] and free_text[j + n]
                           and item[i + n] == text[j + n]):
                        n += 1
                    longest = max(longest, n)
                    matches.append((i, j, n))
        if longest > size:  # longer than looked for: look again at that length
            size = longest
            continue
        for i, j, n in sorted(matches):
            if n == size and free_item[i:i + n].all() and free_text[j:j + n].all():
                free_item[i:i + n] = free_text[j:j + n] = False
                out.append((i, j, n))
        size -= 1
    return out


def islands(words: np.ndarray, seeds: np.ndarray, least: int) -> np.ndarray:
    """Only those words that a seed covers; a zero word, equal to no other, parts the islands."""
    covered = np.zeros(len(words), bool)
    for k in range(least):
        covered[seeds + k] = True
    at = np.flatnonzero(covered)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(words[at], gaps, np.zeros(len(gaps), np.uint64))


class Items:
    """Benchmark items as word hashes, with their seeds sorted for lookup."""

    def __init__(self, ids: list, texts: list, least: int) -> None:
        self.ids, self.least = ids, least
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        words, first = word_hashes(data, offsets) if len(ids) else (np.zeros(0, np.uint64), np.zeros(1, int))
        self.words = [words[a:b] for a, b in zip(first, first[1:])]
        self.sizes = sorted({min(least, len(w)) for w in self.words if len(w)})
        self.seeds = {}
        for size in self.sizes:
            keys = [run_hashes(w, size) if min(least, len(w)) == size else np.zeros(0, np.uint64) for w in self.words]
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            self.seeds[size] = flat[order], owner[order]

    def matches(self, words: np.ndarray, first: np.ndarray):
        """(text, item, tiles) of all texts that share a seed with an item."""
        for size in self.sizes:
            keys, owner = self.seeds[size]
            runs = run_hashes(words, size)
            at = np.searchsorted(keys, runs)
            hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == runs)
            text = np.searchsorted(first, hit, "right") - 1
            inside = hit + size <= first[text + 1]
            found = defaultdict(list)
            for place, row in zip(hit[inside].tolist(), text[inside].tolist()):
                key = runs[place]
                for k in range(int(np.searchsorted(keys, key)), int(np.searchsorted(keys, key, "right"))):
                    found[row, int(owner[k])].append(place)
            for (row, item), places in found.items():
                own = words[first[row]:first[row + 1]]
                near = islands(own, np.unique(places) - first[row], size)
                yield row, item, tiles(self.words[item], near, size)


def contamination(
    documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 4, block_rows: int = 20_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Id, items, covered share and flag of every document.

    ``documents`` has id and text, ``benchmark`` item_id and text; columns of ``documents``
    named in ``keep`` stay. Gives id, contaminated,
    coverage (the greatest share of an item's words that tiles cover, whatever the item) and
    items (ids of all items covered ``threshold`` or more, ascending). The benchmark is a
    stated query set: it is taken in blocks of at most ``block_rows`` items, and each block is
    held against all documents.
    """
    spark = documents.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null").distinct()
    count = items.count()
    blocks = -(-count // block_rows)
    if blocks > 1:
        split = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]
    else:
        split = [items]
    # one column of found items per block, so that a document stays one row
    found = documents.select("id", "text", *keep)
    parts = []
    for number, block in enumerate(split):
        rows = sorted(((r["item_id"], r["text"]) for r in block.collect()), key=str)
        shared = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], least))
        found = found.withColumn(f"part_{number}", _matched(shared, threshold)("text"))
        parts.append(F.col(f"part_{number}"))
    covered = F.greatest(F.lit(0.0), *(p["coverage"] for p in parts), F.lit(0.0))
    listed = F.array_sort(F.array_distinct(F.concat(*(p["items"] for p in parts))))
    hit = F.lit(False)
    for p in parts:
        hit = hit | p["hit"]
    return found.select("id", *keep, hit.alias("contaminated"), covered.alias("coverage"), listed.alias("items"))


def _matched(shared, threshold: float):
    kind = T.StructType([T.StructField("items", T.ArrayType(T.LongType())), T.StructField("coverage", T.DoubleType()),
                         T.StructField("hit", T.BooleanType())])

    @F.arrow_udf(kind)
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items: Items = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch)
            rows = len(offsets) - 1
            ids, best, hit = [[] for _ in range(rows)], np.zeros(rows), np.zeros(rows, bool)
            for start, stop in steps(offsets):
                words, first = word_hashes(data, offsets[start:stop + 1])
                for row, item, marked in items.matches(words, first):
                    share = sum(n for _, _, n in marked) / len(items.words[item])
                    best[start + row] = max(best[start + row], share)
                    if share >= threshold:
                        hit[start + row] = True
                        if items.ids[item] is not None:
                            ids[start + row].append(items.ids[item])
            counts = np.array([len(set(x)) for x in ids])
            flat = np.array([i for x in ids for i in sorted(set(x))], np.int64)
            yield pa.StructArray.from_arrays(
                [list_array(flat, counts, pa.int64()), pa.array(best), pa.array(hit)], names=kind.names)

    return matched
