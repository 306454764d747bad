"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys are computed from each document's set of word shingles; each
pair of one half key from either collection is the key of a table. So ``halves`` squared tables
need only ``2 * halves * depth`` minhashes. Documents that meet in a table are candidates, and a
link needs the full sets to agree. At a similarity s, a pair is missed with a chance of about
2 * (1 - s**depth) ** halves: 7e-5 at 0.8 with the values below, far less above it.

Equal sets are one class from the start, so copies never meet pair by pair. In each table the
members of a bucket are held against its first class, then against its last one. All pairs of a
bucket that are still in different components afterwards are compared, except those that cannot
be similar: every class carries a bitmap of its shingles, and a bin that only one of two sets
fills stands for a shingle that the other lacks. The bound is exact, so no candidate is lost.

Defined cases: null and empty texts, or those without words, have an empty set and stand alone;
a text of fewer words than a shingle is one shingle; repeated rows are copies of each other;
rows with a null id take part in exact copies only, and their component is null where no row
of it has an id. Sets are held as 64-bit hashes of the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm.common import list_array, mixed, steps, stored, text_bytes, word_hashes

_RANDOM = np.random.default_rng(7)
_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for start, stop in steps(offsets):
        words, first = word_hashes(data, offsets[start:stop + 1])
        for a, b in zip(first, first[1:]):
            size = min(width, b - a)
            if not size:
                yield words[:0]
                continue
            runs = words[a:b - size + 1].copy()
            for k in range(1, size):
                runs = mixed(runs * _K + words[a + k:b - size + 1 + k])
            yield np.unique(runs)


#: Bins of the bitmaps, as 64-bit words.
BITMAP_WORDS = 32


def bitmap(shingles: np.ndarray) -> np.ndarray:
    filled = np.zeros(64 * BITMAP_WORDS, bool)
    filled[(shingles >> np.uint64(32)) % np.uint64(len(filled))] = True
    return np.packbits(filled).view(np.int64)


class Sketcher:
    """Half keys of both collections, and a name of the set itself."""

    def __init__(self, halves: int, depth: int) -> None:
        self.halves, self.depth = halves, depth
        self.factors = _RANDOM_FACTORS[: 2 * halves * depth]

    def half_keys(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), 2**64 - 1, np.uint64)
        for at in range(0, len(shingles), 4096):
            x = shingles[at:at + 4096, None] * self.factors
            x ^= x >> np.uint64(32)
            x *= _K
            np.minimum(least, x.min(0), out=least)
        least = least.reshape(2 * self.halves, self.depth)
        keys = least[:, 0]
        for k in range(1, self.depth):
            keys = mixed(keys * _K + least[:, k])
        return keys

    @staticmethod
    def name(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
        return (mixed(shingles).sum(dtype=np.uint64), mixed(shingles ^ _K).sum(dtype=np.uint64))


_RANDOM_FACTORS = _RANDOM.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(documents: DataFrame, width: int, halves: int, depth: int) -> DataFrame:
    """id, text_hash, n_shingles, set, set_check, half keys and bitmap of each row of (id, text)."""
    kind = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text_hash", T.LongType()),
        T.StructField("n_shingles", T.LongType()), T.StructField("set", T.LongType()),
        T.StructField("set_check", T.LongType()), T.StructField("half", T.ArrayType(T.LongType())),
        T.StructField("bits", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(halves, depth)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            rows = batch.num_rows
            sizes, names = np.zeros(rows, np.int64), np.zeros((rows, 2), np.uint64)
            half, bits = np.zeros((rows, 2 * halves), np.uint64), np.zeros((rows, BITMAP_WORDS), np.int64)
            for i, shingles in enumerate(shingle_sets(data, offsets, width)):
                if len(shingles):
                    sizes[i], names[i], half[i] = len(shingles), sketcher.name(shingles), sketcher.half_keys(shingles)
                    bits[i] = bitmap(shingles)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes), pa.array(names[:, 0].view(np.int64)),
                 pa.array(names[:, 1].view(np.int64)),
                 list_array(half.view(np.int64).ravel(), np.full(rows, 2 * halves), pa.int64()),
                 list_array(bits.ravel(), np.full(rows, BITMAP_WORDS), pa.int64())], names=kind.names)

    return documents.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sketch, kind)


def pair_tables(classes: DataFrame, halves: int) -> DataFrame:
    """A row (key, i, j, set, size) for each class and table: a half key of either collection each."""
    left = classes.select("set", "n_shingles", F.slice("half", halves + 1, halves).alias("right"),
                          F.posexplode(F.slice("half", 1, halves)).alias("i", "a"))
    both = left.select("set", "n_shingles", "i", "a", F.posexplode("right").alias("j", "b"))
    return both.select(F.xxhash64("i", "a", "j", "b").alias("key"), F.col("i").cast("byte").alias("i"),
                       F.col("j").cast("byte").alias("j"), "set", F.col("n_shingles").cast("int").alias("size"))


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return 100 * F.least(a, b).cast("long") >= percent * F.greatest(a, b).cast("long")


def _bits_allow(size_a: Column, bits_a: list[Column], size_b: Column, bits_b: list[Column], percent: int) -> Column:
    """Whether bins that only one set fills leave room for a similarity of ``percent``.

    At least so many shingles stand in one set only, so twice the common ones are at most the
    sum of the sizes less that number.
    """
    alone = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(bits_a, bits_b)), F.lit(0))
    both = size_a + size_b
    return (100 + percent) * (both - alone) >= 2 * percent * both


def _first_shared(number: Column, start: int, halves: int) -> Column:
    """Whether ``number`` is the first half key of a collection that both sides have in common.

    A pair shares many tables but is made in the first of them alone. That is in ``rest`` as well:
    where a class is the first or last of a bucket, the pair has been compared already.
    """
    first = F.lit(-1)
    for k in reversed(range(halves)):
        first = F.when(F.col(f"h{start + k}_a") == F.col(f"h{start + k}_b"), k).otherwise(first)
    return number == first


def verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough."""
    needed = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct().join(
        classes.select("set", "rep"), "set")
    texts = documents.select(F.col("id").cast("long").alias("rep"), "text").join(needed, "rep")
    own = T.StructType([T.StructField("set", T.LongType()), T.StructField("text", T.StringType())])

    def same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of several texts under one id, that of the class."""
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            names = [int(Sketcher.name(s)[0].view(np.int64)) for s in shingle_sets(data, offsets, width)]
            keep = pa.array(np.array(names, np.int64) == batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=own.names).filter(keep)

    one = texts.select("set", "text").mapInArrow(same_set, own)
    one = stored(one.groupBy("set").agg(F.min("text").alias("text")))
    both = pairs.join(one.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a").join(
        one.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
    kind = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                left = list(shingle_sets(*text_bytes(part.column(2)), width))
                right = list(shingle_sets(*text_bytes(part.column(3)), width))
                keep = []
                for x, y in zip(left, right):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=kind.names).filter(pa.array(keep))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(similar, kind)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b); one root for each connected component.

    In each round every node moves to the least of itself and its neighbours, and the links
    follow; node numbers are hashes, so the graph shrinks by a constant share each time.
    """
    edges, moves = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        move = stored(both.groupBy("node").agg(F.min("other").alias("other")).select(
            "node", F.least("node", "other").alias("root")))
        moves.append(move)
        ends = edges.join(move.toDF("a", "ra"), "a").join(move.toDF("b", "rb"), "b").where("ra <> rb")
        edges = stored(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not moves:
        return edges.toDF("node", "root")
    found = moves[0]
    for move in moves[1:]:
        found = found.join(move.toDF("root", "next"), "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"))
    return stored(found)


def near_duplicates(
    documents: DataFrame, width: int = 5, percent: int = 80, halves: int = 10, depth: int = 2,
) -> DataFrame:
    """id, text_hash, n_shingles, component_id and kept for each row of ``documents`` (id, text).

    Rows are linked if ``100 * |A & B| >= percent * |A | B|``. ``component_id`` is the least id
    that links lead to, and ``kept`` tells whether it is the row's own.
    """
    rows = stored(sketches(documents, width, halves, depth))
    filled = rows.where("n_shingles > 0")
    classes = stored(filled.groupBy("set", "set_check", "n_shingles").agg(
        F.min("id").alias("rep"), F.first("half").alias("half"), F.first("bits").alias("bits")))
    linkable = classes.where("rep is not null")
    tables = pair_tables(linkable, halves)
    ends = tables.groupBy("key").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high")
    # members of the buckets with several classes
    met = stored(tables.join(ends, "key").select("key", "i", "j", "set", "size", "low", "high"))
    sizes = classes.select("set", F.col("n_shingles").alias("size"))

    def sized(pairs: DataFrame) -> DataFrame:
        found = pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
        return found.where(_may_link(F.col("size_a"), F.col("size_b"), percent)).select("a", "b")

    first = met.where("set <> low").select(F.col("low").alias("a"), F.col("set").alias("b")).distinct()
    links = stored(verified(stored(sized(first)), linkable, documents, width, percent))
    roots = components(links)
    last = _with_roots(met.where("set <> low and set <> high").select("set", "high").distinct(), roots)
    last = last.join(roots.toDF("high", "high_root"), "high", "left").where(
        F.coalesce("high_root", "high") != F.col("root")).select(
            F.least("set", "high").alias("a"), F.greatest("set", "high").alias("b")).distinct()
    links = stored(links.union(verified(stored(sized(last)), linkable, documents, width, percent)))
    roots = components(links)
    rest = _with_roots(met.where("set <> low and set <> high").select("key", "i", "j", "set", "size"), roots)
    open_keys = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    words = [F.coalesce(F.get("bits", F.lit(i)), F.lit(0)).alias(f"w{i}") for i in range(BITMAP_WORDS)]
    keys = [F.get("half", F.lit(k)).alias(f"h{k}") for k in range(2 * halves)]
    rest = stored(rest.join(open_keys, "key").join(linkable.select("set", "bits", "half"), "set").select(
        "key", "i", "j", "set", "size", "root", *words, *keys))
    one, two = (rest.toDF("key", *(f"{c}_{side}" for c in rest.columns[1:])) for side in "ab")
    bits_a, bits_b = ([F.col(f"w{i}_{side}") for i in range(BITMAP_WORDS)] for side in "ab")
    size_a, size_b = F.col("size_a"), F.col("size_b")
    left_over = one.join(two, (one["key"] == two["key"]) & (F.col("set_a") < F.col("set_b")) & (F.col("root_a") != F.col("root_b"))
                         & _may_link(size_a, size_b, percent) & _first_shared(one["i_a"], 0, halves) & _first_shared(one["j_a"], halves, halves)
                         & _bits_allow(size_a, bits_a, size_b, bits_b, percent)
                         ).select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct()
    links = links.union(verified(stored(left_over), linkable, documents, width, percent))
    roots = components(stored(links))
    rooted = _with_roots(classes.select("set", "set_check", "n_shingles", "rep"), roots)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(rooted.join(least, "root").select("set", "set_check", "n_shingles", "component_id"))
    alone = rows.where("n_shingles = 0").select("id", "text_hash", "n_shingles", F.col("id").alias("component_id"))
    grouped = filled.join(named, ["set", "set_check", "n_shingles"]).select("id", "text_hash", "n_shingles", "component_id")
    return grouped.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.toDF("set", "root"), "set", "left").withColumn("root", F.coalesce("root", "set")).select(
        *rows.columns, "root")
