"""Random forest regression whose trees grow without a bound on their nodes.

A tree of unlimited depth has about as many leaves as rows, so a forest is far larger than its input and
no driver can hold it. Here the driver holds the tops of the trees alone: levels whose nodes have more rows
than a task takes are split by histograms that tasks add up. Below, every node is shuffled to one task with
its rows, which grows the rest of the tree there, scores the rows to predict that fell into the same
node and drops it. Only the means over all trees are kept.

Draws come from hashes of the row (how often it is in a tree) and of the path to a node (which features
it may split by), so they depend neither on partitions nor on how many levels the driver holds.
"""

from __future__ import annotations

import copy
import functools
import json
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.session import small_table, stored

#: Rows of the training part that a task deals out to all trees, how many of them at a time, and rows to predict.
DEALT, BATCH, ASKED = 524_288, 262_144, 131_072
#: Rows in all trees that a task grows or predicts, and the most rows of a node that travel in one piece.
PAIRS, PIECE = 2_000_000, 16_384
#: Nodes of more rows are split by histograms, others by sorting their rows.
FEW = 16
WIDTHS = np.array([2, 3, 4, 6, 8, 12, FEW])
#: Values of a feature that are kept of a batch, at equal ranks.
RANKS = 8_192
#: More rows are sorted in batches for their quantiles.
MANY = 1_000_000
#: Fewer nodes of one size are treated as larger ones.
FEW_NODES = 256
#: Rows of a tree that are looked at together: enough to make up for numpy's calls, few enough for a processor's cache.
CHUNK = 65_536

RECORDS = "tree int, node int, kind int, part long, rows int, data binary"
PREDICTED = "part long, tree int, node int, rows int, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root_path(tree: int, seed: int) -> np.ndarray:
    return mixed(mixed(np.array([seed], np.int64).view(np.uint64)) + np.uint64(tree))


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Paths of the left and the right child of every node, in turn."""
    return mixed(np.repeat(paths, 2) * np.uint64(2) + np.tile(np.array([0, 1], np.uint64), len(paths)))


def drawn_features(paths: np.ndarray, size: int) -> np.ndarray:
    """For every node as many different features as the root of their number, ascending.

    Features are the lines of the arrays below and nodes their columns, so every step is one over long rows.
    """
    wanted, bits = math.ceil(math.sqrt(size)), np.uint64(size.bit_length())
    out = np.empty((wanted, len(paths)), np.int64)
    for at in range(0, len(paths), 4096):
        marks = mixed(paths[at : at + 4096] + np.arange(1, size + 1, dtype=np.uint64)[:, None] * np.uint64(0xD1B54A32D192ED03))
        marks = marks >> bits << bits | np.arange(size, dtype=np.uint64)[:, None]
        if len(paths) < 256:
            marks.sort(axis=0)
        else:
            exchanged(marks, [(i - 1, i) for first in range(wanted) for i in range(size - 1, first, -1)])
        out[:, at : at + 4096] = marks[:wanted] & (np.uint64(1) << bits) - np.uint64(1)
    exchanged(out, network(wanted))
    return out.T


def exchanged(lines: np.ndarray, pairs: Iterable[tuple[int, int]]) -> None:
    """Put the smaller one of each pair of lines first, column by column."""
    for a, b in pairs:
        lower = np.minimum(lines[a], lines[b])
        np.maximum(lines[a], lines[b], out=lines[b])
        lines[a] = lower


@functools.cache
def network(size: int) -> list[tuple[int, int]]:
    """The exchanges that sort ``size`` lines (Batcher's merges of odd and even places)."""
    out, half = [], 1
    while half < size:
        step = half
        while step:
            for start in range(step % half, size - step, 2 * step):
                out += [(i, i + step) for i in range(start, min(start + step, size - step)) if i // (2 * half) == (i + step) // (2 * half)]
            step //= 2
        half *= 2
    return out


@functools.lru_cache(64)
def poisson_bounds(mean: int) -> tuple[int, np.ndarray]:
    """The least count told apart, and the draws of 53 bits from which on it is one more, and another one, and so on."""
    reach = 12 * math.sqrt(mean) + 24
    low = max(0, int(mean - reach))
    shares = np.cumsum([math.exp(c * math.log(mean) - mean - math.lgamma(c + 1)) for c in range(low, int(mean + reach))])
    return low, np.ceil(shares[:-1] * 2.0**53).astype(np.uint64)


def alike(copies: np.ndarray) -> list[tuple[int, np.ndarray | slice]]:
    """The different numbers of copies and the rows of each."""
    if not len(copies) or copies.min() == copies.max():
        return [(int(c), slice(None)) for c in copies[:1]]
    order = np.argsort(copies, kind="stable")
    starts = np.flatnonzero(np.diff(copies[order], prepend=-1))
    return [(int(copies[rows[0]]), rows) for rows in np.split(order, starts[1:])]


def draws(keys: np.ndarray, copies: np.ndarray, tree: int, groups: list | None = None) -> np.ndarray:
    """How often each row is in a tree: Poisson with the number of its copies as mean."""
    at = mixed(keys ^ mixed(np.array([tree], np.uint64))) >> np.uint64(11)
    out = np.zeros(len(keys), np.int64)
    for mean, rows in alike(copies) if groups is None else groups:
        low, bounds = poisson_bounds(mean)
        x = at[rows]
        if mean > 8:
            out[rows] = low + np.searchsorted(bounds, x, side="right")
            continue
        more, top = np.zeros(len(x), np.uint8), x.max()
        for bound in bounds[: np.searchsorted(bounds, top, side="right")]:
            more += x >= bound
        out[rows] = low + more.astype(np.int64)
    return out


def gains(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """What the sum of squares falls by when the first axis is cut behind each place; no gain at its end.

    ``w`` and ``s``: weights and weighted targets, summed up along that axis.
    """
    right, rest = w[-1] - w, s[-1] - s
    out = w * right
    with np.errstate(divide="ignore", invalid="ignore"):
        out /= w[-1]
        mean = s / w
        rest /= right
        mean -= rest
        mean *= mean
        out *= mean
    np.copyto(out, 0.0, where=(w <= 0) | (right <= 0))
    return out


def summed_up(lines: np.ndarray) -> np.ndarray:
    """Running sums of the lines, in place; numpy's own along a first axis are slow."""
    for i in range(1, len(lines)):
        lines[i] += lines[i - 1]
    return lines


@dataclass
class Tree:
    """Nodes as arrays: a node without a feature is a leaf; the right child follows the left one."""

    feature: np.ndarray = field(default_factory=lambda: np.array([-1], np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint8))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.full(1, np.nan))

    def grown(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> None:
        """Split leaves; their children come last, in the order of ``nodes``."""
        size, more = len(self.feature), 2 * len(nodes)
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int16)])
        self.cut = np.concatenate([self.cut, np.zeros(more, np.uint8)])
        self.left = np.concatenate([self.left, np.zeros(more, np.int32)])
        self.value = np.concatenate([self.value, np.full(more, np.nan)])
        self.feature[nodes], self.cut[nodes] = feature, cut
        self.left[nodes] = size + 2 * np.arange(len(nodes))

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``codes``."""
        out = np.zeros(len(codes), np.int32)
        if self.feature[0] < 0:
            return out
        flat, inner = codes.T.ravel(), self.feature >= 0
        # a node in one number: child, feature and cut; a leaf leads to itself, since no code is above 255
        step = np.where(inner, self.left, np.arange(len(inner))).astype(np.int64) << 24
        step |= np.where(inner, self.feature.astype(np.int64) << 8 | self.cut, 255)
        for first in range(0, len(codes), CHUNK):
            rows = np.arange(first, min(first + CHUNK, len(codes)))
            while len(rows):
                at = step[out[rows]]
                for _ in range(4):
                    code = flat[(at >> 8 & 0xFFFF) * len(codes) + rows]
                    node = (at >> 24) + (code > (at & 255))
                    at = step[node]
                out[rows] = node
                rows = rows[inner[node]]
        return out

    def parted(self, codes: np.ndarray, rows: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """The leaves that hold some of ``rows``, and which; of the leaves below ``wanted`` nodes alone, if given."""
        columns, open_nodes = codes.T, [(0, rows)]
        while open_nodes:
            node, rows = open_nodes.pop()
            if not len(rows) or (wanted is not None and not wanted[node]):
                continue
            feature, left = int(self.feature[node]), int(self.left[node])
            if feature < 0:
                yield node, rows
                continue
            right = columns[feature][rows] > self.cut[node]
            open_nodes += [(left + 1, rows.compress(right)), (left, rows.compress(~right))]

    def leading_to(self, leaves: Iterable[int]) -> np.ndarray:
        """Which nodes are one of ``leaves`` or above one."""
        out = np.zeros(len(self.feature), bool)
        out[list(leaves)] = True
        for node in np.flatnonzero(self.feature >= 0)[::-1]:  # children have higher numbers
            out[node] = out[self.left[node]] or out[self.left[node] + 1]
        return out


def cuts_of_large(codes, w, wy, sizes, starts, features, bins, order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best gain, feature and cut of nodes whose rows lie behind each other, by histograms.

    ``order`` has the places in ``codes`` of the rows of ``w`` and ``wy``, if these are in another order.
    """
    n, q = features.shape
    flat, height = codes.T.ravel(), len(codes)
    owner = np.repeat(np.arange(n), sizes)
    rows = np.arange(len(owner)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    weight, total = w[rows], wy[rows]
    rows = rows if order is None else order[rows]
    gain, feature, cut = np.zeros(n), features[:, 0].copy(), np.zeros(n, np.int64)
    for j in range(q):
        if n == 1:
            cell = flat[features[0, j] * height : (features[0, j] + 1) * height][rows].astype(np.int64)
        else:
            cell = flat[np.repeat(features[:, j] * height, sizes) + rows].astype(np.int64)
            cell *= n
            cell += owner
        sums = [summed_up(np.bincount(cell, x, n * bins).reshape(bins, n)) for x in (weight, total)]
        found = gains(*sums)
        at = found.argmax(0)
        most = found[at, np.arange(n)]
        better = most > gain
        gain[better], feature[better], cut[better] = most[better], features[better, j], at[better]
    return gain, feature, cut


def cuts_of_small(codes, w, wy, sizes, starts, features, width, order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of nodes of at most ``width`` rows, whose rows are sorted by each feature.

    Places, features and nodes are the axes of the arrays: numpy is fast along a long last axis alone.
    """
    n, q = features.shape
    flat, height = codes.T.ravel(), len(codes)
    places = np.arange(width)[:, None]
    there = places < sizes
    rows = np.where(there, starts + places, starts)
    rows = rows if order is None else order[rows]
    keys = flat[rows[:, None] + features.T * height].astype(np.uint16)
    keys *= FEW
    keys += places.astype(np.uint16)[:, None]
    pad = np.broadcast_to(~there[:, None], keys.shape)
    np.copyto(keys, 0xFFFF, where=pad)
    exchanged(keys, network(width))
    code, place = keys // FEW, (keys % FEW).astype(np.int64)
    np.copyto(place, 0, where=pad)
    place += starts
    sums = [x[place] for x in (w, wy)]
    for x in sums:
        np.copyto(x, 0.0, where=pad)
    found = gains(*map(summed_up, sums))
    np.copyto(found[:-1], 0.0, where=code[1:] == code[:-1])
    most, cut = found[0], code[0]
    for i in range(1, width):
        better = found[i] > most
        np.copyto(most, found[i], where=better)
        np.copyto(cut, code[i], where=better)
    pick = most.argmax(0)
    nodes = np.arange(n)
    return most[pick, nodes], features[nodes, pick], cut[pick, nodes].astype(np.int64)


def best_cuts_of(codes, w, wy, sizes, starts, paths, bins, order=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best gain, feature and cut of nodes of any size, by the features drawn for each."""
    features = drawn_features(paths, codes.shape[1])
    out = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    kinds = np.searchsorted(WIDTHS, sizes)
    for kind, n in enumerate(np.bincount(kinds, minlength=len(WIDTHS))[: len(WIDTHS) - 1]):
        if n < FEW_NODES:  # not worth steps of their own
            kinds[kinds == kind] += 1
    for kind in np.unique(kinds):
        here = np.flatnonzero(kinds == kind)
        told = codes, w, wy, sizes[here], starts[here], features[here]
        found = cuts_of_small(*told, int(WIDTHS[kind]), order) if kind < len(WIDTHS) else cuts_of_large(*told, bins, order)
        for all_nodes, x in zip(out, found):
            all_nodes[here] = x
    return out


@dataclass
class Nodes:
    """Nodes of a tree that grows: the places of their rows, node behind node, and of each node its rows' number, its own, its path and the depth left."""

    rows: np.ndarray
    sizes: np.ndarray
    numbers: np.ndarray
    paths: np.ndarray
    depths: np.ndarray

    def where(self, chosen: np.ndarray) -> Nodes:
        if chosen.all():
            return self
        return Nodes(self.rows.compress(np.repeat(chosen, self.sizes)), self.sizes[chosen], self.numbers[chosen], self.paths[chosen], self.depths[chosen])

    @staticmethod
    def together(parts: list[Nodes]) -> Nodes:
        return Nodes(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Nodes)))


@dataclass
class Growing:
    """A tree and the rows that it grows from. A tree has fewer than twice as many nodes as rows."""

    codes: np.ndarray
    w: np.ndarray
    y: np.ndarray
    bins: int
    used: int = 1

    def __post_init__(self) -> None:
        most = 2 * len(self.y)
        self.tree = Tree(np.full(most, -1, np.int16), np.zeros(most, np.uint8), np.zeros(most, np.int32), np.empty(most))

    def done(self) -> Tree:
        tree = self.tree
        return Tree(*(x[: self.used] for x in (tree.feature, tree.cut, tree.left, tree.value)))

    def of(self, rows: np.ndarray) -> Growing:
        """The same tree, by some of the rows alone, which a cache holds."""
        part = copy.copy(self)
        part.codes, part.w, part.y = np.ascontiguousarray(self.codes.T[:, rows]).T, self.w[rows], self.y[rows]
        return part

    def split(self, at: Nodes) -> Nodes:
        """Their children, those on the left first."""
        starts = np.cumsum(at.sizes) - at.sizes
        w, y = self.w[at.rows], self.y[at.rows]
        wy = w * y
        self.tree.value[at.numbers] = np.add.reduceat(wy, starts) / np.add.reduceat(w, starts)
        mixed_up = np.flatnonzero((np.minimum.reduceat(y, starts) < np.maximum.reduceat(y, starts)) & (at.depths > 0))
        gain, feature, cut = best_cuts_of(self.codes, w, wy, at.sizes[mixed_up], starts[mixed_up], at.paths[mixed_up], self.bins, at.rows)
        chosen = np.zeros(len(at.sizes), bool)
        chosen[mixed_up[gain > 0]] = True
        feature, cut, at = feature[gain > 0], cut[gain > 0].astype(np.uint8), at.where(chosen)
        children = self.used + 2 * np.arange(len(feature))
        self.used += 2 * len(feature)
        self.tree.feature[at.numbers], self.tree.cut[at.numbers], self.tree.left[at.numbers] = feature, cut, children
        flat, height = self.codes.T.ravel(), len(self.codes)
        side = flat[np.repeat(feature * height, at.sizes) + at.rows] > np.repeat(cut, at.sizes)
        right = np.add.reduceat(side, np.cumsum(at.sizes) - at.sizes, dtype=np.int64) if len(feature) else at.sizes
        paths = child_paths(at.paths)
        return Nodes(
            np.concatenate([at.rows.compress(~side), at.rows.compress(side)]), np.concatenate([at.sizes - right, right]), np.concatenate([children, children + 1]),
            np.concatenate([paths[0::2], paths[1::2]]), np.tile(at.depths - 1, 2))


def grow(codes: np.ndarray, w: np.ndarray, y: np.ndarray, path: np.ndarray, depth: int, bins: int) -> Tree:
    """The tree of the given rows.

    Nodes of more than ``CHUNK`` rows are split one by one, smaller ones level by level. Nodes of a few rows wait until
    there are many of them, whatever their levels.
    """
    whole = Growing(np.ascontiguousarray(codes.T).T, w.astype(float), y, bins)
    large, few = [Nodes(np.arange(len(y)), np.array([len(y)]), np.zeros(1, np.int64), path, np.array([depth]))], []
    while large or few:
        waiting = sum(len(x.rows) for x in few)
        if large and waiting < 2 * CHUNK:
            at = large.pop()
            if len(at.rows) > CHUNK:
                children = whole.split(at)
                large += [children.where(children.numbers == k) for k in children.numbers]
                continue
            least = FEW
        else:
            at, few, least = Nodes.together(few), [], 0
        ids = at.rows
        part = whole.of(ids)
        at = replace(at, rows=np.arange(len(ids)))
        while len(at.sizes):
            small = at.sizes <= least
            if small.any():
                later = at.where(small)
                few.append(replace(later, rows=ids[later.rows]))
                at = at.where(~small)
            if len(at.sizes):
                at = part.split(at)
        whole.used = part.used
    return whole.done()


def packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True)


def unpacked(data: bytes, rows: int, size: int, *kinds: str) -> list[np.ndarray]:
    """The codes, one row each, and the columns of these kinds."""
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = pa.decompress(data, decompressed_size=rows * (size + sum(widths)), codec="zstd", asbytes=True)
    out, at = [np.frombuffer(raw, np.uint8, rows * size).reshape(size, rows).T], rows * size
    for kind, width in zip(kinds, widths):
        out.append(np.frombuffer(raw, kind, rows, at))
        at += rows * width
    return out


def _codes(batch: pa.RecordBatch, size: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, size)
    return np.ascontiguousarray(rows.T).T


def _binary(rows: np.ndarray) -> pa.Array:
    """The bytes of every row."""
    n, size = rows.shape
    places = np.arange(0, n * size + 1, size, dtype=np.int32) if size else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(rows))])


def _sent(records: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Records as batches of some MB; the last column is binary."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record[-1])
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of ``batches``; their last column is binary and not copied."""
    for batch in batches:
        others = zip(*(c.to_pylist() for c in batch.columns[:-1]))
        for told, data in zip(others, batch.columns[-1]):
            yield *told, data.as_buffer()


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in as few batches of about ``most`` rows as there can be."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


@dataclass(frozen=True)
class Bag:
    """Rows of the training part: copies of equal codes and target are one row."""

    rows: DataFrame
    count: int
    size: int
    trees: int
    seed: int

    def dealt(self) -> DataFrame:
        parts = max(self.rows.sparkSession.sparkContext.defaultParallelism, -(-self.count // DEALT))
        return self.rows.select("codes", "y", "copies", "key").repartition(parts, "key")

    def each(self, batch: pa.RecordBatch, tops: list[Tree], wanted: dict[int, np.ndarray] | None = None) -> Iterator[tuple]:
        """For every tree, the rows' draws and the nodes of its top that hold some, one by one; ``wanted`` ones alone, if given."""
        codes, y = _codes(batch, self.size), batch.column(1).to_numpy()
        copies, keys = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
        groups = alike(copies)
        for tree in range(self.trees) if wanted is None else wanted:
            # a single tree is fitted to the rows as they are
            w = draws(keys, copies, tree, groups) if self.trees > 1 else copies
            yield tree, codes, w, y, tops[tree].parted(codes, np.flatnonzero(w), wanted and wanted[tree])

    def bare(self) -> Bag:
        """Without the table, as tasks need it."""
        return Bag(None, self.count, self.size, self.trees, self.seed)


def best_cuts(bag: Bag, tops: list[Tree], wanted: dict[tuple[int, int], np.ndarray], bins: int) -> list:
    """For each open node of the tops its best cut and the rows and mean of both sides.

    ``wanted`` has the features of the open nodes. Tasks add up histograms, one row per task and node.
    """
    told = bag.bare()

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, nodes = TaskContext.get().partitionId(), {}, {}
        for tree, node in wanted:
            nodes.setdefault(tree, []).append(node)
        leading = {tree: tops[tree].leading_to(some) for tree, some in nodes.items()}
        for batch in _whole(batches, BATCH):
            for tree, codes, w, y, leaves in told.each(batch, tops, leading):
                wy = w * y
                for node, rows in leaves:
                    features, weight, total = wanted[tree, node], w[rows].astype(float), wy[rows]
                    cells = [codes.T[f][rows].astype(np.int64) for f in features]
                    sums = np.array([[np.bincount(c, x, bins) for c in cells] for x in (None, weight, total)])
                    found[tree, node] = found.get((tree, node), 0.0) + sums
        yield from _sent(((tree, node, part, sums.tobytes()) for (tree, node), sums in found.items()), "tree int, node int, part long, sums binary")

    def best(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        features = wanted[int(key[0]), int(key[1])]
        sums = sum(np.frombuffer(x).reshape(3, len(features), bins) for x in frame.sort_values("part")["sums"])
        rows, w, s = sums.cumsum(2)
        found = gains(w.T, s.T).T
        j, cut = divmod(int(found.argmax()), bins)
        n, weight, total = rows[j], w[j], s[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            sides = total[cut] / weight[cut], (total[-1] - total[cut]) / (weight[-1] - weight[cut])
        return pd.DataFrame([(*map(int, key), found[j, cut], int(features[j]), cut, int(n[cut]), int(n[-1] - n[cut]), total[-1] / weight[-1], *sides)])

    partial = bag.dealt().mapInArrow(histograms, "tree int, node int, part long, sums binary")
    return partial.groupBy("tree", "node").applyInPandas(best, (
        "tree int, node int, gain double, feature int, cut int, left_rows long, right_rows long, "
        "mean double, left_mean double, right_mean double")).collect()


@dataclass(frozen=True)
class ForestModel:
    """Tops of all trees, the paths and depths of their leaves, and the rows to grow the rest from."""

    bag: Bag
    thresholds: list[np.ndarray]
    tops: list[Tree]
    below: dict[tuple[int, int], tuple[int, int]]
    mean: float
    bins: int

    def transform(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """``rows`` with a ``prediction``, the mean over all trees."""
        coded = rows.withColumn("_codes", codes_of(self.thresholds)(vector_to_array(features)))
        kinds = stored(coded.select("_codes").distinct().withColumn("_id", F.monotonically_increasing_id()))
        return coded.join(self._predicted(rows.sparkSession, kinds), "_codes").drop("_codes")

    def save(self, path: str) -> None:
        """The rows as a table and beside them, in one row, what the driver holds."""
        bag = self.bag
        told = json.dumps({
            "bag": [bag.count, bag.size, bag.trees, bag.seed], "mean": self.mean, "bins": self.bins,
            "thresholds": [t.tolist() for t in self.thresholds],
            "tops": [[t.feature.tolist(), t.cut.tolist(), t.left.tolist(), t.value.tolist()] for t in self.tops],
            "below": [[*k, *v] for k, v in self.below.items()]})
        bag.rows.write.mode("overwrite").parquet(f"{path}/rows")
        small_table(bag.rows.sparkSession, [(told,)], T.StructType().add("told", T.StringType())).write.mode("overwrite").parquet(f"{path}/told")

    @classmethod
    def load(cls, path: str) -> ForestModel:
        spark = SparkSession.active()
        told = json.loads(spark.read.parquet(f"{path}/told").first().told)
        kinds = np.int16, np.uint8, np.int32, np.float64
        return cls(
            Bag(spark.read.parquet(f"{path}/rows"), *told["bag"]), [np.array(t) for t in told["thresholds"]],
            [Tree(*(np.array(x, k) for x, k in zip(t, kinds))) for t in told["tops"]],
            {(t, n): (p, d) for t, n, p, d in told["below"]}, told["mean"], told["bins"])

    def _predicted(self, spark: SparkSession, kinds: DataFrame) -> DataFrame:
        """The ``_codes`` of ``kinds`` with their predictions.

        Rows to predict travel as arrays: to the task that grows their node, and their values back to the task that
        adds up all trees. They are told apart by their places in a partition, which is sorted by ids.
        """
        bag, tops, below, bins, mean = self.bag.bare(), self.tops, self.below, self.bins, self.mean
        size, count = bag.size, kinds.count()

        def pieces(rows: np.ndarray) -> Iterator[np.ndarray]:
            return (rows[i : i + PIECE] for i in range(0, len(rows), PIECE))

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def records() -> Iterator[tuple]:
                part = TaskContext.get().partitionId() << 32
                for batch in _whole(batches, BATCH):
                    for tree, codes, w, y, leaves in bag.each(batch, tops):
                        for node, found in leaves:
                            for rows in pieces(found) if (tree, node) in below else ():
                                part += 1
                                yield tree, node, 0, part, len(rows), packed(codes.T[:, rows], w[rows].astype(np.int64), y[rows])

            return _sent(records(), RECORDS)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def records() -> Iterator[tuple]:
                part, first = TaskContext.get().partitionId(), 0
                for number, batch in enumerate(_whole(batches, BATCH)):
                    codes = _codes(batch, size)
                    places = np.arange(first, first + len(codes), dtype=np.uint32)
                    first += len(codes)
                    yield -1 - part, number, 1, part, len(codes), packed(codes.T, places)
                    for tree in range(bag.trees):
                        for node, found in tops[tree].parted(codes, np.arange(len(codes))):
                            for rows in pieces(found):
                                yield tree, node, 1, part, len(rows), packed(codes.T[:, rows], places[rows])

            return _sent(records(), RECORDS)

        def grown(tree: int, node: int, held: list[tuple[int, pa.Buffer]]) -> Tree | None:
            if (tree, node) not in below:  # a leaf of the top
                return Tree(value=tops[tree].value[[node]])
            if not held:
                return None
            path, depth = below[tree, node]
            codes, w, y = zip(*(unpacked(data, n, size, "i8", "f8") for n, data in held))
            return grow(np.concatenate([c.T for c in codes], axis=1).T, np.concatenate(w), np.concatenate(y), np.array([path], np.uint64), depth, bins)

        def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def records() -> Iterator[tuple]:
                key, held, tree = None, [], None
                for *at, kind, part, n, data in _rows(batches):
                    if at[0] < 0:  # no tree: the rows to predict themselves
                        yield part, *at, n, data.to_pybytes()
                        continue
                    if key != at:
                        key, held, tree = at, [], None
                    if kind == 0:
                        held.append((n, data))
                        continue
                    if held is not None:
                        tree, held = grown(*key, held), None
                    if tree is not None:
                        codes, places = unpacked(data, n, size, "u4")
                        yield part, *at, n, packed(places, tree.value[tree.leaves(codes)])

            return _sent(records(), PREDICTED)

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done() -> pa.RecordBatch:
                codes, total, trees = (np.concatenate(x) for x in zip(*held))
                found = np.where(trees > 0, total / np.maximum(trees, 1), mean)
                return pa.RecordBatch.from_arrays([_binary(codes), pa.array(found)], ["_codes", "prediction"])

            key, held, total, trees = None, [], None, None
            for part, tree, _, n, data in _rows(batches):
                if key != part:
                    if held:
                        yield done()
                    key, held, total, trees = part, [], None, None
                if tree < 0:  # these come first, in order
                    codes, _ = unpacked(data, n, size, "u4")
                    held.append((codes, np.zeros(n), np.zeros(n)))
                    continue
                if total is None:
                    codes, total, trees = (np.concatenate(x) for x in zip(*held))
                    held = [(codes, total, trees)]
                places, values = unpacked(data, n, 0, "u4", "f8")[1:]
                total[places] += values
                trees[places] += 1
            if held:
                yield done()

        workers = spark.sparkContext.defaultParallelism
        wide = max(workers, -(-count // ASKED))
        sorted_kinds = kinds.select("_codes", "_id").repartition(wide, "_id").sortWithinPartitions("_id")
        all_rows = self.bag.dealt().mapInArrow(train, RECORDS).unionByName(sorted_kinds.mapInArrow(asked, RECORDS))
        parts = max(8 * workers, -(-(self.bag.count + count) * bag.trees // PAIRS))
        dealt = all_rows.repartition(parts, "tree", "node").sortWithinPartitions("tree", "node", "kind", "part")
        values = dealt.mapInArrow(scores, PREDICTED).repartition(wide, "part").sortWithinPartitions("part", "tree", "node")
        return values.mapInArrow(means, "_codes binary, prediction double")


def codes_of(thresholds: list[np.ndarray]):
    """The bins of a vector's values, a byte each: a value belongs below a threshold it equals."""

    @F.arrow_udf("binary")
    def codes(values: pa.Array) -> pa.Array:
        if not len(values):
            return pa.array([], pa.binary())
        if len(np.unique(values.value_lengths())) != 1:
            raise ValueError("vectors of different lengths")
        wide = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
        return _binary(np.stack([np.searchsorted(t, wide[:, i]) for i, t in enumerate(thresholds)], axis=1).astype(np.uint8))

    return codes


def ranked(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and how often each comes; of more than ``RANKS`` those at equal ranks, for all up to them."""
    order = np.argsort(values, kind="stable") if counts is not None else None
    values = np.sort(values) if order is None else values[order]
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    up_to = ends + 1 if order is None else np.cumsum(counts[order])[ends]
    if len(ends) > RANKS:
        # the middle of each part stands for it, so that errors of rank are of both signs
        marks = np.arange(1, RANKS + 1) * int(up_to[-1]) // RANKS
        middles = np.searchsorted(up_to, marks - int(up_to[-1]) // (2 * RANKS))
        values = values[ends][middles]
        return values, np.diff(marks, prepend=0)
    return values[ends], np.diff(up_to, prepend=0)


def bin_thresholds(rows: DataFrame, size: int, bins: int) -> list[np.ndarray]:
    """For each of the ``size`` elements of ``x`` the upper bounds of its bins but the last.

    Few values have a bin each, with bounds half way between them; others are cut at quantiles.
    """
    marks = [i / bins for i in range(1, bins)]
    item = [F.get("x", F.lit(i)) for i in range(size)]
    told = rows.agg(*[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(item)],
                    *[F.percentile_approx(c, marks).alias(f"q{i}") for i, c in enumerate(item)]).first()
    few = [i for i in range(size) if told[f"d{i}"] <= 2 * bins]
    values = rows.agg(*[F.collect_set(item[i]).alias(f"s{i}") for i in few]).first() if few else None
    out = []
    for i in range(size):
        each = np.unique(values[f"s{i}"]) if i in few else ()
        few_values = i in few and len(each) <= bins
        out.append((each[1:] + each[:-1]) / 2 if few_values else np.unique(told[f"q{i}"]))
    return out


def bin_thresholds_of_many(rows: DataFrame, size: int, bins: int) -> list[np.ndarray]:
    """The same for many rows, which take an aggregate too long that adds them one by one.

    Batches are sorted; the ranks of a feature with more than ``RANKS`` different values are right to about
    1 in ``RANKS``.
    """

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(size)]
        for batch in _whole(batches, BATCH):
            wide = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for i, some in enumerate(held):
                some.append(ranked(wide[:, i]))
                if len(some) == 16:
                    some[:] = [ranked(*map(np.concatenate, zip(*some)))]
        told = ((i, *ranked(*map(np.concatenate, zip(*some)))) for i, some in enumerate(held) if some)
        yield from _sent(((i, len(v), packed(v, n)) for i, v, n in told), "feature int, rows int, data binary")

    def bounds(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(data, n, 0, "f8", "i8")[1:] for n, data in sorted(zip(frame["rows"], frame["data"]))]
        values, counts = map(np.concatenate, zip(*parts))
        each = np.unique(values)
        if len(each) <= bins:
            return pd.DataFrame({"feature": int(key[0]), "bounds": [(each[1:] + each[:-1]) / 2]})
        order = np.argsort(values, kind="stable")
        up_to = np.cumsum(counts[order])
        ranks = [math.ceil(i / bins * int(up_to[-1])) for i in range(1, bins)]
        return pd.DataFrame({"feature": int(key[0]), "bounds": [np.unique(values[order][np.searchsorted(up_to, ranks)])]})

    told = rows.select("x").mapInArrow(summaries, "feature int, rows int, data binary")
    found = told.groupBy("feature").applyInPandas(bounds, "feature int, bounds array<double>").collect()
    return [np.array(r.bounds, float) for r in sorted(found)]


@dataclass(frozen=True)
class Forest:
    """Variance-reducing trees on Poisson bootstraps, square-root feature subsets and binned features.

    Columns ``y`` and ``features``, a vector. ``task_rows`` is the most rows of a node that one task takes.
    """

    trees: int = 100
    depth: int = 30
    seed: int = 0
    bins: int = 32
    task_rows: int = 524_288

    def fit(self, df: DataFrame) -> ForestModel:
        rows = stored(df.select(F.col("y").cast("double").alias("y"), vector_to_array("features").alias("x")))
        useless = F.col("y").isNull() | F.isnan("y") | (F.abs("y") == math.inf) | F.exists("x", F.isnan)
        count, mean, size, bad = rows.agg(
            F.count(F.lit(1)), F.avg("y"), F.max(F.size("x")), F.count_if(useless)).first()
        if not count or bad:
            raise ValueError("rows hold null, NaN or infinite targets or NaN features" if count else "no rows to fit")
        thresholds = (bin_thresholds if count <= MANY else bin_thresholds_of_many)(rows, size, self.bins)
        bag = Bag(*self._bagged(rows, thresholds), size, self.trees, self.seed)
        return ForestModel(bag, thresholds, *self._tops(bag), mean, self.bins)

    def _bagged(self, rows: DataFrame, thresholds: list[np.ndarray]) -> tuple[DataFrame, int]:
        coded = rows.select(codes_of(thresholds)("x").alias("codes"), "y")
        table = stored(coded.groupBy("codes", "y").agg(F.count(F.lit(1)).alias("copies")).withColumn(
            "key", F.xxhash64("codes", "y", F.lit(self.seed))))
        return table, table.count()

    def _tops(self, bag: Bag) -> tuple[list[Tree], dict[tuple[int, int], tuple[int, int]]]:
        """Tops of the trees, and path and depth left of the leaves that tasks grow further."""
        tops = [Tree() for _ in range(self.trees)]
        below = {(t, 0): (int(root_path(t, self.seed)[0]), self.depth) for t in range(self.trees)}
        large = set(below) if bag.count > self.task_rows and self.depth > 0 else set()
        while large:
            paths = np.array([below[k][0] for k in sorted(large)], np.uint64)
            cuts = best_cuts(bag, tops, dict(zip(sorted(large), drawn_features(paths, bag.size))), self.bins)
            large = set()
            for r in sorted(cuts, key=lambda r: (r.tree, r.node)):
                path, depth = below.pop((r.tree, r.node))
                top = tops[r.tree]
                top.value[r.node] = r.mean
                if r.gain <= 0:
                    continue
                left = len(top.feature)
                top.grown(np.array([r.node]), r.feature, r.cut)
                for side, (p, n, m) in enumerate(zip(child_paths(np.array([path], np.uint64)), (r.left_rows, r.right_rows), (r.left_mean, r.right_mean))):
                    top.value[left + side] = m
                    if depth > 1:
                        below[r.tree, left + side] = int(p), depth - 1
                        if n > self.task_rows:
                            large.add((r.tree, left + side))
        return tops, below
