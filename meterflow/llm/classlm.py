"""Class-based bigram model of words (Brown et al., 1992), its classes found by exchange clustering.

P(text) is the product over its tokens of P(class | class before) P(word | class). The classes maximise
the likelihood of the training tokens: in each round every third unit, on the cluster, compares leaving
its class for every other one against the same class counts and takes the best (Uszkoreit and Brants,
2008, do the exchange in parallel likewise); the assignment with the highest likelihood is kept.

What is exchanged are units: each frequent word is one, and the rare words of a form (length and last
two bytes, 4,096 bundles) move together, so every word has a class, unseen ones too. A word is frequent
if it makes up 1/65,536 of all tokens; there cannot be more than 65,536 of them in any corpus. So the
model in the driver and in the tasks has a bounded size, while counts cover all words of all texts: the
vocabulary is a table, joined to the rare words of each text by hash. No key of that join holds more
than 1/65,536 of the tokens.

Smoothing: transitions are drawn to the share of the class, as by ``PRIOR`` tokens; within a class each
word counts one more than it does, and one more word stands for all unseen ones. Both sum to one.

Rules for odd rows: a null text is empty and has the end token alone; a text as long as you like is one
row, worked on in blocks; repeated rows count and are scored each. Without training rows every word is
unseen. Empty tables give no rows. Words are told apart by a 64-bit hash. Other columns are handed on as
asked, whatever their names; one named like a result stands beside it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import (
    discard, list_array, mixed, prefix_hashes, steps, stored, text_bytes, window_hashes, word_spans,
)

#: A word is frequent from this share of all tokens on, so there are at most so many of them.
MOST_FREQUENT = 1 << 16
FORMS = 4096
CLASSES = 64
ROUNDS = 12
#: A third of the units may move in a round: neighbours that move together spoil each other's gain.
TURNS = 3
PRIOR = 64.0
#: Tokens that a task gathers before it counts them.
GATHER = 1 << 22


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and form of each word of some texts, and the number of the first word of each text."""
    data, start, stop, first = word_spans(data, offsets)
    hashes = window_hashes(prefix_hashes(data), start, stop).view(np.int64)
    length = stop - start
    last = data[stop - 1].astype(np.uint64) if len(stop) else np.zeros(0, np.uint64)
    before = np.where(length > 1, data[np.maximum(stop - 2, 0)], 0).astype(np.uint64) if len(stop) else last
    shape = last | before << np.uint64(8) | np.minimum(length // 3, 4).astype(np.uint64) << np.uint64(16)
    return hashes, (mixed(shape + np.uint64(1)) % np.uint64(FORMS)).astype(np.int32), first


def _blocks(batches, column: str):
    """Hashes, forms and first words of blocks of texts, with their batch and rows."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        for row, stop in steps(offsets):
            yield batch, row, stop, *words(data, offsets[row:stop + 1])


# -- counting -----------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["hash", "form", "seen", "total"]
    held, size = [], 0

    def flushed():
        hashes, forms, learns = (np.concatenate(x) for x in zip(*held))
        known, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        counts = [np.bincount(back, w, len(known)).astype(np.int64) for w in (learns, None)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (known, forms[at], *counts)], names)

    for batch, row, stop, hashes, forms, first in _blocks(batches, "text"):
        learns = batch.column(batch.schema.get_field_index("learns")).to_numpy(zero_copy_only=False)[row:stop]
        held.append((hashes, forms, np.repeat(learns.astype(np.float64), np.diff(first))))
        size += len(hashes)
        if size >= GATHER:
            yield flushed()
            held, size = [], 0
    if held:
        yield flushed()


def vocabulary(docs: DataFrame) -> DataFrame:
    """Every word of ``text`` by hash: its form, its tokens in rows that ``learns`` and in all rows."""
    counted = docs.select("text", "learns").mapInArrow(_count_words, "hash long, form int, seen long, total long")
    return counted.groupBy("hash").agg(
        F.first("form").alias("form"), F.sum("seen").alias("seen"), F.sum("total").alias("total"))


@dataclass(frozen=True)
class Units:
    """What has a class: frequent words (their hashes ascending), forms, and the end of a text."""

    hashes: np.ndarray

    @property
    def end(self) -> int:
        return len(self.hashes) + FORMS

    @property
    def size(self) -> int:
        return self.end + 1

    def of(self, hashes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of each word, and whether it is a frequent word."""
        if not len(self.hashes):
            return forms.astype(np.int64), np.zeros(len(forms), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        frequent = self.hashes[at] == hashes
        return np.where(frequent, at, len(self.hashes) + forms.astype(np.int64)), frequent

    def chain(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The texts of a block as one run of units: an end before the first and after each."""
        out = np.full(len(units) + len(first), self.end, np.int64)
        texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
        out[np.arange(len(units)) + texts + 1] = units
        return out


def _pair_counter(units: Units):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed():
            known, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(known), pa.array(counts.astype(np.int64))], ["pair", "n"])

        for _, _, _, hashes, forms, first in _blocks(batches, "text"):
            chain = units.chain(units.of(hashes, forms)[0], first)
            held.append(chain[:-1] * units.size + chain[1:])
            size += len(chain)
            if size >= GATHER:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    return count


def contexts(docs: DataFrame, units: Units) -> DataFrame:
    """Per unit the units before and after it, with counts, over the rows that ``learns``.

    A unit has as many neighbours as there are units at most.
    """
    pairs = docs.where("learns").select("text").mapInArrow(_pair_counter(units), "pair long, n long")
    pairs = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.select(
        F.expr(f"CAST(pair DIV {units.size}L AS INT)").alias("a"), F.expr(f"CAST(pair % {units.size}L AS INT)").alias("b"), "n"))
    sides = []
    for unit, other, names in (("a", "b", ("after", "n_after")), ("b", "a", ("before", "n_before"))):
        listed = pairs.groupBy(F.col(unit).alias("unit")).agg(F.collect_list(F.struct(other, "n")).alias("l"))
        sides.append(listed.select("unit", F.col(f"l.{other}").alias(names[0]), F.col("l.n").alias(names[1])))
    out = stored(sides[0].join(sides[1], "unit", "full"))
    discard(pairs)
    return out


# -- exchange -----------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(matrix: np.ndarray) -> float:
    """What the classes decide about the log-likelihood of the training tokens."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def gains(matrix: np.ndarray, before: np.ndarray, after: np.ndarray, itself: float, own: int) -> np.ndarray:
    """Change of the likelihood if a unit of class ``own`` moves to each class.

    ``before`` and ``after`` count the classes next to the unit, ``itself`` how often it follows itself.
    """
    left, right = before.astype(float), after.astype(float)
    left[own] -= itself
    right[own] -= itself
    rest = matrix.astype(float)
    rest[own] -= right
    rest[:, own] -= left
    rest[own, own] -= itself
    # what stands before the unit is still followed, whatever class the unit is in
    rows, columns = rest.sum(1) + left, rest.sum(0) + right
    kept = _xlogx(rest)
    row = _xlogx(rest + right[None, :]) - kept
    column = _xlogx(rest + left[:, None]) - kept
    corner = rest.diagonal()
    both = _xlogx(corner + left + right + itself) - kept.diagonal()
    worth = row.sum(1) - row.diagonal() + column.sum(0) - column.diagonal() + both
    worth -= _xlogx(rows + right.sum() + itself) - _xlogx(rows)
    worth -= _xlogx(columns + left.sum() + itself) - _xlogx(columns)
    return worth - worth[own]


def _sides(batch: pa.RecordBatch, classes: np.ndarray, n_classes: int):
    """Per row its unit, the classes before and after it, and how often it follows itself."""
    columns = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
    unit = columns["unit"].to_numpy()
    for i, u in enumerate(unit):
        found, itself = [], 0.0
        for side in ("before", "after"):
            ids, n = columns[side][i].values, columns[f"n_{side}"][i].values
            if ids is None:
                found.append(np.zeros(n_classes))
                continue
            ids, n = ids.to_numpy(), n.to_numpy()
            found.append(np.bincount(classes[ids], n, n_classes))
            if side == "after":
                itself = float(n[ids == u].sum())
        yield int(u), *found, itself


def _class_counts(table: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often each class follows each other one; every task adds up its units first."""
    def count(batches):
        total = np.zeros((n_classes, n_classes))
        for batch in batches:
            for u, _, after, _ in _sides(batch, classes, n_classes):
                total[classes[u]] += after
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b].astype(np.int64))], ["a", "b", "n"])

    rows = table.select("unit", "before", "n_before", "after", "n_after").mapInArrow(
        count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    matrix = np.zeros((n_classes, n_classes))
    for a, b, n in rows:
        matrix[a, b] = n
    return matrix


def _moves(table: DataFrame, classes: np.ndarray, matrix: np.ndarray, turn: int, end: int) -> list:
    """The best class of every unit whose turn it is, where that is not its own."""
    n_classes = len(matrix)

    def move(batches):
        found = []
        for batch in batches:
            for u, before, after, itself in _sides(batch, classes, n_classes):
                if u != end and int(mixed(np.uint64([u + 1]))[0] % np.uint64(TURNS)) == turn:
                    gain = gains(matrix, before, after, itself, classes[u])
                    gain[0] = -np.inf  # the class of the end alone
                    best = int(gain.argmax())
                    if gain[best] > 1e-9:
                        found.append((u, best))
        units, to = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(to, pa.int32())], ["unit", "to"])

    return table.mapInArrow(move, "unit int, to int").collect()


def exchange(table: DataFrame, units: Units, weights: np.ndarray, n_classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of every unit, how often classes follow each other, and the likelihood of every round."""
    classes = np.zeros(units.size, np.int64)
    order = np.argsort(-weights[:units.end], kind="stable")
    classes[order] = 1 + np.arange(units.end) % (n_classes - 1)
    best, trace = None, []
    for turn in range(rounds + 1):
        matrix = _class_counts(table, classes, n_classes)
        trace.append(likelihood(matrix))
        if best is None or trace[-1] > best[0]:
            best = (trace[-1], classes.copy(), matrix)
        if turn < rounds:
            for unit, to in _moves(table, classes, matrix, turn % TURNS, units.end):
                classes[unit] = to
    return best[1], best[2], trace


# -- the model ----------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """A fitted model. ``words`` is the vocabulary table; the arrays have a bounded size."""

    units: Units
    classes: np.ndarray
    steps: np.ndarray
    widths: np.ndarray
    counts: np.ndarray
    ends: int
    tokens: int
    types: int
    words: DataFrame
    trace: list[float]

    def parts(self) -> "Parts":
        return Parts(self.units, self.classes, np.log10(self.steps), np.log10(self.widths),
                     np.log10(self.counts + 1.0), self.counts > 0, float(np.log10(self.ends + 1)), self.ends > 0,
                     float(np.log10(self.tokens + self.types + 1)))


@dataclass(frozen=True)
class Parts:
    """The logarithms a task needs."""

    units: Units
    classes: np.ndarray
    steps: np.ndarray
    widths: np.ndarray
    counts: np.ndarray
    known: np.ndarray
    end_count: float
    end_known: bool
    base_width: float


def learn(docs: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS, most_frequent: int = MOST_FREQUENT) -> Model:
    """Fit on the rows of ``docs`` (``text``) that ``learns``; what is frequent is told by all rows."""
    docs = docs.select("text", F.coalesce("learns", F.lit(False)).alias("learns"))
    table = stored(vocabulary(docs))
    sums = table.agg(F.sum("seen"), F.count_if(F.col("seen") > 0), F.sum("total")).first()
    ends = docs.where("learns").count()
    seen, types, total = (int(x or 0) for x in sums)
    frequent = F.col("total") * most_frequent >= total
    head = sorted((r.hash, r.seen) for r in table.where(frequent).select("hash", "seen").collect())
    rest = table.where(~frequent)
    units = Units(np.array([h for h, _ in head], np.int64))
    counts = np.array([n for _, n in head], np.int64)
    by_form = rest.groupBy("form").agg(F.sum("seen"), F.count_if(F.col("seen") > 0)).collect()  # 4,096 rows at most
    weights, kinds = np.zeros(units.size), np.zeros(units.size)
    weights[:len(counts)], kinds[:len(counts)] = counts, counts > 0
    for form, n, types_of in by_form:
        weights[len(counts) + form], kinds[len(counts) + form] = n, types_of
    neighbours = contexts(docs, units)
    classes, matrix, trace = exchange(neighbours, units, weights, n_classes, rounds)
    discard(neighbours)
    share = (matrix.sum(0) + 1) / (matrix.sum() + n_classes)
    transitions = (matrix + PRIOR * share) / (matrix.sum(1, keepdims=True) + PRIOR)
    widths = np.bincount(classes, weights + kinds, n_classes) + 1.0
    return Model(units, classes, transitions, widths, counts, ends, seen + ends, types + (ends > 0),
                 table, trace)


def _scorer(parts: Parts):
    units = parts.units

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, stop, hashes, forms, first in _blocks(batches, "text"):
            unit, frequent = units.of(hashes, forms)
            n_texts, n_words = stop - row, np.diff(first)
            text = np.repeat(np.arange(n_texts), n_words)
            chain = parts.classes[units.chain(unit, first)]
            of_step = np.repeat(np.arange(n_texts), n_words + 1)
            moves = np.bincount(of_step, parts.steps[chain[:-1], chain[1:]], n_texts)
            common = unit[frequent]
            per = lambda where, what=None: np.bincount(text[where], what, n_texts)
            heads = per(frequent, parts.counts[common]) if len(common) else np.zeros(n_texts)
            known = per(frequent, parts.known[common]) if len(common) else np.zeros(n_texts)
            widths = per(slice(None), parts.widths[parts.classes[unit]])
            rare_text, rare_hash = text[~frequent], hashes[~frequent]
            order = np.lexsort((rare_hash, rare_text))
            rare_text, rare_hash = rare_text[order], rare_hash[order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (rare_text[1:] != rare_text[:-1]) | (rare_hash[1:] != rare_hash[:-1])
            at = np.flatnonzero(fresh)
            times = np.diff(np.append(at, len(order)))
            sizes = np.bincount(rare_text[at], minlength=n_texts)
            columns = [
                batch.column(batch.schema.get_field_index("kept")).slice(row, n_texts),
                pa.array((n_words + 1).astype(np.int64)),
                pa.array(known.astype(np.int64) + int(parts.end_known)),
                pa.array(heads + parts.end_count - (n_words + 1) * parts.base_width),
                pa.array(heads - widths + moves),
                list_array(rare_hash[at], sizes, pa.int64()), list_array(times, sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["kept", "n_tokens", "n_known", "base_score", "score", "rare", "times"])

    return score


def score(docs: DataFrame, model: Model, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with tokens, known tokens and log10 probability of its
    ``text`` by counts of single words (``base_score``) and by the model (``score``)."""
    inner = docs.select(F.struct(*keep).alias("kept"), "text")
    schema = (f"kept {inner.schema['kept'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, "
              "score double, rare array<long>, times array<long>")
    # row numbers are stored with the rows, so that a task that runs again sees the same ones
    fixed = stored(inner.mapInArrow(_scorer(model.parts()), schema).withColumn("row", F.monotonically_increasing_id()))
    rare = fixed.select("row", F.explode(F.arrays_zip("rare", "times")).alias("e")).select(
        "row", F.col("e.rare").alias("hash"), F.col("e.times").alias("times"))
    seen = model.words.where("seen > 0").select("hash", "seen")
    found = rare.join(seen, "hash").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("seen") + 1)).alias("more"), F.sum("times").alias("known"))
    out = fixed.drop("rare", "times").join(found, "row", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select("kept.*", "n_tokens", (F.col("n_known") + known).alias("n_known"),
                      (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def perplexity(score: str = "score", tokens: str = "n_tokens") -> Column:
    return F.pow(F.lit(10.0), -F.col(score) / F.col(tokens))
