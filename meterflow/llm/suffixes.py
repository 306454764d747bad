"""Repeated substrings by a distributed merge sort of suffixes that knows common prefixes.

Of all suffixes only those at anchors are sorted: an anchor is a place whose gram (a short
string) has the least hash among the grams of some string of ``length`` bytes. Equal strings
have equal anchors, so two places of one string always meet at one. A suffix is sorted by the
``length`` bytes from its anchor on, then by the bytes before the anchor, read backwards.

Each task sorts its suffixes into runs and cuts them by the hash of the gram; runs travel
front-coded (common prefix with the suffix before, and the rest). A loser tree merges the runs
of a part: every node keeps how much of a suffix is common with the last one that came out, so
known prefixes are never compared again. In the merged order the common bytes to the right and
left of any two suffixes of a gram follow, and with them the bytes that a repeated string covers.

Nothing hangs on one key: copies of a whole context collapse in each run before they travel,
and grams in more than ``hot`` contexts are resolved by grouping their strings instead, one
row for each string. Defined cases: null texts are empty; texts shorter than ``length`` keep
all; a repeated row is another place; rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm.common import discard, mixed, prefix_hashes, steps, stored, text_bytes, window_hashes

#: Bytes of a gram at most; never more than half of the repeated string.
GRAM = 40
#: Stands beyond the ends of a text; no UTF-8 text holds it.
END = 0xFF
FLUSH_ANCHORS = 1_000_000
RUN_BYTES = 24 << 20
#: Distinct contexts of a gram up to which pairs are looked at one by one.
PAIRWISE = 48


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``size`` neighbouring values."""
    span = 1
    while span * 2 <= size:
        values = pick(values[:-span], values[span:])
        span *= 2
    return values if span == size else pick(values[:span - size], values[size - span:])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, place in its text, gram hash and context hash of every anchor."""
    gram = min(GRAM, length // 2 or 1)
    first = int(offsets[0])
    data, offsets = data[first:int(offsets[-1])], offsets - first
    n = len(data) - gram + 1
    windows = len(data) - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    at, sums = np.arange(n), prefix_hashes(data)
    hashes = window_hashes(sums, at, at + gram)
    least = _sliding(hashes, length - gram + 1, np.minimum)
    inside = np.zeros(windows + 1, np.int32)  # windows that lie in one text
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.uint64(0))
    pad = np.zeros(length - gram, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), length - gram + 1, np.maximum) == hashes)
    row = np.searchsorted(offsets, chosen, "right") - 1
    context = window_hashes(
        sums, np.maximum(chosen - length + gram, offsets[row]), np.minimum(chosen + length, offsets[row + 1]))
    return row, chosen - offsets[row], hashes[chosen], context


PACKED = "zstd"


@F.arrow_udf(T.BinaryType())
def packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compressed texts, as they travel and are stored; four bytes tell the size."""
    codec = pa.Codec(PACKED)
    for batch in texts:
        raw = (t.encode() for t in batch.fill_null("").to_pylist())
        yield pa.array([len(t).to_bytes(4, "big") + codec.compress(t, asbytes=True) for t in raw], pa.binary())


def unpacked(codec: pa.Codec, value: bytes) -> bytes:
    size = int.from_bytes(value[:4], "big")
    return codec.decompress(value[4:], size, asbytes=True) if size else b""


ANCHOR = T.StructType([
    T.StructField("gram", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("place", T.IntegerType()),
    T.StructField("held", T.IntegerType()), T.StructField("forms", T.IntegerType()), T.StructField("sent", T.BooleanType())])


def anchor_rows(documents: DataFrame, length: int) -> DataFrame:
    """Anchors of (text_key, text); of those of one gram in a task, one is sent.

    ``held`` tells how often the task holds the gram, ``forms`` in how many contexts.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            key, place, gram, context = (np.concatenate(x) for x in zip(*waiting))
            _, once, which, held = np.unique(gram, return_index=True, return_inverse=True, return_counts=True)
            sent = np.zeros(len(gram), bool)
            sent[once] = True
            _, form = np.unique(context, return_index=True)
            forms = np.bincount(which[form], minlength=len(once))
            return pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(key), pa.array(place.astype(np.int32)),
                 pa.array(held[which].astype(np.int32)), pa.array(forms[which].astype(np.int32)), pa.array(sent)],
                names=ANCHOR.names)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            data, offsets = text_bytes(batch.column(1))
            for start, stop in steps(offsets):
                row, place, gram, context = anchors(data, offsets[start:stop + 1], length)
                waiting.append((keys[start + row], place, gram, context))
                if sum(len(x[0]) for x in waiting) >= FLUSH_ANCHORS:
                    yield flush()
                    waiting.clear()
        if waiting:
            yield flush()

    return documents.select("text_key", "text").mapInArrow(find, ANCHOR)


def contexts(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """A row for each anchor: ``length`` bytes from it on, then those before it, backwards."""
    gram = min(GRAM, length // 2 or 1)
    reach = length - gram
    padded = np.full(len(text) + reach + length, END, np.uint8)
    padded[reach:reach + len(text)] = text
    out = np.empty((len(places), length + reach), np.uint8)
    out[:, :length] = np.lib.stride_tricks.sliding_window_view(padded, length)[places + reach]
    out[:, length:] = np.lib.stride_tricks.sliding_window_view(padded, reach)[places][:, ::-1]
    return out


def room(suffix: bytes, length: int, gram: int) -> tuple[int, int]:
    """Bytes of the text before the anchor and behind its gram, as far as the context goes."""
    right, left = suffix.find(END, 0, length), suffix.find(END, length)
    return (len(suffix) - length if left < 0 else left - length), (length if right < 0 else right) - gram


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    a, b = a[start:], b[start:]
    if a == b:
        return start + len(a)
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return start + len(a) - (differ.bit_length() + 7) // 8


class Run:
    """A front-coded sorted run, read suffix by suffix."""

    def __init__(self, shared: np.ndarray, tails: bytes, width: int) -> None:
        self.shared, self.tails, self.width = shared.tolist(), tails, width
        self.at, self.read, self.suffix = -1, 0, b""

    def advance(self) -> int:
        """Go to the next suffix; its common prefix with the one before, or -1 at the end."""
        self.at += 1
        if self.at == len(self.shared):
            return -1
        known = self.shared[self.at]
        stop = self.read + self.width - known
        self.suffix = self.suffix[:known] + self.tails[self.read:stop]
        self.read = stop
        return known


def merge(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place in it, suffix, common prefix with the suffix before) in sorted order.

    ``known[i]`` is the common prefix of run i's suffix with the last suffix that beat it.
    """
    count = len(runs)
    known = [run.advance() for run in runs]  # -1: the run is over
    size = 1
    while size < count:
        size *= 2
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes that with the winner."""
        if a < 0 or known[a] < 0:
            return b, a
        if b < 0 or known[b] < 0:
            return a, b
        if known[a] != known[b]:  # the longer prefix of the last suffix is the lesser string
            return (a, b) if known[a] > known[b] else (b, a)
        x, y, start = runs[a].suffix, runs[b].suffix, known[a]
        both = common(x, y, start)
        if both == len(x) or x[both] < y[both]:
            known[b] = both
            return a, b
        known[a] = both
        return b, a

    level = [i if i < count else -1 for i in range(size)]
    for i in range(count):
        if known[i] >= 0:
            known[i] = 0
    node = size
    while len(level) > 1:
        node //= 2
        above = []
        for i in range(0, len(level), 2):
            winner, loser = play(level[i], level[i + 1])
            losers[node + i // 2] = loser
            above.append(winner)
        level = above
    winner = level[0]
    while winner >= 0 and known[winner] >= 0:
        run = runs[winner]
        yield winner, run.at, run.suffix, known[winner]
        known[winner] = run.advance()
        node = (size + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


BLOCK = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("shared", T.BinaryType()), T.StructField("tails", T.BinaryType()),
    T.StructField("keys", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("sure", T.BinaryType())])
SPAN = T.StructType([
    T.StructField("text_key", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])


def front_coded(suffixes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each row with the one before, and all that follows it."""
    shared = np.zeros(len(suffixes), np.int32)
    if len(suffixes) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), suffixes.shape[1])
    behind = np.arange(suffixes.shape[1]) >= shared[:, None]
    return shared, suffixes[behind].tobytes()


def sorted_runs(places: DataFrame, length: int, parts: int) -> DataFrame:
    """Front-coded blocks of sorted runs of (text_key, text, places), cut by the gram's hash.

    Of equal contexts in a run one travels; ``sure`` marks it, and the others stand beside it
    with a negative number of the suffix they equal.
    """
    gram = min(GRAM, length // 2 or 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(PACKED)
        suffixes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        where: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            run, key, place = np.concatenate(suffixes), np.concatenate(keys), np.concatenate(where)
            part = gram_hashes(run[:, :gram]) % np.uint64(parts)
            order = np.argsort(run.view(f"S{run.shape[1]}").ravel(), kind="stable")
            order = order[np.argsort(part[order], kind="stable")]
            run, key, place, part = run[order], key[order], place[order], part[order]
            rows = []
            for start, stop in _ranges(part):
                one = run[start:stop]
                shared, _ = front_coded(one)
                new = shared < one.shape[1]
                number = np.cumsum(new) - 1
                shared, tails = front_coded(one[new])
                sure = np.bincount(number, minlength=len(shared)) > 1
                rows.append((int(part[start]), shared.astype(np.uint16).tobytes(),
                             len(tails).to_bytes(4, "big") + codec.compress(tails, asbytes=True),
                             key[start:stop].tobytes(), place[start:stop].astype(np.int32).tobytes(),
                             number.astype(np.int32).tobytes() + sure.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 5)], names=BLOCK.names)

        held = 0
        for batch in batches:
            text_keys = batch.column(0).to_numpy()
            for row, own in enumerate(batch.column(2)):
                own = np.sort(np.asarray(own.values.to_numpy(zero_copy_only=False), np.int64))
                text = np.frombuffer(unpacked(codec, batch.column(1)[row].as_py()), np.uint8)
                for at in range(0, len(own), 20_000):
                    some = own[at:at + 20_000]
                    suffixes.append(contexts(text, some, length))
                    keys.append(np.full(len(some), text_keys[row]))
                    where.append(some)
                    held += suffixes[-1].nbytes
                    if held >= RUN_BYTES:
                        yield from flush()
                        suffixes.clear(), keys.clear(), where.clear()
                        held = 0
        if suffixes:
            yield from flush()

    return places.select("text_key", "text", "places").mapInArrow(build, BLOCK)


def gram_hashes(grams: np.ndarray) -> np.ndarray:
    """A hash of each row, one column at a time, so that no wide copy of the rows is made."""
    out = np.zeros(len(grams), np.uint64)
    for column in range(grams.shape[1]):
        out = mixed(out + grams[:, column].astype(np.uint64) + np.uint64(1))
    return out


def _ranges(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    bounds = np.flatnonzero(np.diff(sorted_values)) + 1
    yield from zip([0, *bounds.tolist()], [*bounds.tolist(), len(sorted_values)])


def reaches(suffixes: list[bytes], shared: list[int], sure: list[bool], length: int, gram: int) -> list:
    """For the sorted distinct contexts of one gram, how far repeated strings reach: (left, right).

    ``left`` bytes before the anchor and ``right`` behind its gram, or None. Two contexts with
    ``l`` and ``r`` common bytes share strings of ``length`` bytes if ``l + r`` and the gram are
    that many.
    """
    count, reach = len(suffixes), length - gram
    rooms = [room(s, length, gram) for s in suffixes]
    best = [r if s and r[0] + r[1] >= reach else None for s, r in zip(sure, rooms)]
    if count == 1 or all(b is not None for b in best):
        return best
    if count > PAIRWISE:
        return _swept(suffixes, shared, sure, length, gram, rooms)
    for i in range(count - 1):
        right = length
        for j in range(i + 1, count):
            right = min(right, shared[j])
            if right < gram:
                break
            if best[i] == rooms[i] and best[j] == rooms[j]:
                continue
            left = common(suffixes[i][length:], suffixes[j][length:], 0)
            for x in (i, j):
                l, r = min(left, rooms[x][0]), min(right - gram, rooms[x][1])
                if l + r >= reach:
                    best[x] = (l, r) if best[x] is None else (max(best[x][0], l), max(best[x][1], r))
    return best


def _swept(suffixes, shared, sure, length, gram, rooms) -> list:
    """The same for many contexts: for each way to lay a string over the gram, count the classes."""
    count, reach = len(suffixes), length - gram
    matrix = np.frombuffer(b"".join(suffixes), np.uint8).reshape(count, -1)
    right, many = np.asarray(shared), np.asarray(sure)
    back = np.ascontiguousarray(matrix[:, length:])
    order = np.argsort(back.view(f"S{reach}").ravel(), kind="stable")
    left, _ = front_coded(back[order])
    room_left, room_right = np.array(rooms).T
    most, least = np.full(count, -1), np.full(count, reach + 1)
    for d in range(reach + 1):
        own = np.empty(count, np.int64)
        own[order] = np.cumsum(left < d)
        own = own * (count + 1) + np.cumsum(right < length - d)
        _, which, times = np.unique(own, return_inverse=True, return_counts=True)
        twice = (times[which] > 1) | many
        twice &= (room_left >= d) & (room_right >= reach - d)
        most[twice] = d
        least[twice] = np.minimum(least[twice], d)
    return [(int(m), int(reach - s)) if m >= 0 else None for m, s in zip(most, least)]


def merged_spans(blocks: DataFrame, length: int) -> DataFrame:
    """Spans of bytes that repeated strings cover, from the runs of each part."""
    gram = min(GRAM, length // 2 or 1)

    def resolve(table: pa.Table) -> pa.Table:
        codec = pa.Codec(PACKED)
        runs, keys, places, numbers, sures = [], [], [], [], []
        for row in table.to_pylist():
            tails = codec.decompress(row["tails"][4:], int.from_bytes(row["tails"][:4], "big"), asbytes=True)
            shared = np.frombuffer(row["shared"], np.uint16)
            runs.append(Run(shared, tails, 2 * length - gram))
            keys.append(np.frombuffer(row["keys"], np.int64))
            places.append(np.frombuffer(row["places"], np.int32))
            numbers.append(np.frombuffer(row["sure"][:4 * len(keys[-1])], np.int32))
            sures.append(np.frombuffer(row["sure"][4 * len(keys[-1]):], bool).tolist())
        left = [np.full(len(s), -1, np.int32) for s in sures]
        right = [np.zeros(len(s), np.int32) for s in sures]
        group, suffixes, shared, sure = [], [], [], []

        def settle() -> None:
            if len(group) == 1 and not sure[0]:
                return
            for members, found in zip(group, reaches(suffixes, shared, sure, length, gram)):
                if found is not None:
                    for run, at in members:
                        left[run][at], right[run][at] = found

        width = 2 * length - gram
        for run, at, suffix, known in merge(runs):
            if group and known == width:
                group[-1].append((run, at))
                sure[-1] = True
                continue
            if known < gram and group:
                settle()
                group, suffixes, shared, sure = [], [], [], []
            group.append([(run, at)])
            suffixes.append(suffix)
            shared.append(known)
            sure.append(sures[run][at])
        if group:
            settle()
        out = []
        for run, number in enumerate(numbers):
            l, r = left[run][number], right[run][number]
            found = l >= 0
            place = places[run][found]
            out.append((keys[run][found], place - l[found], place + gram + r[found]))
        key, start, stop = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(key), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=SPAN.names)

    return blocks.groupBy("part").applyInArrow(resolve, SPAN)


def hot_spans(places: DataFrame, length: int) -> DataFrame:
    """Spans of anchors of frequent grams: every string over the gram is a row of its own."""
    gram = min(GRAM, length // 2 or 1)
    reach = length - gram
    kind = T.StructType([
        T.StructField("text_key", T.LongType()), T.StructField("place", T.IntegerType()),
        T.StructField("before", T.IntegerType()), T.StructField("string", T.BinaryType()), T.StructField("copies", T.LongType())])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(PACKED)
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for row, own in enumerate(batch.column(2)):
                text = unpacked(codec, batch.column(1)[row].as_py())
                for place in own.values.to_numpy(zero_copy_only=False):
                    before = np.arange(max(0, place + length - len(text)), min(reach, place) + 1)
                    names = [hashlib.md5(text[place - d:place - d + length]).digest() for d in before]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(before), keys[row])), pa.array(np.full(len(before), place, np.int32)),
                         pa.array(before.astype(np.int32)), pa.array(names, pa.binary()), pa.array(np.ones(len(before), np.int64))],
                        names=kind.names)

    rows = places.select("text_key", "text", "places").mapInArrow(strings, kind)
    twice = rows.groupBy("before", "string").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
    return rows.join(twice, ["before", "string"], "left_semi").groupBy("text_key", "place").agg(
        F.max("before").alias("most"), F.min("before").alias("least")).select(
            "text_key", (F.col("place") - F.col("most")).alias("start"),
            (F.col("place") - F.col("least") + length).cast("int").alias("stop"))


def repeated_spans(documents: DataFrame, length: int = 200, hot: int = 100_000, part_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Texts with possible repeats (text_key, packed text), and spans (text_key, start, stop) to remove.

    ``documents`` has text_key and text. Spans of a text may overlap.
    """
    found = stored(anchor_rows(documents, length))
    everywhere = Window.partitionBy("gram")  # at most one row of a task, so never a hot group
    sums = {"total": F.sum(F.col("held").cast("long")).over(everywhere), "all_forms": F.sum(F.col("forms").cast("long")).over(everywhere)}
    met = stored(found.where("sent").select("gram", "text_key", "place", "held", "forms").withColumns(sums).where("total > 1").select(
        "gram", "text_key", "place", "all_forms"))
    frequent = stored(met.where(F.col("all_forms") > hot).select("gram").distinct().withColumn("hot", F.lit(True)))
    places = met.select("gram", "text_key", "place").union(found.where("not sent").select("gram", "text_key", "place"))
    own = places.join(frequent, "gram", "left").groupBy("text_key").agg(
        F.collect_set(F.when(F.col("hot").isNull(), F.col("place"))).alias("places"),
        F.collect_set(F.when(F.col("hot"), F.col("place"))).alias("hot_places"))
    texts = stored(documents.select("text_key", packed("text").alias("text")).join(own, "text_key"))
    discard(found, met)
    count = texts.agg(F.sum(F.size("places").cast("long"))).first()[0] or 0
    blocks = sorted_runs(texts.where(F.size("places") > 0), length, max(1, -(-count // part_rows)))
    spans = merged_spans(blocks, length)
    if not frequent.isEmpty():
        often = texts.where(F.size("hot_places") > 0).select("text_key", "text", F.col("hot_places").alias("places"))
        spans = spans.union(hot_spans(often, length))
    return texts.select("text_key", "text"), spans


def remove_repeats(documents: DataFrame, length: int = 200, id_column: str = "id", cut_column: str = "cut", texts_too: bool = True, **how) -> DataFrame:
    """``documents`` (id, text and more) with a struct ``cut`` beside their columns.

    It holds kept_text, n_bytes, n_removed, n_spans and kept_sha256. Bytes covered by a string
    of ``length`` bytes that also starts elsewhere are removed. Where that cuts a character,
    what is left of it counts in the digest but is dropped from kept_text. Without
    ``texts_too`` neither the texts nor kept_text are given, so no text moves for them.
    """
    key = F.xxhash64(id_column, "text")
    pairs = documents.select(key.alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    texts, spans = repeated_spans(pairs, length, **how)
    spans = spans.groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    cut = cut_out("text", "spans").alias("__cut")
    if not texts_too:
        cut = cut.dropFields("kept_text").alias("__cut")
    # a repeated row has one text: its copies are put together again after the cut
    cut = texts.join(spans, "text_key").select("text_key", cut).groupBy("text_key").agg(F.first("__cut").alias("__cut"))
    text = F.coalesce("text", F.lit(""))
    whole = F.struct(*([text.alias("kept_text")] if texts_too else []), F.octet_length(text).cast("long").alias("n_bytes"),
                     F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                     F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    kept = [c for c in documents.columns if c != cut_column and (texts_too or c != "text")]
    # the caller's columns travel in a struct, so that no name of theirs meets one of these
    keyed = documents.select(F.struct(*kept).alias("row"), key.alias("text_key"), whole.alias("whole"))
    joined = keyed.join(cut, "text_key", "left")
    return joined.select("row.*", F.coalesce("__cut", "whole").alias(cut_column))


CUT = T.StructType([
    T.StructField("kept_text", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


@F.pandas_udf(CUT)
def cut_out(texts, spans):
    import pandas as pd

    rows, codec = [], pa.Codec(PACKED)
    for text, own in zip(texts, spans):
        data = unpacked(codec, text)
        gone = np.zeros(len(data) + 1, np.int64)
        for span in own:
            gone[span["start"]] += 1
            gone[span["stop"]] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        edges = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        rows.append((kept.decode("utf-8", "ignore"), len(data), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(rows, columns=CUT.names)
