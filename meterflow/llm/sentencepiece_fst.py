"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (a space becomes the mark
U+2581, one more mark goes in front), the pieces, and the byte fallback of characters that no
piece holds. Composing them with a text gives a lattice over its characters; the encoding is
the path of least weight, sums of weights along a path and minima over paths.

In a unigram model a piece weighs its negated log probability. In a BPE model the weight sits
on pairs of neighbours: nothing if merging their characters by rank gives just these two
pieces, infinity otherwise. A sequence is the BPE encoding of its text exactly if all its
pairs are of this kind, so one path has finite weight. The pair machine has as many states as
there are pieces; its arcs are worked out when first needed and kept.

Defined cases: null and empty texts have no tokens; a mark U+2581 in a text is decoded as a
space, as in any SentencePiece model; texts of any length are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Paths of words, paths of parts and arcs of pairs that a task process keeps, twice at most.
MAX_KEPT = 250_000
#: Longer words are not kept.
MAX_WORD = 48


class Kept:
    """A bounded memory: what was not asked for while it filled up once is forgotten."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value
        return value


class Lengths(dict):
    """Where no piece begins with two characters, the first alone may be one."""

    def __init__(self, known: dict[str, tuple[int, ...]], arcs: dict[str, int]) -> None:
        super().__init__(known)
        self.single = arcs

    def __missing__(self, start: str) -> tuple[int, ...]:
        return (1,) if start[0] in self.single else ()


class Transducer:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without a character map are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix = spec.add_dummy_prefix
        types = [p.type for p in proto.pieces]
        if UNUSED in types:
            raise ValueError("models with unused pieces are not supported")
        self.texts = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.arcs = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = types.index(UNKNOWN)
        user = sorted((p.piece for p in proto.pieces if p.type == USER), key=len, reverse=True)
        self.user = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None
        self.longest = max(map(len, self.arcs))
        self.inside = {p[i:i + 2] for p in self.arcs for i in range(len(p) - 1)}
        # words can be taken apart at marks if no piece has a mark after another character
        self.by_words = self.user is None and not any(p[1] == MARK and p[0] != MARK for p in self.inside)
        lengths: dict[str, set[int]] = {}
        for piece in self.arcs:
            lengths.setdefault(piece[:2], set()).add(len(piece))
        for start in list(lengths):
            lengths[start] |= {1} if start[0] in self.arcs else set()
        #: Lengths of the pieces that begin with two given characters, long ones first.
        self.lengths = Lengths({s: tuple(sorted(n, reverse=True)) for s, n in lengths.items()}, self.arcs)
        self.penalty = 10.0 - min((s for s, t in zip(self.scores, types) if t == NORMAL), default=0.0)
        self.outputs = [self._output(p.piece, p.type) for p in proto.pieces]
        self.pairs, self.words, self.parts = Kept(MAX_KEPT), Kept(MAX_KEPT), Kept(MAX_KEPT)

    @staticmethod
    def _output(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        if not self.by_words:
            line = MARK * self.prefix + text.replace(" ", MARK)
            for part in self.user.split(line) if self.user else [line]:
                if self.user and self.user.fullmatch(part):
                    out.append(self.arcs[part])
                else:
                    out.extend(self.path(part))
            return out
        words, spaces = self.words, 0 if self.prefix else -1
        for word in text.split(" "):
            if word:
                if spaces:
                    out.extend(self.path(MARK * (spaces + 1) + word))
                    spaces = 0
                else:
                    out.extend(words.new.get(word) or words.get(word) or self.word(word))
            else:
                spaces += 1
        if spaces > 0:
            out.extend(self.path(MARK * spaces))
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Path of a word after one space."""
        found = tuple(self.path(MARK + word))
        return self.words.put(word, found) if len(word) <= MAX_WORD else found

    def path(self, line: str) -> list[int]:
        """Least path of the lattice of ``line``, taken apart where no piece can reach across."""
        if line[1:].isalpha():
            return self.least(line)
        out, start, inside = [], 0, self.inside
        for i in range(1, len(line)):
            if line[i - 1:i + 1] not in inside:
                out += self.part(line[start:i])
                start = i
        return out + self.least(line[start:]) if start == 0 else out + self.part(line[start:])

    def part(self, line: str) -> list[int]:
        """Path of a part of a word, kept like those of words."""
        found = self.parts.get(line)
        if found is None:
            found = self.least(line)
            if len(line) <= MAX_WORD:
                self.parts.put(line, found)
        return found

    def least(self, line: str) -> list[int]:
        if len(line) == 1:
            found = self.arcs.get(line)
            return [found] if found is not None else self.fallback(line)
        return self.only(line) if self.kind == BPE else self.lightest(line)

    def lightest(self, line: str) -> list[int]:
        """Least path with the weights of a unigram model."""
        n, arcs = len(line), self.arcs
        weight, last, back = [0.0] + [inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                piece = arcs.get(line[i:j])
                if piece is not None:
                    step = -self.scores[piece]
                elif j - i == 1:
                    piece, step = -1, self.penalty
                else:
                    continue
                if weight[i] + step < weight[j]:
                    weight[j], last[j], back[j] = weight[i] + step, piece, i
        pieces = []
        while n:
            pieces.append([last[n]] if last[n] >= 0 else self.fallback(line[back[n]:n]))
            n = back[n]
        return [piece for arc in reversed(pieces) for piece in arc]

    def only(self, line: str) -> list[int]:
        """Least path with the weights of a BPE model: the only one of finite weight.

        A place of the lattice is reached by one finite path at most (the encoding of what lies
        before it), so a depth-first search visits it once; long pieces are tried first.
        """
        n, arcs, pairs, size, lengths = len(line), self.arcs, self.pairs.new, len(self.texts), self.lengths
        dead, starts, pieces = set(), [0], [-1]
        options = [iter(lengths[line[:2]])]
        while True:
            i, before = starts[-1], pieces[-1]
            for k in options[-1]:
                j = i + k
                if j > n or j in dead:
                    continue
                piece = arcs.get(line[i:j])
                if piece is None:
                    continue
                if before >= 0:
                    fits = pairs.get(before * size + piece)
                    if fits is None:
                        fits = self.pair(before, piece)
                    if not fits:
                        continue
                break
            else:
                if line[i] not in arcs and i + 1 not in dead:  # a character that no piece holds
                    j, piece = i + 1, -1
                else:
                    dead.add(i)
                    starts.pop()
                    pieces.pop()
                    options.pop()
                    continue
            starts.append(j)
            pieces.append(piece)
            if j == n:
                break
            options.append(iter(lengths[line[j:j + 2]]))
        out = []
        for start, piece in zip(starts, pieces[1:]):
            if piece >= 0:
                out.append(piece)
            else:
                out += self.fallback(line[start])
        return out

    def pair(self, before: int, piece: int) -> bool:
        """An arc of the pair machine: whether the two may be neighbours."""
        key = before * len(self.texts) + piece
        fits = self.pairs.get(key)
        if fits is None:
            fits = self.pairs.put(key, self.stays_apart(self.texts[before], self.texts[piece]))
        return fits

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both by rank ends with exactly these two."""
        arcs, scores = self.arcs, self.scores
        parts, edge = [*left, *right], len(left)  # edge: number of parts of the left one
        ranks = [scores[m] if (m := arcs.get(a + b)) is not None else -inf for a, b in zip(parts, parts[1:])]
        while ranks:
            best = max(ranks)
            if best == -inf:
                return len(parts) == 2
            at = ranks.index(best)
            if at == edge - 1:
                return False
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            for i in (at - 1, at):
                if 0 <= i < len(ranks):
                    m = arcs.get(parts[i] + parts[i + 1])
                    ranks[i] = scores[m] if m is not None else -inf
            edge -= at < edge
        return False

    def fallback(self, char: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in char.encode()]

    def decode(self, ids) -> str:
        outputs = self.outputs
        text = b"".join([outputs[i] for i in ids])
        if self.prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def compiled(model: bytes) -> Transducer:
    """One transducer per task process, with the paths it has kept."""
    return Transducer(model)


def encode(texts: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """``texts`` with ids (array of int), n_tokens, and lossless: whether decoding gives the text back.

    Columns of these names are replaced. The model file, at most a few MB, is sent to the tasks.
    """
    shared = _shared(texts, model_path)
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()),
             T.StructField("lossless", T.BooleanType())]
    kept = [f for f in texts.schema.fields if f.name not in {a.name for a in added}]
    source = texts.select(*(texts[f.name] for f in kept))
    at, names = source.columns.index(text_column), [*source.columns, *(a.name for a in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [(text, machine.encode(text)) for text in part.column(at).to_pylist()]
                counts = np.array([len(ids) for _, ids in found], np.int32)
                flat = np.concatenate([np.frombuffer(ids, np.int32) for _, ids in found if ids] or [np.zeros(0, np.int32)])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                same = pa.array([machine.decode(ids) == (text or "") for text, ids in found])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, ids, pa.array(counts), same], names=names)

    return source.mapInArrow(run, T.StructType(kept + added))


def decode(tokens: DataFrame, model_path: str, ids_column: str = "ids") -> DataFrame:
    """``tokens`` with a column ``text``; null ids give an empty text."""
    shared = _shared(tokens, model_path)
    kept = [f for f in tokens.schema.fields if f.name != "text"]
    source = tokens.select(*(tokens[f.name] for f in kept))
    at, names = source.columns.index(ids_column), [*source.columns, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(shared.value)
        for batch in batches:
            text = pa.array([machine.decode(ids or []) for ids in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=names)

    return source.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())
