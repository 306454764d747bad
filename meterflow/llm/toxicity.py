"""Toxicity of texts by a weighted lexicon.

Null and empty texts get the score of a text without any match. Equal texts get equal scores.
Rows without a label, or with a null one, teach nothing; an id labelled several times counts as
toxic if any of its labels says so. Without any toxic example the lexicon is empty and every
score is the smoothed share of toxic examples.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets that look like Latin ones, and digits or signs
# that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u",
    "ı": "i", "ɡ": "g", "ʟ": "l", "ո": "n", "ս": "u",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_FOLD = str.maketrans(HOMOGLYPHS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
                      | {chr(c): None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)})
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_WORD = re.compile(r"[^\W_][\w@$!]*")
_DISGUISED = re.compile(r"[0-9@$!]")
#: Letters at the start of a word that make a stem.
STEM_LETTERS = (4, 5, 6)


def folded_words(text: str) -> list[str]:
    """Words in lower case, look-alike letters and substituted digits as the letters meant."""
    words = _WORD.findall((text or "").lower().translate(_FOLD))
    return [_plain(w) if _DISGUISED.search(w) else w for w in words]


def _plain(word: str) -> str:
    bare = word.rstrip("!$@")
    if not any(c.isalpha() for c in bare):
        return bare
    return bare.translate(_SUBSTITUTE)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def terms(text: str) -> list[str]:
        words = set(folded_words(text))
        out = {f" {w} " for w in words}
        for n in STEM_LETTERS:
            out.update(f" {w[:n]}" for w in words if len(w) > n)
        return list(out)

    for batch in texts:
        yield batch.map(terms)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _phrases(texts: pd.Series, found: pd.Series) -> pd.Series:
    """Word pairs with one of the terms found in them."""
    def phrases(text: str, terms: np.ndarray) -> list[str]:
        words, out = folded_words(text), set()
        for a, b in zip(words, words[1:]):
            pair = f" {a} {b} "
            if any(t in pair for t in terms):
                out.add(pair)
        return list(out)

    return pd.Series([phrases(t, f) for t, f in zip(texts, found)])


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights, phrases in which terms are harmless, and the logistic curve.

    A term with a space at both ends is a word, one with a space in front a stem.
    """

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            machine.add_word(phrase, (len(phrase), None))
        machine.make_automaton()
        return machine

    @staticmethod
    def features(machine: ahocorasick.Automaton, text: str) -> tuple[float, float]:
        """Total weight of the matches, and weight per hundred words."""
        words = folded_words(text)
        if not words or not len(machine):
            return 0.0, 0.0
        harmless, best = [], {}
        line = " " + " ".join(words) + " "
        for end, (length, weight) in machine.iter(line):
            start = end - length + 1
            if weight is None:
                harmless.append((start, end))
            else:  # a word and its stems are one match: the heaviest counts
                best[start] = max((weight, end), best.get(start, (0.0, 0)))
        total, at, reach, bounds = 0.0, 0, -1, sorted(harmless)
        for start in sorted(best):
            while at < len(bounds) and bounds[at][0] <= start:
                reach = max(reach, bounds[at][1])
                at += 1
            weight, end = best[start]
            if end > reach:
                total += weight
        return total, 100.0 * total / len(words)

    def scores(self, texts: pd.Series) -> np.ndarray:
        machine = self.automaton()
        found = np.array([self.features(machine, t) for t in texts]).reshape(-1, 2)
        return _curve(found, np.array(self.curve))


def _inputs(found: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(found), np.ones(len(found))])


def _curve(found: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip((_inputs(found) * curve).sum(1), -30, 30)))


def fit_curve(found: np.ndarray, toxic: np.ndarray, counts: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple:
    """Logistic regression of the labels on the two features, by Newton steps; a row counts ``counts`` times."""
    x, w = _inputs(found), np.zeros(3)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (p - toxic)) + ridge * w
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def learn(
    texts: DataFrame, labels: DataFrame, fit_rows: int = 8_000, max_terms: int = 4_000,
    min_toxic: int = 5, min_odds: float = 20.0, exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learn weights from labelled texts: ``texts`` (id, text), ``labels`` (id, toxic).

    ``fit_rows`` bounds the labelled rows of either class that are used, those with the least
    hash of the id. Terms are words and stems found in ``min_toxic`` toxic rows or more whose
    odds of being toxic exceed the average odds ``min_odds`` times; their weight is the log of
    that ratio. Word pairs around a term that clean rows hold more often than toxic ones do
    become exception phrases, beside those given. For the curve a row of a class counts as many
    times as the class has labelled ids for each one used, so scores keep the share of all labels.
    """
    marks = labels.select("id", "toxic").where("id is not null and toxic is not null").groupBy("id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.join(texts.select("id"), "id", "left_semi")
    totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = F.xxhash64("id")
    chosen = marks.where("toxic = 1").orderBy(order, "id").limit(fit_rows).unionByName(
        marks.where("toxic = 0").orderBy(order, "id").limit(fit_rows))
    rows = texts.select("id", "text").join(F.broadcast(chosen), "id")  # at most 2 x fit_rows ids
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return Lexicon({}, tuple(exceptions), (0.0, 0.0, math.log(0.5 / (totals.get(0, 0) + 0.5))))
    odds = ((F.col("bad") + 0.5) / (bad + 1.0)) / ((F.col("good") + 0.5) / (good + 1.0))
    terms = rows.select("toxic", F.explode(_terms("text")).alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    kept = terms.where(F.col("bad") >= min_toxic).withColumn("odds", odds).where(F.col("odds") >= min_odds)
    # max_terms bounds what the driver holds and the tasks get
    weights = {r.term: math.log(r.odds) for r in kept.orderBy(F.desc("odds"), "term").limit(max_terms).collect()}
    plain = Lexicon(weights, tuple(exceptions), (0.0, 0.0, 0.0))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = plain.automaton()
        for batch in batches:
            yield batch.map(lambda text: _held(machine, text))

    pairs = rows.withColumn("found", held("text")).where(F.size("found") > 0).select(
        "toxic", F.explode(_phrases("text", "found")).alias("phrase")).groupBy("phrase").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    harmless = [r.phrase for r in pairs.where((F.col("good") >= min_toxic) & (odds < 1.0)).orderBy(
        F.desc("good"), "phrase").limit(max_terms).collect()]
    lexicon = Lexicon(weights, tuple(dict.fromkeys([*exceptions, *harmless])), (0.0, 0.0, 0.0))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for batch in batches:
            found = np.array([lexicon.features(machine, t) for t in batch["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1], "toxic": batch["toxic"]})

    sample = rows.select("text", "toxic").mapInPandas(features, "a double, b double, toxic int").toPandas()
    found, toxic = sample[["a", "b"]].to_numpy(), sample["toxic"].to_numpy(float)
    stands = [totals.get(c, 0) / min(max(totals.get(c, 0), 1), fit_rows) for c in (0, 1)]
    counts = np.where(toxic == 1, stands[1], stands[0])
    counts *= len(counts) / counts.sum()
    return Lexicon(lexicon.weights, lexicon.exceptions, fit_curve(found, toxic, counts))


def _held(machine: ahocorasick.Automaton, text: str) -> list[str]:
    line = " " + " ".join(folded_words(text)) + " "
    if not len(machine):
        return []
    return list({line[end - length + 1:end + 1] for end, (length, _) in machine.iter(line)})


def score(texts: DataFrame, lexicon: Lexicon, text_column: str = "text") -> DataFrame:
    """``texts`` with a column ``score`` from 0 to 1; a column of that name is replaced."""
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)  # at most max_terms terms

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(shared.value.scores(batch))

    return texts.withColumn("score", scored(text_column))
