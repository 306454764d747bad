"""Quality classifier by co-training of a content view and a metadata view.

The content view sees the text alone, the metadata view the language, source and length
columns alone. Defined cases: a null or empty text has all content features 0; null metadata
is a category of its own; rows without a label, or with a null one, teach nothing; an id
labelled several times counts as low quality if any label says so; equal rows get equal
scores; with labels of one class only every score is that class's smoothed share. Columns of
the caller never clash: the features live in one array column that is dropped again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT = 12
#: Hashed places for each of the categories of the metadata view.
PLACES = 64
METADATA = 3 + 2 * PLACES
SCORES = ("quality", "content_score", "metadata_score")

_KIND = np.zeros(256, np.int64)  # 0 other
for _code in range(256):
    _char = chr(_code)
    if _code >= 128:
        _KIND[_code] = 5
    elif _char.isupper():
        _KIND[_code] = 1
    elif _char.islower():
        _KIND[_code] = 2
    elif _char.isdigit():
        _KIND[_code] = 3
    elif _char.isspace():
        _KIND[_code] = 4
    elif _char in ".,;:'\"()-?":
        _KIND[_code] = 6
    else:
        _KIND[_code] = 7


def content_features(text: str | None) -> list[float]:
    """Shares of kinds of characters and of kinds of words, over the whole text."""
    if not text:
        return [0.0] * CONTENT
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[data], minlength=8) / len(data)
    words = text.split()
    count = max(len(words), 1)
    repeated = sum(a == b for a, b in zip(words, words[1:]))
    loud = sum(map(str.isupper, words))
    return [*kinds[1:8].tolist(), len(set(words)) / count, repeated / count, loud / count,
            len(text) / count / 10.0, np.log1p(count) / 10.0]


def metadata_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(METADATA)
    known = n_chars is not None and np.isfinite(n_chars)
    size = np.log1p(max(float(n_chars), 0.0)) / 10.0 if known else 0.0
    out[:3] = [size, size * size, not known]
    out[3 + _place(lang)] = 1.0
    out[3 + PLACES + _place(source)] = 1.0
    return out


def _place(value: str | None) -> int:
    return zlib.crc32(("" if value is None else "=" + str(value)).encode()) % PLACES


@dataclass(frozen=True)
class View:
    """Logistic regression over standardised features, with a calibration line."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        # summed row by row: a matrix product may round equal rows of two batches differently
        raw = (np.clip((x - self.mean) / self.scale, -8, 8) * self.weights[:-1]).sum(1) + self.weights[-1]
        return self.line[0] * raw + self.line[1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, counts: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by Newton steps.

    A row counts ``counts`` times.
    """
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        curvature = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(curvature, x.T @ (counts * (p - y)) + penalty * w)
        w = w - move / max(1.0, np.abs(move).max() / 5.0)
        if np.abs(move).max() < 1e-7:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float, counts: np.ndarray) -> View:
    mean = np.average(x, 0, counts)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, counts))
    scale = np.where(scale > 1e-9, scale, 1.0)
    return View(mean, scale, fit_logistic(np.clip((x - mean) / scale, -8, 8), y, ridge, counts))


def calibrated(view: View, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> View:
    """``view`` with its logits put on the line that fits held-out labels."""
    slope, offset = fit_logistic(view.logits(x)[:, None], y, 1e-3, counts)
    return View(view.mean, view.scale, view.weights, (float(slope), float(offset)))


@dataclass(frozen=True)
class Model:
    """Two calibrated views and the weights that combine their logits."""

    content: View
    metadata: View
    weights: np.ndarray

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = self.content.logits(content), self.metadata.logits(metadata)
        return sigmoid(a * self.weights[0] + b * self.weights[1] + self.weights[2]), sigmoid(a), sigmoid(b)


def cotrain(
    content: np.ndarray, metadata: np.ndarray, y: np.ndarray, pool: tuple[np.ndarray, np.ndarray],
    rounds: int = 5, share: float = 0.02, confidence: float = 0.9, ridge: float = 1.0,
    counts: np.ndarray | None = None,
) -> Model:
    """Train both views on labels and on each other's confident pseudo-labels.

    Every fourth labelled row is kept for calibration. In each round a view names the rows of
    ``pool`` that it is surest of, at most ``share`` of the pool, in the proportion of the
    labelled classes and only at ``confidence`` or more; they join the other view's examples. ``counts`` says how many
    rows a labelled row stands for, on any scale, where classes were sampled at different rates.
    """
    counts = np.ones(len(y)) if counts is None else counts * (len(y) / max(counts.sum(), 1e-300))
    held = np.arange(len(y)) % 4 == 3
    train, given, times = [content[~held], metadata[~held]], y[~held], counts[~held]
    if len(set(given)) < 2 or len(set(y[held])) < 2:
        ones = (counts * y).sum()
        level = np.log((ones + 0.5) / (len(y) - ones + 0.5))
        flat = [View(np.zeros(n), np.ones(n), np.append(np.zeros(n), level)) for n in (CONTENT, METADATA)]
        return Model(*flat, np.array([1.0, 0.0, 0.0]))
    names: list[dict[int, float]] = [{}, {}]  # pseudo-labels given to each view
    views = [fit_view(x, given, ridge, times) for x in train]
    good = np.average(given, weights=times)
    for _ in range(rounds if len(pool[0]) else 0):
        added = 0
        for me, other in ((0, 1), (1, 0)):
            p = sigmoid(views[me].logits(pool[me]))
            order = np.lexsort((np.arange(len(p)), -p))
            most = int(np.ceil(share * len(p)))
            sure = [(i, 1.0) for i in order if p[i] >= confidence and i not in names[other]][: int(np.ceil(most * good))]
            sure += [(i, 0.0) for i in order[::-1] if 1 - p[i] >= confidence and i not in names[other]][: int(np.ceil(most * (1 - good)))]
            names[other].update((int(i), label) for i, label in sure)
            added += len(sure)
        if not added:
            break
        for me in (0, 1):
            rows = np.fromiter(names[me], int, len(names[me]))
            labels = np.fromiter(names[me].values(), float, len(names[me]))
            views[me] = fit_view(np.vstack([train[me], pool[me][rows]]), np.append(given, labels), ridge,
                                 np.append(times, np.ones(len(rows))))
    views = [calibrated(v, x[held], y[held], counts[held]) for v, x in zip(views, (content, metadata))]
    both = np.column_stack([v.logits(x[held]) for v, x in zip(views, (content, metadata))])
    return Model(*views, fit_logistic(both, y[held], 1e-2, counts[held]))


def _features(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([content_features(t) for t in batch["text"]]).reshape(-1, CONTENT)
    columns = (batch["lang"], batch["source"], batch["n_chars"])
    metadata = np.array([
        metadata_features(*(None if pd.isna(v) else v for v in row)) for row in zip(*columns)]).reshape(-1, METADATA)
    return content, metadata


def learn(documents: DataFrame, labels: DataFrame, fit_rows: int = 8_000, pool_rows: int = 8_000, **how) -> Model:
    """Co-train on labelled and unlabelled documents.

    ``documents`` has doc_id, text, lang, source and n_chars, ``labels`` doc_id and quality
    (1 good, 0 low). ``fit_rows`` bounds the labelled rows of either class and ``pool_rows``
    the unlabelled ones that are used, those with the least hash of the id. Rows of a class count
    as many times as it has labelled ids for each one used, so scores keep the shares of all labels.
    """
    marks = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy(
        "doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    order = F.xxhash64("doc_id")
    ids = documents.select("doc_id").where("doc_id is not null")
    chosen = marks.join(ids, "doc_id", "left_semi")
    sizes = {r["quality"]: r["count"] for r in chosen.groupBy("quality").count().collect()}
    free = ids.join(marks, "doc_id", "left_anti")
    picked = [chosen.where("quality = 1").orderBy(order, "doc_id").limit(fit_rows),
              chosen.where("quality = 0").orderBy(order, "doc_id").limit(fit_rows),
              free.distinct().orderBy(order, "doc_id").limit(pool_rows).withColumn("quality", F.lit(None).cast("int"))]
    sample = picked[0].unionByName(picked[1]).unionByName(picked[2])
    columns = [F.col(c).alias(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]
    rows = documents.select(*columns).join(F.broadcast(sample), "doc_id")  # at most 24,000 ids

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            content, _ = _features(batch)
            out = batch[["doc_id", "lang", "source", "n_chars", "quality"]].copy()
            out["content"] = list(content)
            yield out

    kinds = {f.name: f.dataType for f in documents.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("doc_id", "lang", "source", "n_chars")] + [
        T.StructField("quality", T.IntegerType()), T.StructField("content", T.ArrayType(T.DoubleType()))])
    found = rows.mapInPandas(features, schema).toPandas()
    found = found.assign(key=[zlib.crc32(str(i).encode()) for i in found["doc_id"]]).sort_values(["key", "doc_id"], kind="stable")
    content = np.array(found["content"].tolist()).reshape(-1, CONTENT)
    metadata = np.array([metadata_features(*(None if pd.isna(v) else v for v in row)) for row in
                         zip(found["lang"], found["source"], found["n_chars"])]).reshape(-1, METADATA)
    known = found["quality"].notna().to_numpy()
    y = found["quality"].to_numpy(float, na_value=np.nan)[known]
    stands = [sizes.get(c, 0) / min(max(sizes.get(c, 0), 1), fit_rows) for c in (0, 1)]
    counts = np.where(y == 1, stands[1], stands[0])
    return cotrain(content[known], metadata[known], y, (content[~known], metadata[~known]), counts=counts, **how)


def quality_column(documents: DataFrame, model: Model) -> Column:
    """A struct of quality (0 to 1, higher is better), content_score and metadata_score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in SCORES])

    @F.pandas_udf(kind)
    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            batch = pd.DataFrame(dict(zip(("text", "lang", "source", "n_chars"), columns)))
            yield pd.DataFrame(dict(zip(SCORES, shared.value.scores(*_features(batch)))))

    return scored("text", "lang", "source", "n_chars")


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with the three scores as columns; columns of their names are replaced."""
    kept = [c for c in documents.columns if c not in SCORES]
    marked = documents.select(*kept, quality_column(documents, model).alias("__scores__"))
    return marked.select(*kept, *(F.col(f"__scores__.{n}").alias(n) for n in SCORES))
