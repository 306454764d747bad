"""License scans: TF-IDF cosine of lines and files to templates, inherited along directories.

Each line of a file is a possible header, the whole text a possible license file. Vectors are
sparse: a word weighs its count times its inverse document frequency over all scanned texts;
words of no template count in the norm only. Defined cases: null
and empty texts have no license of their own; a null path is the root and inherits from it
only; ties between templates go to the first name; equal rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterflow.llm.common import stored

# Short forms in which files state common licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution under the terms of the BSD 3-Clause License."),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
)

_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
FOUND = T.ArrayType(T.StructType([
    T.StructField("dot", T.DoubleType()), T.StructField("license", T.StringType()), T.StructField("known", T.DoubleType()),
    T.StructField("line", T.StringType()), T.StructField("is_file", T.BooleanType()),
    T.StructField("others", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.IntegerType()))]))


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Matcher:
    """Weights of the template words and the unit vectors of the templates."""

    def __init__(self, templates, counts: dict[str, int], texts: int, threshold: float) -> None:
        self.threshold = threshold
        vocabulary = {w for _, t in templates for w in words(t)}
        self.weight = {w: math.log((texts + 1.0) / (counts.get(w, 0) + 1.0)) + 1.0 for w in vocabulary}
        self.vectors = []
        for name, text in sorted(templates):
            vector = {w: n * self.weight[w] for w, n in Counter(words(text)).items()}
            norm = math.sqrt(sum(v * v for v in vector.values()))
            self.vectors.append((name, {w: v / norm for w, v in vector.items()}))

    def reachable(self, present: set[str]) -> bool:
        """Whether any line of a text with these template words can reach the threshold."""
        return any(sum(v * v for w, v in vector.items() if w in present) >= self.threshold**2 - 1e-9
                   for _, vector in self.vectors)

    def candidates(self, text: str | None) -> list[dict]:
        """Lines, and last the whole text, that may reach the threshold, with their best template.

        Words of no template weigh 1 at least, which bounds the cosine from above; ``others``
        and ``times`` name them for their true weights.
        """
        if not text or not self.reachable({w for w in self.weight if w in text.lower()}):
            return []
        found = []
        for line in [*dict.fromkeys(text.splitlines()), None]:
            counts = Counter(words(text if line is None else line))
            if not self.reachable(set(counts)):
                continue
            dot, name = max(((sum(v * counts[w] * self.weight[w] for w, v in vector.items() if w in counts), name)
                             for name, vector in self.vectors), key=lambda s: s[0])
            known = sum((n * self.weight[w]) ** 2 for w, n in counts.items() if w in self.weight)
            others = {w: n for w, n in counts.items() if w not in self.weight}
            if dot >= self.threshold * math.sqrt(known + sum(n * n for n in others.values())) - 1e-9:
                found.append({"dot": dot, "license": name, "known": known, "line": (text if line is None else line).strip(),
                              "is_file": line is None, "others": list(others), "times": list(others.values())})
        return found


def word_counts(texts: DataFrame) -> DataFrame:
    """In how many of ``texts`` each word stands; the row of the empty word has the number of texts."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter({"": len(batch)})
            for text in batch["text"]:
                found.update(set(words(text or "")))
            yield pd.DataFrame({"word": list(found), "texts": list(found.values())})

    return texts.select("text").mapInPandas(count, "word string, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


def scan(
    files: DataFrame, templates=TEMPLATES, threshold: float = 0.8, license_names=("license", "copying", "licence"),
) -> DataFrame:
    """License of each file: ``files`` has id, path and text.

    A file has the license of its best line or of its whole text, whichever is closer, if the cosine is
    ``threshold`` or more. A file whose whole text matches, or that has a match and one of
    ``license_names`` as its name less the ending, speaks for its directory; files without a
    license of their own take that of the nearest directory above that has one (the best
    score, of the whole text where that matches, then the first name, where a directory has several). Gives id, path, license,
    score, line, and origin: own, inherited or null.
    """
    texts = files.select(F.col("id").alias("id"), F.coalesce("path", F.lit("")).alias("path"), F.col("text").alias("text"))
    counts = stored(word_counts(texts))
    vocabulary = {w for _, t in templates for w in words(t)}
    seen = {r["word"]: r["texts"] for r in counts.where(F.col("word").isin("", *sorted(vocabulary))).collect()}
    total = seen.pop("", 0)
    matcher = texts.sparkSession.sparkContext.broadcast(Matcher(templates, seen, total, threshold))

    @F.pandas_udf(FOUND)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([matcher.value.candidates(t) for t in batch], dtype=object)

    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.lower(F.regexp_extract("path", "([^/.]*)[^/]*$", 1))
    files = stored(texts.select(F.monotonically_increasing_id().alias("key"), "id", "path", folder.alias("folder"),
                                name.alias("name"), scanned("text").alias("c")))
    lines = files.select("key", F.posexplode("c").alias("at", "c")).select("key", "at", "c.*")
    others = lines.select("key", "at", F.explode(F.arrays_zip("others", "times")).alias("o")).select(
        "key", "at", F.col("o.others").alias("word"), F.col("o.times").alias("n"))
    weight = F.log(F.lit(total + 1.0) / (F.col("texts") + 1.0)) + 1.0
    # summed in order of size, so that equal lines get equal norms
    norms = others.join(counts, "word").groupBy("key", "at").agg(F.aggregate(
        F.sort_array(F.collect_list(F.pow(F.col("n") * weight, F.lit(2.0)))), F.lit(0.0), lambda a, b: a + b).alias("rest"))
    score = F.col("dot") / F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0)))
    best = lines.join(norms, ["key", "at"], "left").withColumn("score", score).where(F.col("score") >= threshold).groupBy("key").agg(
        F.min(F.when(~F.col("is_file"), F.struct(-F.col("score"), "at", "license", "line"))).alias("l"),
        F.min(F.when(F.col("is_file"), F.struct("score", "license", "line"))).alias("f"))
    whole, line = F.coalesce("f.score", F.lit(0.0)), F.coalesce(-F.col("l.col1"), F.lit(0.0))
    own = stored(files.drop("c").join(best, "key", "left").select(
        "id", "path", "folder", "name", F.when(whole >= line, F.col("f.license")).otherwise(F.col("l.license")).alias("license"),
        F.greatest(whole, line).alias("score"), F.coalesce("l.line", "f.line").alias("line"),
        F.struct(F.when(F.col("f").isNotNull(), whole).otherwise(line).alias("score"),
                 F.coalesce("f.license", "l.license").alias("license")).alias("voice"), F.col("f").isNotNull().alias("is_license_file")))
    speaks = (F.col("is_license_file") | F.col("name").isin(*license_names)) & F.col("license").isNotNull()
    spoken = own.where(speaks).groupBy("folder").agg(
        F.min(F.struct(-F.col("voice.score"), F.col("voice.license").alias("license"))).alias("best")).select(
            F.col("folder").alias("above"), F.col("best.license").alias("given"), F.lit(True).alias("known"))
    # each directory and those above it: one row per directory, not per file
    parts = F.split("folder", "/")
    folders = own.select("folder").distinct().select("folder", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("above")).distinct()
    nearest = folders.join(spoken, "above").groupBy("folder").agg(
        F.max_by("given", F.length("above")).alias("inherited"))
    return own.join(nearest, "folder", "left").select(
        "id", "path", F.coalesce("license", "inherited").alias("license"), "score", "line",
        F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"))
