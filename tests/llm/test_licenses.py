import math
from collections import Counter

from meterflow.llm import licenses

SCHEMA = "id long, path string, text string, license string, folder int"


def scanned(spark, rows, **how):
    files = spark.createDataFrame([(i, p, t, "x", 1) for i, p, t in rows], SCHEMA)
    return {r.id: r for r in licenses.scan(files, **how).collect()}


def cosine(line, template, counts, total):
    idf = lambda w, seen: math.log((total + 1) / (seen + 1)) + 1
    known = {w for _, t in licenses.TEMPLATES for w in licenses.words(t)}
    vectors = [{w: n * idf(w, counts.get(w, 0) if w in known else 0) for w, n in Counter(licenses.words(x)).items()} for x in (line, template)]
    dot = sum(v * vectors[1].get(w, 0) for w, v in vectors[0].items())
    return dot / math.prod(math.sqrt(sum(v * v for v in x.values())) for x in vectors)


def test_scores_match_brute_force(spark):
    lines = ["Released under the MIT License.", "released under the mit license by many people", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 2.", "nothing here", "the license of the work"]
    rows = [(i, f"d{i}/f.txt", f"head\n{line}\ntail words") for i, line in enumerate(lines)]
    got = scanned(spark, rows)
    counts = Counter(w for _, _, t in rows for w in set(licenses.words(t)))
    for i, line in enumerate(lines):
        score, name = max((cosine(line, t, counts, len(rows)), n) for n, t in licenses.TEMPLATES)
        if score >= 0.8:
            assert got[i].license == name and abs(got[i].score - score) < 1e-9 and got[i].line == line
        else:
            assert got[i].license is None


def test_inheritance(spark):
    rows = [(1, "a/LICENSE.txt", "Released under the MIT License.\nmore text that is not a statement of anything at all"),
            (2, "a/b/c/code.py", "x = 1"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
            (4, "a/code.py", None), (5, "ab/code.py", ""), (6, "a/b/own.py", "# Licensed under CC BY-NC 4.0.\ny = 2"),
            (7, None, "z"), (8, "a/b/c/d/e/f.py", "deep"), (8, "a/b/c/d/e/f.py", "deep")]
    got = scanned(spark, rows)
    assert {i: (r.license, r.origin) for i, r in got.items()} == {
        1: ("MIT", "own"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "own"), 4: ("MIT", "inherited"), 5: (None, None),
        6: ("CC-BY-NC-4.0", "own"), 7: (None, None), 8: ("Apache-2.0", "inherited")}


def test_edges(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "x/y", "word " * 100_000 + "\nReleased under the MIT License."), (None, "/abs/f", None)]
    got = scanned(spark, rows)
    assert (got[1].origin, got[2].origin, got[None].license) == ("own", "own", "MIT")
    assert scanned(spark, []) == {}


def test_words_of_no_template_weigh_by_all_texts(spark):
    lines = ["This file is licensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0. zyzzyva quokka axolotl numbat",
             "file Released under the MIT License. file"]
    rows = [(i, f"d{i}/f.txt", f"head\n{line}\ntail") for i, line in enumerate(lines)]
    rows += [(10 + i, "e/f.txt", "this file says nothing" if i % 2 else "calm") for i in range(200)]
    got = scanned(spark, rows)
    counts = Counter(w for _, _, t in rows for w in set(licenses.words(t)))

    def vector(text):
        return {w: n * (math.log((len(rows) + 1) / (counts[w] + 1)) + 1) for w, n in Counter(licenses.words(text)).items()}

    def full(a, b):
        a, b = vector(a), vector(b)
        return sum(v * b.get(w, 0) for w, v in a.items()) / math.prod(math.sqrt(sum(v * v for v in x.values())) for x in (a, b))

    for i, line in enumerate(lines):
        score, name = max((full(line, t), n) for n, t in licenses.TEMPLATES)
        assert (got[i].license, got[i].line) == ((name, line) if score >= 0.8 else (None, None))
        assert abs(got[i].score - (score if score >= 0.8 else 0.0)) < 1e-9
    assert got[0].license == "Apache-2.0" and got[1].license is None
