import random

from meterflow.llm import toxicity

BAD = ["grumble", "snarlface", "vilewort"]


def corpus(count=600):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(count):
        toxic = i % 4 == 0
        words = ["".join(rng.choice("abdeghlmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(1 + len(words) // 15):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        elif i % 5 == 0:
            at = rng.randrange(len(words))
            words[at:at + 1] = ["grumble", "soup"]
        rows.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return (spark.createDataFrame(rows, "id long, text string, term string, score double"),
            spark.createDataFrame(labels, "id long, toxic int"))


def test_held_out_accuracy_and_exceptions(spark):
    rows, labels = corpus()
    texts, known = frames(spark, rows, [x for x in labels if x[0] % 3])
    lexicon = toxicity.learn(texts, known, min_odds=3.0)
    assert " grumble soup " in lexicon.exceptions
    truth = dict(labels)
    got = {r.id: r.score for r in toxicity.score(texts, lexicon).collect()}
    right = [(s >= 0.5) == truth[i] for i, s in got.items() if i % 3 == 0]
    assert sum(right) / len(right) >= 0.97


def test_disguises():
    lexicon = toxicity.Lexicon({" snarlface ": 4.0, " vile": 2.0}, (" vile jelly ",), (3.0, 1.0, -4.0))
    machine = lexicon.automaton()
    weight = lambda text: lexicon.features(machine, text)[0]
    assert weight("you SNARLFACE") == weight("you snаrlfасe!") == weight("5n4rlf4c3 it is") == weight("sn\u200barlface") == 4.0
    assert weight("vilest") == 2.0 and weight("a vile jelly") == 0.0 and weight("servile snarlfaces") == 0.0
    assert weight("call 5 4 3") == 0.0 and weight("") == 0.0 and weight(None) == 0.0
    scores = lexicon.scores(__import__("pandas").Series(["snarlface " * 50_000, "calm words", None]))
    assert scores[0] > 0.9 and scores[1] == scores[2] < 0.1


def test_edges(spark):
    rows, labels = corpus(80)
    odd = [(None, "grumble", "y", 0.0), (900, None, None, None), (900, None, None, None), (901, "", "", 2.0)]
    texts, known = frames(spark, rows + odd, labels + [(None, 1), (3, None), (4, 0)])
    scored = toxicity.score(texts, toxicity.learn(texts, known))
    assert scored.columns == ["id", "text", "term", "score"]
    got = scored.collect()
    assert len(got) == 84 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1


def test_no_examples_and_empty(spark):
    texts, none = frames(spark, [(1, "some text", "x", 0.0)], [])
    lexicon = toxicity.learn(texts, none)
    assert lexicon.weights == {} and [r.score for r in toxicity.score(texts, lexicon).collect()] == [0.5]
    assert toxicity.score(texts.limit(0), lexicon).count() == 0


def test_class_shares_survive_the_bound_of_fit_rows(spark):
    rows, labels = corpus(400)
    labels = [(i, int(y or i % 8 == 1)) for i, y in labels]  # some toxic rows hold no term

    def scores(copies, fit_rows, min_toxic):
        texts, known = frames(spark, [(c * 1000 + r[0], *r[1:]) for c in range(copies) for r in rows],
                              [(c * 1000 + i, y) for c in range(copies) for i, y in labels])
        lexicon = toxicity.learn(texts, known, fit_rows=fit_rows, min_toxic=min_toxic, min_odds=3.0)
        return {r.id: r.score for r in toxicity.score(texts.where("id < 1000"), lexicon).collect()}

    whole, cut = scores(1, 8000, 20), scores(10, 600, 80)
    assert sum(abs(whole[i] - cut[i]) for i in whole) / len(whole) < 0.05
