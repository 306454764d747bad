import random

import pytest
import sentencepiece

from meterflow.llm import sentencepiece_fst as fst

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ODD = ["", " ", "  ", "a", "  a  b\tc\nd ﬁ é e\u0301", "aaaa aaaaa aaaaaaa", "            x", "日本語 テキスト 😀 \x00 z",
       "<0x41> </s> <unk>", "Internationalization===>>> 1234567 http://www.example.com/?a=b&c=d", "x" * 700, "ab" * 400, "▁x ▁ y"]


@pytest.fixture(scope="module")
def machine():
    with open(MODEL, "rb") as file:
        return fst.Transducer(file.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def some(seed, count):
    rng = random.Random(seed)
    return ["".join(rng.choice("aabeinorstlTH  \n.,éü-7") for _ in range(rng.randrange(80))) for _ in range(count)]


def test_same_ids_as_the_library(machine, library):
    for text in ODD + some(1, 1500):
        ids = list(machine.encode(text))
        assert ids == library.encode(text), text
        assert machine.decode(ids) == text.replace("▁", " ")


def test_small_memory_changes_nothing(library):
    limit, fst.MAX_KEPT = fst.MAX_KEPT, 20
    try:
        with open(MODEL, "rb") as file:
            machine = fst.Transducer(file.read())
        for text in some(2, 300):
            assert list(machine.encode(text)) == library.encode(text)
    finally:
        fst.MAX_KEPT = limit


def test_unigram_weights():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    for piece, score, kind in (("<unk>", 0, 2), ("▁", -4, 1), ("a", -3, 1), ("b", -3, 1), ("ab", -4, 1), ("▁a", -5, 1),
                               ("bb", -9, 1), ("c", -3, 1), ("abc", -4.5, 1)):
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.remove_extra_whitespaces = False
    model = proto.SerializeToString()
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    machine = fst.Transducer(model)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 15)))
        assert list(machine.encode(text)) == library.encode(text), text


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD, "many words " * 30_000])] + [(None, "no number", "y"), (3, "a", "z")]
    df = spark.createDataFrame(rows, "id long, text string, ids string")
    encoded = fst.encode(df, MODEL)
    assert encoded.columns == ["id", "text", "ids", "n_tokens", "lossless"]
    for r in encoded.collect():
        assert r.ids == (library.encode(r.text) if r.text else []) and r.n_tokens == len(r.ids)
        assert r.lossless == ("▁" not in (r.text or ""))
    back = fst.decode(encoded.select("id", "ids"), MODEL)
    assert {(r.id, r.text) for r in back.collect()} == {(i, (t or "").replace("▁", " ")) for i, t, _ in rows}
    assert fst.encode(df.limit(0), MODEL).count() == 0
