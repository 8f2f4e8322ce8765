import random
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from texloom.llm.pieces import PieceModel, encode_decode

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", " ", "  ", "    ", "\n", "'", "ll", "é", "中", "😀", "1", "1.", "2.5", ".", ",", "2024", "!", "<s>", "▁", "\x00", "-----", "=", "straße", "http", " int"]


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(model, library):
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16)))
        ids = model.encode(text)
        assert ids.tolist() == library.encode(text), text
        assert model.decode(ids) == text.replace("▁", " ").encode()


def test_runs_of_spaces(model, library):
    for n in (*range(40), 333):
        for end in ("", "x", "the", "\n"):
            assert model.encode(" " * n + end).tolist() == library.encode(" " * n + end)


def test_long_text_without_spaces_streams(model, library):
    rng = random.Random(7)
    text = "".join(rng.choice(["the", "ing", "tion", "a", "b", "é", "http", "er", "1"]) for _ in range(8000))
    assert list(model.viterbi("▁" + text)) == library.encode(text)
    assert model.encode(text).tolist() == library.encode(text)


def test_window_stays_bounded(model):
    """Ids come out long before the text ends: the first ones after a bounded number of characters."""
    text, seen = "theinga" * 4000, []

    class Counted(str):
        def __getitem__(self, key):
            seen.append(key.stop if isinstance(key, slice) else key)
            return str.__getitem__(self, key)

    first = next(iter(model.viterbi(Counted(text))))
    assert first and max(seen) < 200


def test_unigram_maximum():
    spec = sentencepiece_model_pb2.ModelProto()
    for piece, score, kind in (("<unk>", 0, 2), ("▁", -5.0, 1), ("a", -1.5, 1), ("b", -1.6, 1), ("ab", -2.0, 1), ("ba", -1.1, 1), ("▁a", -3.0, 1), ("aab", -4.0, 1), ("bab", -3.3, 1)):
        spec.pieces.add(piece=piece, score=score, type=kind)
    spec.trainer_spec.model_type = 1
    spec.normalizer_spec.add_dummy_prefix = True
    spec.normalizer_spec.remove_extra_whitespaces = False
    model = PieceModel(proto=spec.SerializeToString())
    scores = {p.piece: p.score for p in spec.pieces}

    def best(text):
        if not text:
            return 0.0
        return max((scores[text[:n]] + best(text[n:]) for n in (1, 2, 3) if text[:n] in scores), default=-1e9)

    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))
        ids = model.encode(text).tolist()
        assert model.decode(model.encode(text)).decode() == text
        if len(text) < 14:
            assert abs(sum(spec.pieces[i].score for i in ids) - best("▁" + text)) < 1e-5


def test_query_rows(docs, library):
    for r in encode_decode(docs, PATH, keep=["doc_id", "text"], decoded=True).collect():
        text = r["text"] or ""
        assert r["ids"] == library.encode(text) and r["n_ids"] == len(r["ids"]) and r["round_trip"]
        assert r["decoded"] == text.replace("▁", " ") and r["decoded_crc32"] == zlib.crc32(r["decoded"].encode())


def test_odd_rows(odd, none):
    rows = encode_decode(odd.withColumn("IDS", F.lit(1)), PATH)
    found = {r["doc_id"]: r for r in rows.collect()}
    assert rows.count() == 10 and found[2]["ids"] == found[3]["ids"] == [] and all(r["round_trip"] for r in found.values())
    assert encode_decode(none, PATH).count() == 0


def test_unknown_runs_equal_the_library():
    """Without byte pieces a run of unknown characters is one unknown piece, also across words."""
    rng = random.Random(10)
    for kind in (1, 2):
        spec = sentencepiece_model_pb2.ModelProto()
        for piece, score, of in (("<unk>", 0, 2), ("▁", -5.0, 1), ("a", -1.5, 1), ("b", -1.6, 1), ("ab", -1.0, 1), ("▁a", -1.2, 1)):
            spec.pieces.add(piece=piece, score=score, type=of)
        spec.trainer_spec.model_type = kind
        spec.normalizer_spec.add_dummy_prefix = True
        spec.normalizer_spec.remove_extra_whitespaces = False
        raw = spec.SerializeToString()
        library, model = sentencepiece.SentencePieceProcessor(model_proto=raw), PieceModel(proto=raw)
        for text in ["axyb", "x", "xx xx", "a x", "中文ab", *("".join(rng.choice("abxy 中") for _ in range(12)) for _ in range(300))]:
            assert model.encode(text).tolist() == library.encode(text), (kind, text)


def test_windows_give_the_same_ids(model, library, monkeypatch):
    from texloom.llm import pieces

    monkeypatch.setattr(pieces, "WINDOW", 7)
    rng = random.Random(11)
    for _ in range(300):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60)))
        assert model.encode(text).tolist() == library.encode(text), text
