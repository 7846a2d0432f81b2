import random

import numpy as np
import pytest
import sentencepiece

from hearken.llm import sentencepiece_codec as S
from hearken.llm.queries import QUERIES
from tests.llm.data import SMALL

TEXTS = [None, "", " ", "a", "Hello  world\n é ▁x 日本 🙂", "   lead", "trail  ", "▁", "word " * 300, "x" * 900, "nospace" * 200 + " end", "日本語テキスト" * 60, "\t\n\r", "a▁▁b  c"]


@pytest.fixture(scope="module")
def codec():
    return S.codec(S.public_model(), "zipf")


def score(codec, ids):
    rank = {i: s for s, i in codec.pieces.values()}
    return sum(rank.get(i, S.BYTE_SCORE) for i in ids)


def test_round_trip_and_library_decoding(codec):
    library = sentencepiece.SentencePieceProcessor(model_file=S.public_model())
    for text in TEXTS[1:]:
        ids = codec.encode(text)
        assert codec.decode(ids) == text
        assert library.decode(ids) == text


def test_best_path_matches_the_library_as_unigram(codec):
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(open(S.public_model(), "rb").read())
    spec.trainer_spec.model_type = 1
    for p in spec.pieces:
        if p.type == p.NORMAL:
            p.score = codec.pieces[p.piece][0]
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    rng = random.Random(5)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdeghilnorstu") for _ in range(rng.randint(1, 12))) for _ in range(30))
        assert abs(score(codec, library.encode(text)) - score(codec, codec.encode(text))) < 1e-2


def test_product_is_associative_and_chunks_agree(codec):
    text = codec.normal(" " + "nospaceatall" * 30 + " word and   more")
    for size in (7, 40, 100):
        cores = [text[i : i + size] for i in range(0, len(text), size)]
        ahead = [text[i + size : i + size + codec.longest - 1] for i in range(0, len(text), size)]
        ms = [codec.matrix(c, a) for c, a in zip(cores, ahead, strict=True)]
        left, right = ms[0], ms[-1]
        for m in ms[1:]:
            left = S.product(left, m)
        for m in reversed(ms[:-1]):
            right = S.product(m, right)
        assert np.allclose(left[0, 0], right[0, 0])
        at = S.states(ms, 0, 0)
        ids = [i for c, a, s, t in zip(cores, ahead, at, at[1:], strict=False) for i in codec.between(c, a, s, t)]
        assert abs(score(codec, ids) - left[0, 0]) < 1e-6
        assert codec.decode(ids) == text.replace(S.SPACE, " ")[1:]
        assert abs(score(codec, ids) - score(codec, codec.encode(text.replace(S.SPACE, " ")[1:]))) < 1e-6


def test_giant_path_equals_whole_path(spark, codec):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate([*TEXTS, TEXTS[4]])], "doc_id long, text string, c int")
    got = {r["doc_id"]: r for r in S.decode(S.encode(docs, ["doc_id", "text"], giant=20, chunk=16, fan=3)).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate([*TEXTS, TEXTS[4]]):
        assert got[i]["decoded"] == text
        if text:
            assert abs(score(codec, got[i]["ids"]) - score(codec, codec.encode(text))) < 1e-6
    assert S.encode(docs.limit(0), ["doc_id"]).count() == 0
    checked = S.encode(docs, ["doc_id"], giant=20, chunk=16, fan=3, checked=True).collect()
    assert all(r["round_trip"] for r in checked) and {r["doc_id"]: r["ids"] for r in checked} == {i: r["ids"] for i, r in got.items()}


def test_kept_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, "y"), (1, "a b", "x", 7, "y"), (2, "word " * 30, "z", 8, None)], "doc_id long, text string, ids string, _row int, _text string")
    got = S.decode(S.encode(docs, docs.columns, giant=20, chunk=16, fan=3))
    assert sorted(got.columns) == ["_row", "_text", "decoded", "doc_id", "ids", "text"]
    assert sorted((r["doc_id"], r["decoded"] == r["text"], r["_row"], r["_text"]) for r in got.collect()) == [(1, True, 7, "y"), (1, True, 7, "y"), (2, True, 8, None)]


def test_query(spark):
    rows = QUERIES["op8_sentencepiece"](spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r["round_trip"] for r in rows)
