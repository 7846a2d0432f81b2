import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearken.llm import simple8b, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER, LIBRARY = token_files.Encoder(PATH), Tokenizer.from_file(PATH)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1)), max_size=300), st.integers(1, 12))
@example([(1 << 60) - 1, 1 << 60, (1 << 53) - 1, 1 << 53, (1 << 64) - 1], 1)
def test_any_values_come_back(values, times):
    coded = simple8b.encode(np.array(values * times, np.uint64))
    assert simple8b.decode(coded).tolist() == values * times


def test_blocks_stand_alone_and_words_are_full():
    rng = random.Random(3)
    values = [rng.choice([0, rng.randrange(1 << rng.randrange(1, 64))]) for _ in range(5000)] + [0] * 3000 + [5] * 2000
    coded = simple8b.encode(np.array(values, np.uint64))
    for a, b in ((0, 1), (3, 5), (4, 4), (8, 10), (9, 10)):
        assert simple8b.decode(coded, a, b).tolist() == values[a * 1024 : b * 1024]
    assert len(simple8b.encode(np.zeros(1024 * 4, np.uint64)).words) == 4 * 9
    # A word takes as many values as any selector lets it.
    begin, n = 0, 0
    for word in coded.words[coded.words_at[0] : coded.words_at[1]].tolist():
        most = max([1, *[min(int(c), 1024 - begin) for c, w in zip(simple8b.COUNTS[1:], simple8b.WIDTHS[1:]) if all(v.bit_length() <= w for v in values[begin : min(begin + int(c), 1024)])]])
        assert min(int(simple8b.COUNTS[word >> 60]), 1024 - begin) == most
        begin, n = begin + most, n + 1
    assert begin == 1024 and n == coded.words_at[1]


def test_files_hold_documents():
    values = np.array([*range(3000), 1 << 63, 7], np.uint64)
    raw = simple8b.to_bytes([5, None, -3, 9], np.array([2000, 0, 1000, 2]), values)
    found = simple8b.from_bytes(raw)
    assert found.ids == [5, None, -3, 9]
    assert [found.values(k).tolist() for k in range(4)] == [list(range(2000)), [], list(range(2000, 3000)), [1 << 63, 7]]
    nothing = simple8b.from_bytes(simple8b.to_bytes([], np.zeros(0, np.int64), np.zeros(0, np.uint64)))
    assert nothing.ids == [] and not len(simple8b.decode(nothing.coded))
    for broken in (raw[:-1], raw[:100] + bytes([raw[100] ^ 1]) + raw[101:]):
        with pytest.raises(ValueError):
            simple8b.from_bytes(broken)


HARD = ["it's 'sa don't!", "a.b. c... d.) e', f.'s", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "É école ÉCOLE. ß ẞ İx i̇x Σας ΟΔΟΣ ﬁ", "5.5 5. ٣٤. ½.", "a\tb\x0bc\x1cd\x85e f", "日本語. é ́x", "", " \n ", "🙂!🙂 ‍."]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(st.one_of(st.sampled_from("abzAZ09 .,;:!?'\n\téÉß<|>sd"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6))
@example(HARD)
def test_ids_are_the_library_s(texts):
    ids, sizes = ENCODER.encode(texts)
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_another_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, texts = token_files.Encoder(path), ["  a  b.\n", "", "It's"]
    assert not other.by_word
    ids, sizes = other.encode(texts)
    assert ids.tolist() == [i for t in texts for i in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids] and sizes[1] == 0


ROWS = [(7, "The cat. Sat"), (None, "no id"), (3, None), (3, "b"), (3, "b"), (-5, ""), (12, "long word " * 5000), (7, "The cat. Sat"), (20, "École 5.")]


def test_written_files_give_the_documents_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 4)
    monkeypatch.setattr(token_files, "LOT", 10)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, _hash string, ids int").repartition(3)
    folder = token_files.new_folder(spark)
    files = token_files.write(docs, folder, PATH, 2).collect()
    want = [(i, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ROWS]
    assert sum(f["documents"] for f in files) == len(ROWS) and sum(f["ids"] for f in files) == sum(len(w) for _, w in want) and len(files) > 4
    read = [(r["doc_id"], r["ids"]) for r in token_files.read(spark, folder).orderBy("file", "place").collect()]
    first = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(read, key=lambda r: (first(r), r[1])) == sorted(want, key=lambda r: (first(r), r[1]))
    assert [first(r) for r in read] == sorted(first(r) for r in read)
    at, digests = 0, []
    for i, ids in read:
        digests.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.digests(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(digests, key=str)


def test_no_documents(spark):
    folder = token_files.new_folder(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write(empty, folder, PATH, 2).count() == 0
    assert token_files.digests(spark, folder).collect() == [] == token_files.read(spark, folder).collect()
