import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hearken.llm import collocations, count_sketch
from hearken.llm.word_arrays import words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=10, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = {}
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least:
            cuts = [(1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found[lang, g] = (a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score)
    out = []
    for lang in n:
        kept = []
        for (x, g), v in found.items():
            if x == lang and not any(y == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b[0] >= 50 * v[0] for (y, h), b in found.items()):
                kept.append((-v[4], -v[0], " ".join(g).encode(), v))
        out += [(lang, r, p.decode(), *v) for r, (_, _, p, v) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def some_rows(seed=5):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "MAT", "É", "école", "x", "日本", "a-b", " ", "ÀB"]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", " ", ". ", "\n"]) for _ in range(rng.choice([0, 1, 5, 60])))) for _ in range(500)]
    return rows + [("en", "a a a a a a a a a a a a a"), ("en", None), (None, None), ("de", ""), ("en", " .,; "), ("long", "one two three. " * 3000)]


@pytest.mark.parametrize("bits", [18, 27])
def test_phrases_match_brute_force(spark, bits):
    """Also with a sketch so small that much of it passes."""
    rows = some_rows()
    docs = spark.createDataFrame([(1, lang, text, 0, "x") for lang, text in rows], "doc_id long, lang string, text string, rank int, phrase string").repartition(3)
    got = [(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.mine(docs, bits=bits).collect()]
    assert sorted(got) == brute_force(rows) and len(got) > 20


def test_ties_and_the_last_rank(spark):
    rows = [("en", f"w{i} v{i}. " * 10) for i in range(40)]
    got = sorted((r["rank"], r["phrase"], r["score"]) for r in collocations.mine(spark.createDataFrame(rows, "lang string, text string"), most=7).collect())
    assert got == [(k + 1, p, 1000000) for k, p in enumerate(sorted(f"w{i} v{i}" for i in range(40))[:7])]


def test_no_rows(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 20)
    text = "one two three, four five six seven eight nine. ten; eleven twelve thirteen fourteen fifteen"
    parts = [t for lang, some in collocations._texts([pa.RecordBatch.from_pydict({"lang": ["en", "fr"], "text": [text, "x y"]})]) for t in some if lang == "en"]
    assert len(parts) > 1 and [w for p in parts for w in re.findall(r"\w+", p)] == re.findall(r"\w+", text)
    assert all("seven eight" in p for p in parts if "seven" in p)


def test_sketch_never_says_too_little(spark):
    """Keys in many tasks, with counts and one by one, against true counts."""
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    times = rng.integers(1, 9, (4, len(keys)))
    df = spark.range(4, numPartitions=4)

    def counted(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield keys, times[k]

    def single(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                yield np.repeat(keys, times[k]), None

    truth = times.sum(axis=0)
    for how in (counted, single):
        found = count_sketch.merged(df, how, 20, 24).reaches(keys)
        assert found[truth >= 20].all() and found[truth < 20].mean() < 0.05
    assert not count_sketch.merged(df.filter("false"), counted, 20, 18).reaches(keys).any()
    with pytest.raises(ValueError):
        count_sketch.merged(df, counted, 0, 24)


def test_normal_form_has_guards():
    words = words_of(["Ab  cd.É", "", "\tz"], collocations.KINDS)
    assert collocations._normal(words) == "\n ab cd \n É \n z "
