import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearken.llm import quality, word_model
from hearken.llm.queries import QUERIES
from tests.llm.data import SMALL

SP = r"[^\x20\x09-\x0D]+"


def counted(text):
    text = text or ""
    words = re.findall(SP, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SP, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_counts_match_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op9_quality"](spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        n = counted(doc["text"])
        row = rows[doc["doc_id"]]
        assert tuple(row[c] for c in quality.COUNTS) == n
        assert row["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (row["base_failed"] and row["kept"])


def test_model_is_a_distribution_and_matches_direct_formula(spark):
    texts = ["the cat sat on the mat. the cat ran.", "the dog sat on the log, and the cat sat too."]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = quality.fit(docs)
    scorer = quality.Scorer(model["arrays"]["en"], model["order"])
    assert np.allclose(np.exp(scorer.logs.astype(float)).sum(axis=1), 1, atol=1e-4)

    def kinds(t):
        return [int(quality.KIND_OF[b]) for b in t.encode()]

    counts = {4: Counter(tuple(kinds(t)[i : i + 4]) for t in texts for i in range(len(t) - 3))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def prob(gram):
        n = len(gram)
        if n == 0:
            return 1 / 64
        c = counts[n]
        at = {k: sum(v == k for v in c.values()) for k in (1, 2, 3, 4)}
        y = at[1] / max(at[1] + 2 * at[2], 1)
        d = {k: max(min(k - (k + 1) * y * at[k + 1] / at[k] if at[k] else 0.5, k - 0.01), 0.01) for k in (1, 2, 3)}
        same = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not same:
            return prob(gram[1:])
        total = sum(same.values())
        weight = sum(d[min(v, 3)] for v in same.values()) / total
        own = (same[gram] - d[min(same[gram], 3)]) / total if gram in same else 0
        return own + weight * prob(gram[1:])

    want = -sum(math.log(prob(tuple(kinds(texts[0])[i : i + 4]))) for i in range(len(texts[0]) - 3))
    assert abs(scorer.nats(texts[0].encode())[0] - want) < 1e-3


def test_edge_cases(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "word", "en"), (4, "a b c " * 100, "en"), (4, "a b c " * 100, "en"), (5, "x" * 300000, None)]
    docs = spark.createDataFrame([(*r, "extra", 1.0, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, n_words string, kept double, _id int, _lang int, key int")
    got = quality.verdicts(docs).collect()
    assert len(got) == 6 and not any(r["kept"] for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality.verdicts(docs.limit(0)).count() == 0


def prose(seed, words=100):
    """Words in an order that a language allows, or in any order where ``seed`` is below 0."""
    rng = np.random.default_rng(abs(seed))
    names = [a + b for a in ("ba", "de", "fi", "go", "ku", "lam", "mer", "nos", "pil", "rut", "sa", "tev", "vo", "wim", "xe", "yol", "zan", "cor", "hul", "jet") for b in ("", "n", "ra", "st", "lo", "mi", "der", "ka", "po", "tu")]
    at, out = int(rng.integers(200)), []
    for _ in range(words):
        out.append(names[at])
        at = (at * 7 + int(rng.integers(6)) * 31 + 3) % 200
    if seed < 0:
        rng.shuffle(out)
    return " ".join(out)


def test_word_order_counts(spark):
    rows = [(i, prose(i), "xx") for i in range(1, 301)] + [(i, prose(i), "xx") for i in range(-10, 0)]
    got = {r["doc_id"]: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    # Not one of the shuffled texts passes; the class model alone let them.
    assert not any(got[i]["kept"] for i in range(-10, 0))
    assert sum(got[i]["kept"] for i in range(1, 301)) >= 290


@pytest.mark.parametrize("run", [1 << 20, 5])
def test_word_model_matches_direct_formula(spark, monkeypatch, run):
    from hearken.llm import word_model

    monkeypatch.setattr(word_model, "RUN", run)
    texts = ["the cat sat on the mat and the cat ran to the dog", "the dog sat on the mat", "a cat sat on a log and a dog ran to the log", "the dog sat on the mat", "one", None]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = sorted(r["word_nats"] for r in word_model.score(word_model.text_of(docs)).collect())
    own = [set(zip(t.split(), t.split()[1:])) for t in texts[:4]]
    counts = Counter(p for mine in own for p in mine)
    before = Counter(b for _, b in counts)
    at = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
    y = at[0] / max(at[0] + 2 * at[1], 1)
    d = [0] + [max(min(k - (k + 1) * y * at[k] / at[k - 1] if at[k - 1] else 0.5, k - 0.01), 0.01) for k in (1, 2, 3)]
    low = lambda w: (before[w] + 0.5) / (sum(before.values()) + 0.5 * word_model.CELLS)

    def nats(mine):
        total = 0
        for a, b in mine:
            followers = [v for (x, _), v in counts.items() if x == a]
            left, every, p = counts[a, b] - 1, sum(followers), low(b)
            if every > 1:
                p = min(max(left - d[min(left, 3)], 0) / (every - 1) + min(sum(d[min(v, 3)] for v in followers) / every, 1) * p, 1)
            total -= math.log(p)
        return total / len(mine)

    assert np.allclose(got, sorted(map(nats, own)), rtol=1e-4)


def test_scores_by_slot_match_the_model_in_memory(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLOT", 50_000)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    arrays = quality.fit(docs)["arrays"]
    scorers = {lang: quality.Scorer(a, quality.ORDER) for lang, a in arrays.items()}
    got = {r["doc_id"]: r["nats"] for r in quality.measured(docs, quality.learn(docs)).collect()}
    monkeypatch.setattr(quality, "MOST_NUMBERS", 10)
    dealt = {r["doc_id"]: r["nats"] for r in quality.measured(docs, quality.learn(docs)).collect()}
    assert dealt.keys() == got.keys() and all(x == dealt[i] or abs(x - dealt[i]) < 1e-9 for i, x in got.items())
    for doc in docs.collect():
        words = len(re.findall(SP, doc["text"] or ""))
        total, n = scorers[doc["lang"]].nats((doc["text"] or "").encode())
        assert got[doc["doc_id"]] == (None if not n or not words else total / words) or abs(got[doc["doc_id"]] - total / words) < 1e-9


def test_second_look_has_every_language(spark):
    def text(k, seed, words=120):
        """Words of the k-th language, of which the ninth and tenth have the fewest."""
        letters, rng = np.random.default_rng(k), np.random.default_rng(1000 + 100 * k + seed)
        names = ["".join(chr(97 + int(i)) for i in letters.integers(0, 26, 6)) for _ in range(60 if k < 8 else 20)]
        return " ".join(names[int(i)] for i in rng.integers(0, len(names), words))

    known = spark.createDataFrame([(100 * k + i, text(k, i), f"l{k}") for k in range(10) for i in range(30)], "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(800, text(8, 0), "l8"), (5000, text(8, 99) + " " + text(9, 99), "l8")], known.schema)
    above = docs.filter("doc_id = 5000").select("doc_id", "lang", F.xxhash64("text").alias("text_key"))
    model = quality.learn(known)
    nats = {r["doc_id"]: r["nats"] for r in quality.measured(docs, model).collect()}
    switched = quality._second_look(docs, model, above).first()["switched"]
    # The stretch where the languages meet is in neither.
    assert nats[5000] > 4 * nats[800] and switched < nats[5000] / 2


def test_pairs_of_a_shard_are_unfolded_a_range_at_a_time():
    """Counts of all pairs are right, while no more than a range of them is unfolded, from buffers in place."""
    pick = np.random.default_rng(4)
    runs = [[pick.integers(0, 1 << 63, 20_000, dtype=np.int64).view(np.uint64)[pick.integers(0, 20_000, 30_000)] for _ in range(3)] for _ in range(4)]
    want = {}
    for words in runs:
        for pair in word_model._hashed(words)[0].tolist():
            want[pair] = want.get(pair, 0) + 1
    table = pa.Table.from_pylist([r for i, words in enumerate(runs) for r in word_model._rows([1, 2, 3], words, i, 1, True) if r["shard"] == 0])
    rows = word_model._buffers(table)
    lo, hi = table["w"].chunk(0).buffers()[2].address, table["w"].chunk(0).buffers()[2].size
    assert all(lo <= r["w"].address < lo + hi for r in rows)
    got, most = {}, 0
    for pairs, counts, found in word_model._counted(rows):
        got |= dict(zip(pairs.tolist(), counts.tolist(), strict=True))
        most = max(most, sum(len(x) for _, _, x in found))
    assert got == want and most < len(want) / 8
