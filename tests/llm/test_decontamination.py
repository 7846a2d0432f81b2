import random
import re
import time

from hearken.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(len(v), window)
        for s in range(max(len(v) - window, 0) + 1 if v else 0):
            for k in range(len(w) - n + 1):
                if w[k : k + n] == v[s : s + n]:
                    hit |= set(range(k, k + n))
                    found.add(item_id)
    return len(w), len(hit), sorted(map(str, found))


def test_matches_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "the", "a"] + [f"w{i}" for i in range(40)] + ["Été", "été"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 6, 10, 12, 25]))) for i in range(25)] + [(25, None), (26, "..."), (3, "the of the a " * 30)]
    docs = []
    for i in range(60):
        body = text(rng.choice([0, 3, 30, 80]))
        if rng.random() < 0.5:
            body = f"{body}, {(rng.choice(items)[1] or '').upper()}! {text(5)}"
        docs.append((i, body, "s"))
    docs += [(60, None, "s"), (61, "", "s"), docs[5], (62, "the of the a " * 200, "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window in (10, 4):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in D.decontaminate(frame, bench, window).collect()}
        for i, body, _ in docs:
            assert got[i] == brute(body, items, window), (i, body)
    small = D.decontaminate(frame, bench.limit(0)).collect()
    assert len(small) == len(docs) and not any(r["contaminated"] for r in small)
    assert D.decontaminate(frame.limit(0), bench).count() == 0
    kept = D.remove_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, b, _ in docs if not brute(b, items, 10)[1])


def test_without_broadcasts_and_near_matches(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, f"x y {passage} z"), (2, "alpha beta gamma delta inserted epsilon zeta eta theta iota kappa"), (3, "kappa iota alpha"), (4, "filler " * 30)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    _, matches = D.phrase_matches(docs, bench, most_broadcast=0)
    assert matches.select("item_id", "start", "length").collect() == [(7, 2, 10)]
    assert {r["doc_id"] for r in D.proximity_matches(docs, bench, slop=2).collect()} == {1, 2}


def test_long_items_match_brute_force_in_linear_time(spark):
    rng = random.Random(12)
    body = [rng.choice(["the", "of", *(f"w{i}" for i in range(400))]) for _ in range(16_000)]
    docs, took = [(k, " ".join(["x"] * k + body[a:b])) for k, (a, b) in enumerate([(0, 9), (0, 10), (55, 75), (60, 200), (990, 1010), (15_980, 16_000), (7000, 7300), (63, 73), (64, 74)])], {}
    docs.append((99, " ".join(body[100:106] + ["y"] + body[106:112])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for n in (63 + 10, 64 + 10, 1000, 16_000):
        item = " ".join(body[:n])
        began = time.time()
        rows = D.decontaminate(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
        took[n] = time.time() - began
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows} == {i: fast(t, item) for i, t in docs}
    assert took[16_000] < 20 * took[1000]


def fast(text, item):
    """``brute`` for one long item of item_id 1."""
    v, w = words(item), words(text)
    grams, hit = {tuple(v[s : s + 10]) for s in range(len(v) - 9)}, set()
    for k in range(len(w) - 9):
        if tuple(w[k : k + 10]) in grams:
            hit |= set(range(k, k + 10))
    return len(w), len(hit), ["1"] if hit else []


def test_clashing_names(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage, "a", 1, 2, 3), (2, "clean", "b", 1, 2, 3)], "doc_id long, text string, _id string, _key int, row int, item int")
    items = spark.createDataFrame([(7, passage, 0)], "item_id long, text string, row int")
    out = D.remove_contaminated(docs, items)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(2, "clean", "b", 1, 2, 3)]
