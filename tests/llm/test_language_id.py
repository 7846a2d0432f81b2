import numpy as np
from pyspark.sql import functions as F

from hearken.llm import language_id as L
from hearken.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    net = L.Network.fresh(["a", "b"], units=3, dtype=np.float64)
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    rng = np.random.default_rng(1)
    data = rng.integers(60, 66, (4, 7))
    data[1, 4:] = 256
    label = np.array([0, 1, 1, 0])
    loss, grads = net.gradients(data, label)
    for name, g in grads.items():
        flat = net.params[name].reshape(-1)
        for at in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            was = flat[at]
            flat[at] = was + 1e-5
            up = net.gradients(data, label)[0]
            flat[at] = was - 1e-5
            down = net.gradients(data, label)[0]
            flat[at] = was
            # single-precision halves in the gates bound the agreement
            assert abs((up - down) / 2e-5 - g.reshape(-1)[at]) < 1e-4


def test_pooling_equals_one_position_at_a_time():
    net = L.Network.fresh(["a", "b", "c"])
    texts = ["hello world", "x", "", None, "abc " * 200, "1234"]
    names, scores = net.predict(texts)
    assert names[2] == names[3] == names[5] == "und" and scores[2] == 0
    raw = np.frombuffer(texts[0].encode(), np.uint8)
    p, n = net.params, len(raw)
    f, b, h = [], [None] * n, np.zeros((1, L.UNITS), np.float32)
    for t in range(n):
        h = L._gates(h, p["wf"][raw[t : t + 1]], p["uf"])[-1]
        f.append(h)
    h = np.zeros((1, L.UNITS), np.float32)
    for t in reversed(range(n)):
        h = b[t] = L._gates(h, p["wb"][raw[t : t + 1]], p["ub"])[-1]
    logits = np.concatenate([f[t] @ p["vf"] + b[t] @ p["vb"] + p["b"] for t in range(n)])
    prob = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert abs(prob.mean(axis=0).max() - scores[0]) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op2_language_id"](spark, MEDIUM).join(docs, "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang"] == r["lang_pred"] for r in held) / len(held)
    assert right >= 0.95, right
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None), (None, None, "en")], "doc_id long, text string, lang string")
    net = L.learn(docs)
    assert [r["lang_pred"] for r in L.identify(docs, net, ["doc_id"]).collect()] == ["und", "und"]
    assert L.identify(docs.filter(F.lit(False)), net, ["doc_id"]).count() == 0


def test_sample_is_the_least_hashes_of_each_language(spark):
    rows = [(i, f"l{i % 3 if i % 10 else 0}") for i in range(4000)] + [(i, "rare") for i in range(5000, 5007)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string")
    got = {tuple(r) for r in L._sampled(docs, 100).collect()}
    hashed = docs.withColumn("h", F.xxhash64("doc_id")).collect()
    want = set()
    for lang in {r["lang"] for r in hashed}:
        want |= {(r["doc_id"], lang) for r in sorted((r for r in hashed if r["lang"] == lang), key=lambda r: (r["h"], r["doc_id"]))[:100]}
    assert got == want


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "text here", "en", "x", 1.0)] * 2, "doc_id long, text string, lang string, lang_pred string, score double")
    out = L.identify(docs, L.learn(docs, steps=2), docs.columns)
    assert sorted(out.columns) == sorted(docs.columns) and [r["lang_pred"] for r in out.collect()] == ["en", "en"]


def test_an_id_that_repeats_is_one_row_of_the_sample(spark, monkeypatch):
    rows = [(1, f"word{i} and more of it", "en") for i in range(3000)] + [(i, f"mot{i} encore", "fr") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = []
    monkeypatch.setattr(L.Network, "train", lambda self, texts, labels, steps: taken.extend(zip([t.tobytes().decode() for t in texts], labels)))
    L.learn(docs, most_texts=100)
    assert len(taken) == 39 and sum(t.startswith("word") for t, _ in taken) == 1
