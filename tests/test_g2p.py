import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearken.functions import g2p


def some_weights(seed=1, emb=6, size=5):
    rng = np.random.default_rng(seed)
    w = {"enc_emb": (29, emb), "dec_emb": (74, emb), "fc_w": (74, size), "fc_b": (74,)}
    for side in ("enc", "dec"):
        w |= {f"{side}_w_ih": (3 * size, emb), f"{side}_w_hh": (3 * size, size), f"{side}_b_ih": (3 * size,), f"{side}_b_hh": (3 * size,)}
    out = {k: rng.normal(size=s).astype(np.float32) for k, s in w.items()}
    out["fc_b"][3] += 1.5
    return out


def one_by_one(word, w):
    """A word alone, number by number."""
    size = w["enc_w_hh"].shape[1]

    def step(x, h, side):
        gate = lambda m, b, v, i: float(sum(m[i][j] * v[j] for j in range(len(v))) + b[i])
        ih = [gate(w[f"{side}_w_ih"], w[f"{side}_b_ih"], x, i) for i in range(3 * size)]
        hh = [gate(w[f"{side}_w_hh"], w[f"{side}_b_hh"], h, i) for i in range(3 * size)]
        s = lambda v: 1 / (1 + math.exp(-v))
        out = []
        for i in range(size):
            r, z = s(ih[i] + hh[i]), s(ih[size + i] + hh[size + i])
            n = math.tanh(ih[2 * size + i] + r * hh[2 * size + i])
            out.append((1 - z) * n + z * h[i])
        return out

    letters = {g: i for i, g in enumerate(g2p.GRAPHEMES)}
    h = [0.0] * size
    for c in [*word, "</s>"]:
        h = step(w["enc_emb"][letters.get(c, 1)], h, "enc")
    said, last = [], 2
    for _ in range(20):
        h = step(w["dec_emb"][last], h, "dec")
        logits = [sum(a * b for a, b in zip(row, h)) + c for row, c in zip(w["fc_w"], w["fc_b"])]
        last = max(range(74), key=lambda i: logits[i])
        if last == 3:
            break
        said.append(g2p.PHONEMES[last])
    return said


WORDS = ["a", "the", "penalty", "goal", "", "Élan", "it's", "zzzzzzzzzzzz", "word", "cat", "dog"]


def test_sizes():
    assert len(g2p.GRAPHEMES) == 29 and len(g2p.PHONEMES) == 74 and g2p.PHONEMES[4] == "AA0" and g2p.PHONEMES[-1] == "ZH"


@pytest.mark.parametrize("seed", range(4))
def test_together_as_one_by_one(seed):
    w = some_weights(seed)
    said = g2p.Network(w).phonemes(WORDS)
    assert said == [one_by_one(x, w) for x in WORDS]
    assert max(map(len, said)) <= 20


def test_outputs_have_many_lengths():
    assert len({len(s) for seed in range(4) for s in g2p.Network(some_weights(seed)).phonemes(WORDS)}) > 3


def test_long_outputs_end():
    w = some_weights(2)
    w["fc_b"][3] = -1e9
    assert all(len(s) == 20 for s in g2p.Network(w).phonemes(WORDS))
    with pytest.raises(ValueError):
        g2p.Network(w | {"enc_emb": np.zeros((3, 6))})


def test_columns(spark):
    df = spark.createDataFrame([(1, ["the", "goal"]), (2, ["goal"]), (3, [])], "id long, ws array<string>")
    got = {r["id"]: r["phonemes"] for r in g2p.pronounced(df, ["id"], "ws", "tests.test_g2p:some_weights").collect()}
    w = some_weights()
    assert got == {1: [*one_by_one("the", w), " ", *one_by_one("goal", w)], 2: one_by_one("goal", w), 3: None}
    one = spark.createDataFrame([("cat",), (None,)], "w string").select(g2p.phonemes(F.col("w"), "tests.test_g2p:some_weights").alias("p")).collect()
    assert [r["p"] for r in one] == [one_by_one("cat", w), None]
