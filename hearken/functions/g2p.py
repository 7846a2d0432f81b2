"""Phonemes of words by a small recurrent network, in numpy, for many words at once.

An encoder reads a word's letters and an end mark; from its last state a decoder names one phoneme after
the other, the likeliest each time, until its end mark or ``MOST`` phonemes. Words go through together:
those of one length in the encoder, and in the decoder all that have not ended. Weights come from a slot
``module:name``, a function that returns them by name, as none are public here. Shapes say the sizes.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model: its marks, letters, and phonemes (vowels with three stresses, and one without).
GRAPHEMES = ["<pad>", "<unk>", "</s>", *"abcdefghijklmnopqrstuvwxyz"]
_VOWELS = "AA AE AH AO AW AY EH ER EY IH IY OW OY UH UW".split()
_CONSONANTS = "B CH D DH F G HH JH K L M N NG P R S SH T TH V W Y Z ZH".split()
PHONEMES = ["<pad>", "<unk>", "<s>", "</s>", *sorted([f"{v}{k}" for v in _VOWELS for k in "012"] + _CONSONANTS + ["UW"])]
MOST = 20
#: Words of one pass.
TOGETHER = 4096


def _cell(given: np.ndarray, state: np.ndarray, w_ih: np.ndarray, w_hh: np.ndarray, b_ih: np.ndarray, b_hh: np.ndarray) -> np.ndarray:
    """A gated recurrent unit: reset, update and candidate gates, in this order of rows."""
    size = state.shape[1]
    x, h = given @ w_ih.T + b_ih, state @ w_hh.T + b_hh
    gate = 1 / (1 + np.exp(-(x[:, : 2 * size] + h[:, : 2 * size])))
    reset, update = gate[:, :size], gate[:, size:]
    candidate = np.tanh(x[:, 2 * size :] + reset * h[:, 2 * size :])
    return candidate + update * (state - candidate)


class Network:
    """Names of ``weights``: enc_emb, dec_emb, fc_w, fc_b, and w_ih, w_hh, b_ih, b_hh after enc_ and dec_."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        self.letters = {g: i for i, g in enumerate(GRAPHEMES)}
        if self.w["enc_emb"].shape[0] != len(GRAPHEMES) or self.w["fc_w"].shape[0] != len(PHONEMES):
            raise ValueError("weights of other letters or phonemes")

    def _gates(self, side: str) -> list[np.ndarray]:
        return [self.w[f"{side}_{k}"] for k in ("w_ih", "w_hh", "b_ih", "b_hh")]

    def encoded(self, words: list[str]) -> np.ndarray:
        """The encoder's last state for words of one length."""
        unknown, end = self.letters["<unk>"], self.letters["</s>"]
        ids = np.array([[*(self.letters.get(c, unknown) for c in w), end] for w in words])
        state = np.zeros((len(words), self.w["enc_w_hh"].shape[1]), np.float32)
        gates = self._gates("enc")
        for t in range(ids.shape[1]):
            state = _cell(self.w["enc_emb"][ids[:, t]], state, *gates)
        return state

    def decoded(self, state: np.ndarray) -> tuple[list[list[str]], np.ndarray]:
        """Phonemes from states, and the decoder's states, zero after a word's end."""
        gates, n = self._gates("dec"), len(state)
        begin, end = PHONEMES.index("<s>"), PHONEMES.index("</s>")
        said = np.full((n, MOST), -1)
        states = np.zeros((n, MOST, state.shape[1]), np.float32)
        going, last = np.arange(n), np.full(n, begin)
        for t in range(MOST):
            if not len(going):
                break
            state = _cell(self.w["dec_emb"][last], state, *gates)
            last = (state @ self.w["fc_w"].T + self.w["fc_b"]).argmax(axis=1)
            on = last != end
            going, state, last = going[on], state[on], last[on]
            said[going, t], states[going, t] = last, state
        return [[PHONEMES[i] for i in row if i >= 0] for row in said], states

    def phonemes(self, words: list[str]) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in words]
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for places in by.values():
            for at in range(0, len(places), TOGETHER):
                some = places[at : at + TOGETHER]
                for k, found in zip(some, self.decoded(self.encoded([words[k] for k in some]))[0], strict=True):
                    out[k] = found
        return out


def weights_by_rule(letters: int = 16, size: int = 32) -> dict[str, np.ndarray]:
    """Weights of a network that was never trained, the same everywhere: for runs without a trained one."""
    shapes = {"enc_emb": (len(GRAPHEMES), letters), "dec_emb": (len(PHONEMES), letters), "fc_w": (len(PHONEMES), size), "fc_b": (len(PHONEMES),)}
    for side in ("enc", "dec"):
        shapes |= {f"{side}_w_ih": (3 * size, letters), f"{side}_w_hh": (3 * size, size), f"{side}_b_ih": (3 * size,), f"{side}_b_hh": (3 * size,)}
    return {name: np.random.default_rng(k).normal(size=shape).astype(np.float32) for k, (name, shape) in enumerate(shapes.items())}


def phonemes(word: Column, factory: str) -> Column:
    """array<string> of a word; null for null."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        module, name = factory.split(":")
        network = Network(getattr(importlib.import_module(module), name)())
        for words in parts:
            there = words.notna()
            out = pd.Series([None] * len(words), dtype=object)
            for k, found in zip(np.flatnonzero(there), network.phonemes(words[there].tolist()), strict=True):
                out.iloc[k] = found
            yield out

    return run(word)


def pronounced(rows: DataFrame, by: list[str], words: str, factory: str) -> DataFrame:
    """(by, phonemes): of the array ``words`` in order, a blank between words. Every different word goes
    through the network once; the joins are on words."""
    placed = rows.select(*by, F.posexplode(words).alias("place", "word"))
    known = placed.select("word").distinct().withColumn("said", phonemes(F.col("word"), factory))
    spoken = placed.join(known, "word").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("all"))
    joined = F.flatten(F.transform("all", lambda s, i: F.when(i == 0, s["said"]).otherwise(F.concat(F.array(F.lit(" ")), s["said"]))))
    return rows.select(*by).distinct().join(spoken.select(*by, joined.alias("phonemes")), by, "left")
