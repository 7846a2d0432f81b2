"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Training takes windows, from anywhere in them, of at most ``MOST_TEXTS`` labelled texts a language and
about ``MOST_OF_ALL`` in all (the bounds of the sample, by the hash of their ids) on the driver: backpropagation through time with Adam, every
position labelled with its text's language. Prediction runs inside tasks over whole texts, cut
into segments that each start from empty states: a softmax over languages at every position, whose
mean over all positions is the document's distribution. Memory is bounded by ``BLOCK`` segments at
a time whatever a text's length.

Null texts and texts without a letter are 'und' with score 0, as is every text if there was nothing
to learn from. Of languages of equal probability the first by name is taken. Each input row, repeated
ones too, gives one result row, an empty table none; kept columns named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.llm.shared import fresh, small, stored

UNITS = 16
SEGMENT = 256
BLOCK = 1024
#: The bounded sample: texts of each language and of all, and characters of a window from each text.
MOST_TEXTS, MOST_OF_ALL, LEAST_TEXTS = 500, 50_000, 20
SAMPLE_CHARS = 2_000
WINDOW, BATCH, STEPS, RATE = 48, 192, 500, 0.01


def _gates(h: np.ndarray, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step for a batch: update and reset gates, the recurrent part of the candidate, the
    candidate, the new state. Sigmoids are tanh of half the argument."""
    n = h.shape[1]
    a = h @ u
    zr = np.tanh((x[:, : 2 * n] + a[:, : 2 * n]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
    z, r = zr[:, :n], zr[:, n:]
    c = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
    return z, r, a[:, 2 * n :], c, c + z * (h - c)


@dataclass
class Network:
    """Parameters of both directions: rows by byte (wf, wb), recurrent matrices (uf, ub), output."""

    languages: list[str]
    params: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], units: int = UNITS, seed: int = 7, dtype=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        shapes = {"wf": (257, 3 * units), "wb": (257, 3 * units), "uf": (units, 3 * units), "ub": (units, 3 * units), "vf": (units, len(languages)), "vb": (units, len(languages))}
        params = {k: (rng.standard_normal(s) * (0.3 if k[0] == "w" else units**-0.5)).astype(dtype) for k, s in shapes.items()}
        return cls(languages, params | {"b": np.zeros(len(languages), dtype)})

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions of ``data`` (batch x time, 256 marks padding) and its
        gradients, by backpropagation through time."""
        p, (size, steps) = self.params, data.shape
        kind, units = p["b"].dtype, p["uf"].shape[0]
        real = (data < 256).astype(kind)
        states, kept = {}, {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h, states[d], kept[d] = np.zeros((size, units), kind), {}, {}
            for t in order:
                m = real[:, t, None]
                *parts, new = _gates(h, p["w" + d][data[:, t]], p["u" + d])
                kept[d][t] = (h, m, *parts)
                h = new * m + h * (1 - m)
                states[d][t] = h
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        loss, total = 0.0, real.sum()
        out = {"f": {}, "b": {}}
        for t in range(steps):
            logits = states["f"][t] @ p["vf"] + states["b"][t] @ p["vb"] + p["b"]
            logits -= logits.max(axis=1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(axis=1, keepdims=True)
            loss -= float((np.log(prob[np.arange(size), label] + 1e-12) * real[:, t]).sum())
            prob[np.arange(size), label] -= 1
            prob *= real[:, t, None] / total
            grads["b"] += prob.sum(axis=0)
            for d in "fb":
                grads["v" + d] += states[d][t].T @ prob
                out[d][t] = prob @ p["v" + d].T
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            u, back = p["u" + d], np.zeros((size, units), kind)
            for t in order:
                h, m, z, r, a, c = kept[d][t]
                back = back + out[d][t]
                new = back * m
                dc = new * (1 - z) * (1 - c * c)
                dz = new * (h - c) * z * (1 - z)
                dr = dc * a * r * (1 - r)
                into = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(grads["w" + d], data[:, t], np.concatenate([dz, dr, dc], axis=1))
                grads["u" + d] += h.T @ into
                back = back * (1 - m) + new * z + into @ u.T
        return loss / float(total), grads

    def train(self, data: list[np.ndarray], label: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on random windows, as many of each language."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        first, second = ({k: np.zeros_like(v) for k, v in self.params.items()} for _ in range(2))
        for step in range(1, steps + 1):
            picked = rng.integers(0, len(of), BATCH)
            batch = np.full((BATCH, WINDOW), 256, np.int64)
            for i, k in enumerate(picked):
                text = data[rng.choice(of[k])]
                at = rng.integers(0, max(len(text) - WINDOW, 0) + 1)
                part = text[at : at + WINDOW]
                batch[i, : len(part)] = part
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradients(batch, picked)[1].items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.params[k] = (self.params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed position probabilities (segment x language) of segments sorted by falling length."""
        p, (size, steps) = self.params, data.shape
        units = p["uf"].shape[0]
        alive = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # segments that reach position t
        forward = np.zeros((steps, size, units), np.float32)
        h = np.zeros((size, units), np.float32)
        for t in range(steps):
            n = alive[t]
            h = _gates(h[:n], p["wf"][data[:n, t]], p["uf"])[-1]
            forward[t, :n] = h
        sums = np.zeros((size, len(self.languages)), np.float64)
        h = np.zeros((size, units), np.float32)
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            h[:n] = _gates(h[:n], p["wb"][data[:n, t]], p["ub"])[-1]
            logits = forward[t, :n] @ p["vf"] + h[:n] @ p["vb"] + p["b"]
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            sums[:n] += prob / prob.sum(axis=1, keepdims=True)
        return sums

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raws = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        probs = np.zeros((len(texts), len(self.languages)))
        waiting: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            waiting.sort(key=lambda w: -len(w[1]))
            lengths = np.array([len(s) for _, s in waiting])
            data = np.zeros((len(waiting), lengths[0]), np.uint8)
            for row, (_, s) in zip(data, waiting, strict=True):
                row[: len(s)] = s
            np.add.at(probs, [i for i, _ in waiting], self.pooled(data, lengths))
            waiting.clear()

        for i, raw in enumerate(raws):
            for at in range(0, len(raw) if self.languages else 0, SEGMENT):
                waiting.append((i, raw[at : at + SEGMENT]))
                if len(waiting) == BLOCK:
                    flush()
        if waiting:
            flush()
        names, scores = [], []
        for text, raw, prob in zip(texts, raws, probs, strict=True):
            known = bool(self.languages) and any(map(str.isalpha, text or ""))
            best = int(prob.argmax()) if known else 0
            names.append(self.languages[best] if known else "und")
            scores.append(float(min(prob[best] / len(raw), 1.0)) if known else 0.0)
        return names, scores


def _sampled(labelled: DataFrame, most_texts: int) -> DataFrame:
    """(doc_id, lang) of ``most_texts`` rows a language, those of the least hashes; stored. Counts tell how
    small a hash must be, so only a few more rows than are wanted are ranked, however common a language."""
    counts = stored(labelled.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    most = max(min(most_texts, MOST_OF_ALL // max(languages, 1)), LEAST_TEXTS)
    place = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    near = labelled.join(small(counts, 100_000), "lang").filter(place * F.col("n") <= most + 6 * most**0.5 + 10).select("doc_id", "lang")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return stored(near.withColumn("k", rank).filter(F.col("k") <= most).select("doc_id", "lang"), "languageSample")


def learn(docs: DataFrame, most_texts: int = MOST_TEXTS, steps: int = STEPS) -> Network:
    """A network from ``text`` and ``lang`` of the rows given; leave out the rows to be held out. Every
    language of those rows can be predicted. The sample is bounded: see ``MOST_TEXTS``."""
    labelled = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    picked = _sampled(labelled.select("doc_id", "lang").distinct(), most_texts)
    # A window from anywhere in the text, at a place that the id determines.
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    window = F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit("window")), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    # An id that many rows have gives one of its texts.
    some = labelled.select("doc_id", "lang", window.alias("text")).join(small(picked, 2 * MOST_OF_ALL), ["doc_id", "lang"])
    rows = some.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang").collect()
    rows = sorted({(r["text"], r["lang"]) for r in rows if any(map(str.isalpha, r["text"]))})
    languages = sorted({lang for _, lang in rows})
    network = Network.fresh(languages)
    if languages:
        network.train([np.frombuffer(t.encode(), np.uint8) for t, _ in rows], np.array([languages.index(lang) for _, lang in rows]), steps)
    return network


def identify(docs: DataFrame, network: Network, keep: list[str]) -> DataFrame:
    """The columns ``keep`` + lang_pred, score, from ``text`` alone. Kept columns of these names are replaced."""
    keep = [k for k in keep if k.lower() not in ("lang_pred", "score")]
    (source,) = fresh(keep, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                names, scores = shared.value.predict(part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(names), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    kept = docs.select(*keep, F.col("text").alias(source))
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{kinds}, lang_pred string, score double")
