"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding: case, look-alike letters of other scripts, digits and marks that stand for letters inside
a word, letters that such digits confuse (i, l and 1 are one), and runs of three or more. Lexicon:
words, and beginnings of words, whose rate among toxic labelled texts is well above that among
clean ones; learned from at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled texts, the bound of the
sample, of which near copies (the same smallest shingle) count once. Exception phrases: a lexicon
word with its neighbour that clean texts hold and toxic ones don't. Score: a logistic function of
the summed weight and of the weight by length, one hit a word, fitted to the same sample.

Null and empty texts have no hits and get the score of none. Each input row, repeated ones too, gives
one result row, an empty table none; kept columns named like a result give way to it.
Labels, where null, are not learned from; a sample without toxic texts gives an empty lexicon.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.shared import fresh, stored

MOST_TOXIC, MOST_CLEAN = 3000, 9000
PREFIXES = range(4, 9)
LEAST_TEXTS = 5
LEAST_ODDS = 1.5
THRESHOLD = 0.3

# Look-alikes of Latin letters, and what stands for letters inside words.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "­​‌‍⁠﻿"

# ASCII goes through a table of bytes, which is much faster than one of characters.
_BYTES = bytes(ord("i") if i == ord("l") else 32 if i < 128 and not chr(i).isalnum() and chr(i) not in SUBSTITUTES else i for i in range(256))
_OTHERS = LOOKALIKES | dict.fromkeys(INVISIBLE, "")
_OTHER = re.compile("[" + "".join(_OTHERS) + "]")
_STANDS = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[^\s0-9@$!|]*[0-9@$!|]\S*")
_MARK = re.compile(r"[0-9@$!|]")
_WIDE = re.compile("[\uff00-\uffef\U0001d400-\U0001d7ff]")
_LONG_RUN = re.compile(r"(\w)\1{2,}")


def _letters(m: re.Match) -> str:
    """A token with digits or marks: those inside or before letters, and digits after, are letters;
    marks at its end are punctuation; without any letter it is a number and stays."""
    token = m[0].rstrip("@$!|")
    return token.translate(_STANDS) if any(map(str.isalpha, token)) else token


def fold(text: str) -> str:
    """Folded words, a space before, between and after."""
    text = text.lower()
    if not text.isascii() and _WIDE.search(text):
        text = unicodedata.normalize("NFKC", text).lower()
    text = text.encode("utf-8", "replace").translate(_BYTES).decode()
    if not text.isascii() and _OTHER.search(text):
        text = _OTHER.sub(lambda m: _OTHERS[m[0]], text)
    if _MARK.search(text):
        text = _MIXED.sub(_letters, text)
    return " " + " ".join(_LONG_RUN.sub(r"\1", text).split()) + " "


def features(folded: str) -> set[str]:
    """' word ' and, for its beginnings, ' word' patterns of a folded text."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    slope: tuple[float, float, float] = (-3.0, 1.0, 0.0)

    def __post_init__(self):
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "slope": self.slope}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._automaton = None

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by the place of the word that was hit; the heaviest pattern of a word counts, and
        none inside an exception phrase."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._automaton.add_word(p, (len(p), w))
            for p in self.exceptions:
                self._automaton.add_word(p, (len(p), None))
            if self.weights:
                self._automaton.make_automaton()
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in self._automaton.iter(folded) if self.weights else ():
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        if not excused:
            return found
        # Exceptions as ranges that do not overlap, so that each hit is looked up in them once.
        ranges: list[list[int]] = []
        for a, b in sorted(excused):
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], b)
            else:
                ranges.append([a, b])
        starts = [a for a, _ in ranges]
        return {s: w for s, w in found.items() if not ((k := bisect_right(starts, s)) and s < ranges[k - 1][1])}

    def measure(self, text: str | None) -> tuple[float, float, int]:
        """(log of summed weight, log of weight a hundred words, hits)."""
        return self.measure_folded(fold(text or ""))

    def measure_folded(self, folded: str) -> tuple[float, float, int]:
        found = self.hits(folded)
        total = sum(found.values())
        return np.log1p(total), np.log1p(100 * total / max(folded.count(" ") - 1, 1)), len(found)

    def score(self, a: float, b: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope[0] + self.slope[1] * a + self.slope[2] * b))))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled texts by the hash of their ids."""
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    pick = lambda t, n: marked.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = stored(pick(1, MOST_TOXIC).unionByName(pick(0, MOST_CLEAN)), "labelled")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter("text IS NOT NULL").select("text", "toxic")

    def first_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode().split() for t in batch.column("text").to_pylist()]
            least = [min(xxhash.xxh3_64_intdigest(b" ".join(w[i : i + 5])) for i in range(max(len(w) - 4, 1))) - (1 << 63) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("toxic"), pa.array(least, pa.int64())], names=["text", "toxic", "first"])

    return stored(found.mapInArrow(first_shingle, "text string, toxic int, first long").dropDuplicates(["first", "toxic"]).select("text", "toxic"), "sample")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def flush() -> Iterator[pa.RecordBatch]:
        for toxic, c in counts.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["pattern", "toxic", "n"])
                c.clear()

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(features(fold(text)))
            if len(counts[toxic]) > 200_000:
                yield from flush()
    yield from flush()


def _shortest(weights: dict[str, float]) -> dict[str, float]:
    """Without patterns that extend another pattern of at least nearly their weight."""
    out: dict[str, float] = {}
    for p in sorted(weights, key=len):
        parts = [p[:n] for n in range(5, len(p))]
        if not any(x in out and out[x] >= weights[p] - 1 for x in parts):
            out[p] = weights[p]
    return out


def _exceptions(lexicon: Lexicon, rows: list[tuple[str, int]]) -> set[str]:
    """Phrases of a hit and a neighbouring word, of three clean texts or more and no toxic one."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for folded, toxic in rows:
        phrases = set()
        for start in lexicon.hits(folded):
            end = folded.index(" ", start + 1)
            before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
            phrases |= ({folded[before : end + 1]} if before >= 0 else set()) | ({folded[start : after + 1]} if after >= 0 else set())
        seen[toxic].update(phrases)
    return {p for p, n in seen[0].items() if n >= 3 and not seen[1][p]}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton's method with a little ridge, two features and an intercept."""
    x1, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + 0.5 * np.array([0, *w[1:]])
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + 0.5 * np.eye(3), grad)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """A lexicon from the labelled rows given; leave out the rows to be held out."""
    sample = _sample(docs, labels)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon()
    spread = sample.repartition(16, F.xxhash64("text"))
    by = lambda t: F.sum(F.when(F.col("toxic") == t, F.col("n")).otherwise(0))
    counted = spread.mapInArrow(_feature_counts, "pattern string, toxic int, n long").groupBy("pattern").agg(by(1).alias("t"), by(0).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1.0)) - F.log((F.col("c") + 0.5) / (n[0] + 1.0))
    sure = odds - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counted.filter(F.col("t") >= LEAST_TEXTS).withColumn("w", odds).filter(sure > LEAST_ODDS).select("pattern", "w").collect()
    lexicon = Lexicon(_shortest({r["pattern"]: float(r["w"]) for r in best}))
    # The sample is bounded, so its few thousand texts may come here to be folded.
    rows = [(fold(r["text"]), r["toxic"]) for r in sample.toLocalIterator()]
    lexicon = Lexicon(lexicon.weights, _exceptions(lexicon, rows))
    x = np.array([lexicon.measure_folded(folded)[:2] for folded, _ in rows])
    lexicon.slope = _logistic(x, np.array([t for _, t in rows], float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` + score, predicted, n_hits. Kept columns of these names are replaced."""
    keep = [k for k in keep if k.lower() not in ("score", "predicted", "n_hits")]
    (source,) = fresh(keep, "_text")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured = [shared.value.measure(t) for t in batch.column(source).to_pylist()]
            scores = [shared.value.score(a, b) for a, b, _ in measured]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([h for *_, h in measured], pa.int32())], names=[*keep, "score", "predicted", "n_hits"])

    kept = docs.select(*keep, F.col("text").alias(source))
    kinds = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{kinds}, score double, predicted int, n_hits int")
