"""Phrase collocation mining: word sequences that occur oftener than their parts explain.

Two passes over the texts. The first fills a count-min sketch with all phrases of one to ``longest``
words. In the second each shard of texts keeps the phrases whose upper bound reaches ``least``, compiles
those of several words into an automaton, each between guarding blanks, and counts all its matches in
the shard's normalized text, overlaps included. Counts of shards are summed, so only candidates are
shuffled, and thresholds come last: what the sketch lets through wrongly goes there.

Everything is by language. Pieces are what stands between ``.,;:!?`` and line ends, words what stands
between blanks in a piece, with A-Z in lower case. Null texts have no words; a null language is ``und``,
as one named so; ids play no part, so repeated rows count again; further columns are ignored. Ties go by
score, count and phrase, whose order is that of UTF-8 bytes. A very long text is cut between pieces. An
empty table, or one without repeated phrases, gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm import count_sketch
from hearken.llm.shared import small, stored
from hearken.llm.word_arrays import Words, hashes, kinds, lots, words_of

KINDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
BREAKS = re.compile("[.,;:!?\n\x0b\x0c\r]")
#: Bytes of text of one shard, which is what one automaton scans.
SHARD = 8 << 20
#: Cells of the sketch, as a power of two. More of them let fewer phrases through in vain.
BITS = 27
COUNTS = "lang string, words int, phrase string, times long"


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """(language, texts) of one shard after the other."""

    def cut(text: str) -> Iterator[str]:
        while len(text) > SHARD and (at := BREAKS.search(text, SHARD)):
            yield text[: at.start()]
            text = text[at.end() :]
        yield text

    for rows in lots(batches, SHARD):
        by: dict[str, list[str]] = {}
        for lang, text in rows:
            by.setdefault(lang, []).extend(cut(text))
        for lang, texts in by.items():
            while texts:
                size, n = 0, 0
                while n < len(texts) and (not n or size + len(texts[n]) <= SHARD):
                    size += len(texts[n])
                    n += 1
                yield lang, texts[:n]
                del texts[:n]


def _within(first: np.ndarray, length: int) -> np.ndarray:
    """Places at which ``length`` words of one piece begin."""
    n = max(len(first) - length + 1, 0)
    ok = np.ones(n, bool)
    for k in range(1, length):
        ok &= ~first[k : n + k]
    return ok


def _keys(words: Words, lang: str, length: int) -> np.ndarray:
    """Hashes of the ``length`` words from each place on, whether they are of one piece or not."""
    by_word = hashes(words.names)
    n = max(len(words.ids) - length + 1, 0)
    out = np.full(n, hashes([lang.encode()])[0] + np.uint64(length), np.uint64)
    for k in range(length):
        out = (out ^ by_word[words.ids[k : n + k]]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _phrases(words: Words, may: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the different phrases that may be often enough: one place each. ``may`` says it
    of the places of each length; a phrase whose beginning or end is too rare is so itself."""
    rank = words.ids
    before = may[0]
    for length, ok in enumerate(may[1:], 2):
        n = len(ok)
        ok &= before[:n] & before[1 : n + 1]
        at = np.flatnonzero(ok)
        keys = rank[at] * len(words.names) + words.ids[at + length - 1]
        _, one, place = np.unique(keys, return_index=True, return_inverse=True)
        yield length, at[one]
        rank = np.zeros(n, np.int64)
        rank[at] = place
        before = ok


def _normal(words: Words) -> str:
    """The words, a blank before and after each, and a line end between pieces."""
    lengths = np.array([len(n) for n in words.names], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(words.names), np.uint8)
    size = lengths[words.ids]
    ends = np.cumsum(size + 1 + 2 * words.first)
    out = np.full(int(ends[-1]), ord(" "), np.uint8)
    starts = ends - size - 1
    out[starts[words.first] - 2] = ord("\n")
    each = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(starts, size) + each] = data[np.repeat(offsets[words.ids], size) + each]
    return out.tobytes().decode()


def _counted(words: Words, may: list[np.ndarray]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(length, phrases, occurrences) of the candidates of a shard."""
    names = np.array([n.decode() for n in words.names], object)
    often = np.zeros(len(names), bool)
    often[words.ids[may[0]]] = True
    yield 1, names[often].tolist(), np.bincount(words.ids, minlength=len(names))[often]
    found = [(length, [" ".join(p) for p in zip(*[names[words.ids[at + k]] for k in range(length)], strict=True)]) for length, at in _phrases(words, may)]
    automaton = ahocorasick.Automaton()
    number = 0
    for _, phrases in found:
        for phrase in phrases:
            automaton.add_word(f" {phrase} ", number)
            number += 1
    if not number:
        return
    automaton.make_automaton()
    matches = Counter(map(itemgetter(1), automaton.iter(_normal(words))))
    times = np.zeros(number, np.int64)
    times[list(matches)] = list(matches.values())
    for length, phrases in found:
        yield length, phrases, times[: len(phrases)]
        times = times[len(phrases) :]


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = BITS) -> DataFrame:
    """(lang, words, phrase, times): phrases of one to ``longest`` words that a language has ``least`` times
    or more; and with 0 words and an empty phrase all word occurrences of a language. Stored."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter(F.col("text").isNotNull())

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, None]]:
        for lang, some in _texts(batches):
            words = words_of(some, KINDS)
            yield np.concatenate([_keys(words, lang, k)[_within(words.first, k)] for k in range(1, longest + 1)]), None

    sketch = docs.sparkSession.sparkContext.broadcast(count_sketch.merged(texts, keys, least, bits))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("times", pa.int64())])
        for lang, some in _texts(batches):
            words = words_of(some, KINDS)
            if not len(words.ids):
                continue
            may = [_within(words.first, k) & sketch.value.reaches(_keys(words, lang, k)) for k in range(1, longest + 1)]
            for length, phrases, times in [(0, [""], np.array([len(words.ids)])), *_counted(words, may)]:
                for at in range(0, len(phrases), 50_000):
                    p = phrases[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(p)), pa.array([length] * len(p), pa.int32()), pa.array(p, pa.string()), pa.array(times[at : at + 50_000], pa.int64())], schema=schema)

    counts = texts.mapInArrow(scan, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("times").alias("times"))
    return stored(counts.filter((F.col("words") == 0) | (F.col("times") >= least)), "phrases")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact to 38 digits."""
    a, left, right = (c.cast("decimal(38,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * a * a, left * right)


def _first_ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language: of parts of it first, so that no task ranks a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = found.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)


def mine(docs: DataFrame, least: int = 10, most: int = 2000, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases of two or three words.

    ``a`` is a phrase's count, ``l`` and ``r`` those of its parts at the cut that scores least, the
    shorter left part first, and ``n`` the language's words. A phrase of two words goes if one of three
    has it inside and is at least half as often."""
    counts = phrase_counts(docs, 3, least, bits)
    split = F.split("phrase", " ")
    single, double, triple = (counts.filter(F.col("words") == k).drop("words") for k in (1, 2, 3))

    def part(of: DataFrame, name: str) -> DataFrame:
        return small(of, 1_000_000).select(F.col("lang"), F.col("phrase").alias(f"{name}_part"), F.col("times").alias(name))

    def joined(phrases: DataFrame, of: DataFrame, name: str, words: Column) -> DataFrame:
        return phrases.withColumn(f"{name}_part", words).join(part(of, name), ["lang", f"{name}_part"]).drop(f"{name}_part")

    inner = F.explode(F.array(F.array_join(F.slice(split, 1, 2), " "), F.array_join(F.slice(split, 2, 2), " ")))
    longer = triple.select("lang", inner.alias("phrase"), "times").groupBy("lang", "phrase").agg(F.max("times").alias("longer"))
    two = double.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < 50 * F.col("times"), F.lit(True)))
    two = joined(joined(two, single, "l", split[0]), single, "r", split[1])
    two = two.select("lang", "phrase", F.col("times").alias("a"), "l", "r", _score(F.col("times"), F.col("l"), F.col("r")).alias("score"))

    three = joined(joined(triple, single, "l1", split[0]), single, "r2", split[2])
    three = joined(joined(three, double, "r1", F.array_join(F.slice(split, 2, 2), " ")), double, "l2", F.array_join(F.slice(split, 1, 2), " "))
    first, second = (_score(F.col("times"), F.col(f"l{k}"), F.col(f"r{k}")) for k in (1, 2))
    three = three.withColumns({"s1": first, "s2": second}).withColumn("early", F.col("s1") <= F.col("s2"))
    three = three.select("lang", "phrase", F.col("times").alias("a"), *[F.when(F.col("early"), F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(name) for c, name in (("l", "l"), ("r", "r"), ("s", "score"))])

    n = counts.filter(F.col("words") == 0).select("lang", F.col("times").alias("n"))
    ranked = _first_ranked(two.unionByName(three), most)
    return ranked.join(small(n, 100_000), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
