"""Words alike: exact, by an equi-join where that is selective and by blocks of equal lengths elsewhere.

The indel ratio 200 * common / (a + b) reaches ``least`` only if the letters to take out and put in are at
most ``D = (1 - least / 100) * (a + b)`` for lengths a and b. A word cut into D + 1 segments has one that
none of these touches, and that stands in the token at most D places off. So a word's keys are its segments,
and a token's keys are its pieces of their lengths at these places, for each length that words have.

Segments of one or two letters stand in most tokens. There a row a pair that meets would cost more than the
comparison: a block of tokens of one length is held against a word at once, a letter of all in one step, and
only pairs that reach the ratio become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from hearken.functions import text as T
from hearken.operators.sizes import small, written

#: Letters of a segment from which on words and tokens meet by pieces.
SELECTIVE = 3
#: Tokens and words that one task holds against each other.
TOKENS, WORDS = 8192, 4096


def _edits(a: Column, b: Column, least: float) -> Column:
    """Letters that may differ; a little more for rounding, as the ratio itself decides in the end."""
    return F.floor((1 - least / 100) * (a + b) + 1e-9).cast("int")


def _segment(k: Column, of: Column, length: Column) -> tuple[Column, Column]:
    """First place (from 0) and size of a segment."""
    first = F.floor(k * length / of).cast("int")
    return first, F.floor((k + 1) * length / of).cast("int") - first


def _common(word: str, letters: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Longest common subsequences of a word and of tokens of one length, whose letters are numbers of
    ``known``, a row for each place: the bits of ``common_length`` for all tokens at once."""
    masks: dict[int, int] = {}
    for i, c in enumerate(word):
        masks[ord(c)] = masks.get(ord(c), 0) | 1 << i
    table = np.array([masks.get(c, 0) for c in known.tolist()], np.uint64)
    every = np.uint64((1 << len(word)) - 1)
    row = np.full(letters.shape[1], every)
    for place in letters:
        met = row & table[place]
        row = ((row + met) | (row - met)) & every
    return len(word) - np.bitwise_count(row).astype(np.int64)


def _compared(least: float):
    """Tokens of one length and words, to (token, wanted, r) of those that reach the ratio."""

    def compare(tokens: pa.Table, words: pa.Table) -> pa.Table:
        have, wanted = tokens["token"].to_pylist(), words["wanted"].to_pylist()
        at, of, ratios = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if have:
            a = len(have[0])
            codes = np.frombuffer("".join(have).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(have), a)
            known, letters = np.unique(codes, return_inverse=True)
            letters = np.ascontiguousarray(letters.reshape(codes.shape).T)
            for k, word in enumerate(wanted):
                common = _common(word, letters, known) if len(word) < 64 else np.array([T.common_length(t, word) for t in have])
                r = 200.0 * common / (a + len(word))
                found = np.flatnonzero(r >= least)
                at.append(found)
                of.append(np.full(len(found), k))
                ratios.append(r[found])
        return pa.table({"token": tokens["token"].take(pa.array(np.concatenate(at))), "wanted": words["wanted"].take(pa.array(np.concatenate(of))), "r": np.concatenate(ratios)})

    return compare


def _by_blocks(have: DataFrame, wanted: DataFrame, lengths: DataFrame, least: float) -> DataFrame:
    """(token, wanted, r) of tokens (token, a) and words (wanted, b) of the ``lengths`` (a, b). Tokens of one
    length are dealt to blocks, and so are the words that may be like them; each two blocks meet in one task."""
    near = wanted.join(F.broadcast(lengths), "b").select("wanted", "a")
    count = lambda rows, most, name: rows.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = count(have, TOKENS, "of_tokens").join(count(near, WORDS, "of_words"), "a")
    block = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = have.join(F.broadcast(grid), "a").select("token", "a", block("token", "of_tokens").alias("t"), each("of_words").alias("w"))
    right = near.join(F.broadcast(grid), "a").select("wanted", "a", block("wanted", "of_words").alias("w"), each("of_tokens").alias("t"))
    pairs = left.groupBy("a", "t", "w").cogroup(right.groupBy("a", "t", "w"))
    return pairs.applyInArrow(_compared(least), "token string, wanted string, r double")


def alike(tokens: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(token, wanted, r) of the different ``tokens`` (token) and ``words`` (wanted) whose indel ratio, 0 to 100,
    is ``least`` or more. Words of no letters are like none. Where so little is asked that segments would be
    short or empty, words and tokens of two lengths meet in blocks."""
    a, b = F.col("a"), F.col("b")
    have = written(tokens.select("token").distinct().withColumn("a", F.length("token")).filter("a > 0"), "have")
    wanted = written(words.select("wanted").distinct().withColumn("b", F.length("wanted")).filter("b > 0"), "wanted")
    lengths = have.select("a").distinct().join(F.broadcast(wanted.select("b").distinct()), 200.0 * F.least(a, b) / (a + b) >= least)
    lengths = written(lengths.withColumn("d", _edits(a, b, least)).withColumn("parts", F.col("d") + 1), "lengths")
    selective = F.floor(b / F.col("parts")) >= SELECTIVE
    blocks = _by_blocks(have, wanted, lengths.filter(~selective).select("a", "b"), least)

    lengths = lengths.filter(selective)
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    first, size = _segment(F.col("k"), F.col("parts"), b)
    of_words = wanted.join(F.broadcast(lengths), "b").withColumn("k", F.explode(each)).select("wanted", "a", "b", "k", F.col("wanted").substr(first + 1, size).alias("piece"))

    low, high = F.greatest(first - F.col("d"), F.lit(0)), F.least(first + F.col("d"), a - size)
    of_tokens = have.join(F.broadcast(lengths), "a").withColumn("k", F.explode(each)).filter(low <= high)
    # Equal pieces of a token are one, found in its row and not by an exchange of all pieces.
    pieces = F.array_distinct(F.transform(F.sequence(low, high), lambda at: F.col("token").substr(at + 1, size)))
    of_tokens = of_tokens.select("token", "a", "b", "k", F.explode(pieces).alias("piece"))

    met = of_tokens.join(small(of_words), ["a", "b", "k", "piece"]).select("token", "wanted").distinct()
    # As it counts as not deterministic, it is asked once for the filter and the result.
    ratio = F.pandas_udf(T.indel_ratio.func, DoubleType()).asNondeterministic()
    return met.withColumn("r", ratio(F.col("token"), F.col("wanted"))).filter(F.col("r") >= least).unionByName(blocks)
