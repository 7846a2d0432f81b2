"""Keyword matching over word streams: windows, the match cascade, suppression in time.

A stream table has a row for each chunk or text: its key columns and ``ws``, the words that a
recognizer returned, as ``array<struct<raw, token, start_ms, end_ms, score>>`` in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.functions import text as T
from hearken.functions.models import complete_words
from hearken.operators import lookup, scans
from hearken.operators.sizes import small, written

#: Keywords up to which their grams are looked up in the expression, before the join.
LOOKED_UP = 10_000
WEIGHTS = {"exact": 1.0, "phonetic": 0.9}
#: Bits of a run's key, of which the upper ones are its part, and of the table of recurring keys at most.
KEY_BITS, PART_BITS, TABLE_BITS = 40, 8, 29
#: Runs of words whose keys a task sorts at once.
SORTED = 1 << 20


def recognized(chunks: DataFrame, words: str = "words") -> DataFrame:
    """A stream table from a recognizer's ``array<struct<word, start, end, score>>`` in seconds. Words
    that lack a field or normalize to nothing go, and the others close up."""
    token = lambda w: F.element_at(F.split(F.trim(T.normalized(w["word"])), r"\s+"), 1)
    milli = lambda x: F.round(x * 1000).cast("long")
    ws = F.transform(complete_words(F.col(words)), lambda w: F.struct(w["word"].alias("raw"), token(w).alias("token"), milli(w["start"]).alias("start_ms"), milli(w["end"]).alias("end_ms"), w["score"].cast("double").alias("score")))
    return chunks.withColumn("ws", F.filter(ws, lambda w: w["token"] != "")).drop(words)


def word_rows(streams: DataFrame) -> DataFrame:
    """A row for each word: the stream's columns, pos, and the word's."""
    keys = [c for c in streams.columns if c != "ws"]
    return streams.select(*keys, F.posexplode("ws").alias("pos", "w")).select(*keys, "pos", "w.*")


def targets(spark, keywords: list[str]) -> DataFrame:
    """(keyword, tokens, n, codes) of keywords that do not normalize to nothing."""
    rows = spark.createDataFrame([(k,) for k in keywords], "keyword string")
    tokens = F.filter(F.split(T.normalized(F.col("keyword")), r"\s+"), lambda t: t != "")
    listed = rows.select("keyword", tokens.alias("tokens")).withColumn("n", F.size("tokens")).filter("n > 0")
    coded = listed.select("keyword", F.posexplode("tokens").alias("i", "t")).withColumn("code", T.metaphone_code("t"))
    codes = coded.groupBy("keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda s: s["code"]).alias("codes"))
    return listed.join(codes, "keyword")


def _grams(ws: Column, n: int) -> Column:
    """array<struct<pos, w>>: every run of ``n`` words; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.struct((i - 1).alias("pos"), F.slice(ws, i, n).alias("w")))
    return F.when(F.size(ws) >= n, runs)


def ngrams(streams: DataFrame, n: int) -> DataFrame:
    """keys + (pos, gram, context) inside each stream's row, without any shuffle. Only the runs of words
    leave the row, not the row's whole array with each of them."""
    keys = [c for c in streams.columns if c != "ws"]
    at = streams.select(*keys, F.explode(_grams(F.col("ws"), n)).alias("g"))
    part = F.col("g.w")
    return at.select(*keys, "g.pos", F.array_join(part["token"], " ").alias("gram"), F.array_join(part["raw"], " ").alias("context"))


def _keys(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, row and place of every run of ``n`` words, from the rows' hashes of words."""
    offsets = words.offsets.to_numpy().astype(np.int64)
    hashes = words.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
    row = np.repeat(np.arange(len(words)), np.diff(offsets))
    runs = max(len(hashes) - n + 1, 0)
    whole = np.flatnonzero(row[:runs] == row[n - 1 :]) if runs else np.zeros(0, np.int64)
    mixed = np.zeros(runs, np.uint64)
    for i in range(n):
        mixed = (mixed ^ hashes[i : runs + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed[whole] >> np.uint64(64 - KEY_BITS), row[whole], whole - (offsets[:-1] - offsets[0])[row[whole]]


def _recurring(hashed: DataFrame, n: int, least: int) -> DataFrame:
    """(part, keys): the keys of ``n`` words that occur ``least`` times, four bytes each within their part,
    written. An exchange carries keys alone, each at most ``least`` times from a sorted lot."""
    low = KEY_BITS - PART_BITS

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(waiting))
            waiting.clear()
            enough = np.ones(len(keys), bool)
            enough[least:] = keys[least:] != keys[:-least]
            keys = keys[enough]
            bounds = np.searchsorted(keys >> np.uint64(low), np.arange(1 << PART_BITS, dtype=np.uint64)).tolist() + [len(keys)]
            some = [i for i in range(1 << PART_BITS) if bounds[i] < bounds[i + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[bounds[i] : bounds[i + 1]].astype("<u4").tobytes() for i in some], pa.binary())], names=["part", "keys"])

        for batch in batches:
            waiting.append(_keys(batch.column(0), n)[0])
            if sum(map(len, waiting)) >= SORTED:
                yield flush()
        if waiting:
            yield flush()

    def often(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(k.as_buffer(), "<u4") for k in table["keys"]]))
        found = np.unique(keys[least - 1 :][keys[least - 1 :] == keys[: len(keys) - least + 1]])
        return pa.table({"part": table["part"][:1], "keys": pa.array([found.tobytes()], pa.binary())})

    schema = "part int, keys binary"
    return written(hashed.mapInArrow(dealt, schema).groupBy("part").applyInArrow(often, schema), "recurring")


def _table(recurring: DataFrame) -> tuple[np.ndarray, int]:
    """A table of bits by key, eight for each of the keys or more until there are 2 ** TABLE_BITS."""
    total = (recurring.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 4
    bits = min(max((8 * total).bit_length(), PART_BITS + 3), TABLE_BITS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for keys in batch.column("keys"):
                block = np.zeros(1 << (bits - PART_BITS), bool)
                block[np.frombuffer(keys.as_buffer(), "<u4") >> np.uint32(KEY_BITS - bits)] = True
                found.append(np.packbits(block, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(found, pa.binary())], names=["part", "keys"])

    table = np.zeros((1 << PART_BITS, 1 << (bits - PART_BITS - 3)), np.uint8)
    for row in recurring.mapInArrow(blocks, "part int, keys binary").toLocalIterator():
        table[row["part"]] = np.frombuffer(row["keys"], np.uint8)
    return table.ravel(), bits


def recurring_ngrams(streams: DataFrame, n: int, least: int) -> DataFrame:
    """``ngrams`` without nearly all of those that occur fewer than ``least`` times; all others are whole, so
    that a count of them is exact. Two passes: keys of runs are counted first, and the texts of runs are made
    only where the key recurs. A rare run whose key shares a bit with a recurring one comes along."""
    keys = [c for c in streams.columns if c != "ws"]
    hashes = F.transform("ws", lambda w: F.xxhash64(w["token"]))
    shared = streams.sparkSession.sparkContext.broadcast(_table(_recurring(streams.select(hashes.alias("h")), n, least)))

    @F.arrow_udf("array<int>")
    def places(words: pa.Array) -> pa.Array:
        table, bits = shared.value
        key, row, at = _keys(words, n)
        bit = key >> np.uint64(KEY_BITS - bits)
        found = table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[found], minlength=len(words)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[found], pa.int32()))

    placed = streams.withColumn("_at", places(hashes))
    runs = F.transform("_at", lambda i: F.struct(i.alias("pos"), F.slice("ws", i + 1, n).alias("w")))
    part = F.col("g.w")
    return placed.select(*keys, F.explode(runs).alias("g")).select(*keys, "g.pos", F.array_join(part["token"], " ").alias("gram"), F.array_join(part["raw"], " ").alias("context"))


def exact_matches(streams: DataFrame, keywords: DataFrame, lengths: list[int]) -> DataFrame:
    """Detections of exact matches, of all lengths in one pass: runs of words that begin like a keyword,
    joined to the keywords by their text. Confidence is the mean word score."""
    keys = [c for c in streams.columns if c != "ws"]
    wanted = keywords.filter(F.col("n").isin(lengths)).select("keyword", F.array_join("tokens", " ").alias("gram"))
    listed = [r["gram"] for r in wanted.select("gram").distinct().limit(LOOKED_UP + 1).collect()]
    starts = sorted({g.split(" ")[0] for g in listed})
    ws = F.col("ws")
    if len(listed) <= LOOKED_UP:
        begins = F.filter(F.transform(ws, lambda w, i: F.when(w["token"].isin(starts), i + 1)), lambda i: i.isNotNull())
    else:
        begins = F.when(F.size(ws) > 0, F.sequence(F.lit(1), F.size(ws)))
    rows = streams.withColumn("_begins", begins)

    def runs(n: int) -> Column:
        whole = F.filter("_begins", lambda i: i + (n - 1) <= F.size("ws"))
        return F.transform(whole, lambda i: F.struct((i - 1).alias("pos"), F.slice("ws", i, n).alias("w")))

    at = rows.select(*keys, F.explode(F.concat(*map(runs, lengths))).alias("g")).select(*keys, "g.pos", "g.w").withColumn("gram", F.array_join(F.col("w.token"), " "))
    hit = at.join(small(wanted), "gram")
    mean = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["score"]) / F.size("w")
    return hit.select(*keys, "pos", "keyword", F.element_at("w", 1)["start_ms"].alias("start_ms"), F.element_at("w", -1)["end_ms"].alias("end_ms"), mean.alias("confidence"), F.lit("exact").alias("match_type"), F.array_join(F.col("w.raw"), " ").alias("context"))


def _verdict(fuzzy_ratio: float, phonetic: bool):
    """(tokens, wanted, codes, place) to the kind of match and the mean ratio of the places. A window that an
    earlier place than ``place`` has found as well is none here, so that each is judged once."""

    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ratios: dict[tuple[str, str], float] = {}
        codes_of: dict[str, str] = {}

        def ratio(a: str, b: str) -> float:
            if (a, b) not in ratios:
                ratios[a, b] = 200.0 * T.common_length(a, b) / (len(a) + len(b))
            return ratios[a, b]

        def code(token: str) -> str:
            if token not in codes_of:
                codes_of[token] = T.metaphone(token)
            return codes_of[token]

        def found(token: str, want: str, coded: str) -> bool:
            return ratio(token, want) >= fuzzy_ratio or (phonetic and code(token) == coded)

        for tokens, wanted, codes, places in parts:
            kinds, means = [], []
            for have, want, coded, place in zip(tokens, wanted, codes, places, strict=True):
                mean = sum(map(ratio, have, want)) / len(want)
                if any(map(found, have[:place], want, coded)):
                    kind = None
                elif list(have) == list(want):
                    kind = "exact"
                elif phonetic and all(code(t) == c for t, c in zip(have, coded, strict=True)):
                    kind = "phonetic"
                else:
                    kind = "fuzzy" if mean >= fuzzy_ratio else None
                kinds.append(kind)
                means.append(mean)
            if len(ratios) + len(codes_of) > 500_000:
                ratios.clear()
                codes_of.clear()
            yield pd.DataFrame({"kind": kinds, "ratio": means})

    # As it counts as not deterministic, it is asked once for all that reads its result.
    return F.pandas_udf(judged, "kind string, ratio double").asNondeterministic()


def cascade_matches(streams: DataFrame, keywords: DataFrame, fuzzy_ratio: float = 85.0, least_confidence: float = 0.5, phonetic: bool = True) -> DataFrame:
    """Exact, else phonetic, else fuzzy matches, with confidence = mean word score x weight.

    ``fuzzy_ratio`` is on the scale of 0 to 100 and holds for the mean over a keyword's words. Where the
    mean reaches it, so does one word at least; and where all codes are equal, so are one word's. So
    only windows that have such a word at its place are scored whole: distinct tokens meet the keywords'
    words in joins on equal pieces or codes, and the few pairs are looked up in the streams' rows. Windows
    stay in the task that reads their row: no word and no window crosses an exchange."""
    keys = [c for c in streams.columns if c != "ws"]
    wanted = keywords.select("keyword", "n", F.posexplode(F.arrays_zip("tokens", "codes")).alias("k", "t")).select("keyword", "n", "k", F.col("t.tokens").alias("wanted"), F.col("t.codes").alias("wanted_code"))
    ahead = keywords.agg(F.max("n")).first()[0] or 1
    tokens = written(streams.select(F.explode("ws.token").alias("token")).distinct(), "tokens")
    pairs = lookup.alike(tokens, wanted, fuzzy_ratio).select("token", "wanted")
    if phonetic:
        coded = tokens.select("token", T.metaphone_code("token").alias("wanted_code"))
        pairs = pairs.unionByName(coded.join(small(wanted.select("wanted", "wanted_code").distinct()), "wanted_code").select("token", "wanted")).distinct()
    anchors = written(pairs.join(small(wanted.drop("wanted_code")), "wanted").select("token", "keyword", "n", "k").distinct(), "anchors")
    listed = [r["token"] for r in anchors.select("token").distinct().limit(LOOKED_UP + 1).collect()]
    # A word with its neighbours, as far as a keyword that has it at any place may reach.
    ws = F.col("ws")
    if len(listed) <= LOOKED_UP:
        places = F.filter(F.transform(ws, lambda w, i: F.when(w["token"].isin(listed), i)), lambda i: i.isNotNull())
    else:
        places = F.transform(ws, lambda w, i: i)
    from_ = lambda i: F.greatest(i - (ahead - 2), F.lit(1))
    near = F.transform("_places", lambda i: F.struct(i.alias("pos"), F.get(ws, i)["token"].alias("token"), (i + 1 - from_(i)).alias("before"), F.slice(ws, from_(i), 2 * ahead - 1).alias("near")))
    rows = streams.withColumn("_places", places).select(*keys, F.explode(near).alias("x")).select(*keys, "x.*")
    met = rows.join(small(anchors), "token").filter((F.col("before") >= F.col("k")) & (F.col("before") - F.col("k") + F.col("n") <= F.size("near")))
    windows = met.select(*keys, (F.col("pos") - F.col("k")).alias("pos"), "keyword", "k", F.slice("near", F.col("before") - F.col("k") + 1, F.col("n")).alias("w"))
    once = keywords.select("keyword", "tokens", "codes", "n").dropDuplicates(["keyword"])
    judged = windows.join(small(once), "keyword").withColumn("v", _verdict(fuzzy_ratio, phonetic)(F.col("w.token"), "tokens", "codes", "k")).filter("v.kind IS NOT NULL")
    weight = F.when(F.col("v.kind") == "exact", WEIGHTS["exact"]).when(F.col("v.kind") == "phonetic", WEIGHTS["phonetic"]).otherwise(F.col("v.ratio") / 100)
    score = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["score"]) / F.col("n")
    found = judged.select(*keys, "pos", "keyword", F.col("v.kind").alias("match_type"), (score * weight).alias("confidence"), F.element_at("w", 1)["start_ms"].alias("start_ms"), F.element_at("w", -1)["end_ms"].alias("end_ms"), F.array_join(F.col("w.raw"), " ").alias("context"))
    return found.filter(F.col("confidence") >= least_confidence)


def gap_suppressed(detections: DataFrame, by: list[str], gap_ms: int = 1000, order: tuple[str, ...] = ("keyword",)) -> DataFrame:
    """The most confident detection of every run whose starts follow each other within ``gap_ms``,
    inclusive; of equals the first. Without the keyword in ``by``, keywords suppress each other. Runs are
    found inside segments, which larger gaps cut off from each other, and so are the work of many tasks."""
    parts = [*by, "_segment"]
    cut = scans.segments(written(detections, "detections"), by, F.col("start_ms"), max(gap_ms, 1))
    w = W.partitionBy(*parts).orderBy("start_ms", *order)
    apart = (F.col("start_ms") - F.lag("start_ms").over(w) > gap_ms).cast("int")
    runs = cut.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    best = W.partitionBy(*parts, "run").orderBy(F.desc("confidence"), "start_ms", *order)
    return runs.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k", "_segment")


def greedy_suppressed(detections: DataFrame, by: list[str], apart: float = 0.25, most: int = 8) -> DataFrame:
    """by + kept: from the best score down, detections at least ``apart`` from all kept before, at most
    ``most``. Detections of different segments do not suppress each other, so each segment's sorted array is
    folded alone, and a key keeps the first of what its segments keep."""
    cut = scans.segments(written(detections.select(*by, "scale", "time", "score"), "detections"), by, F.col("time"), apart * (1 + 1e-6))
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("scale"), F.col("time"))))
    grouped = cut.groupBy(*by, "_segment").agg(items.alias("items"))
    kind = "array<struct<neg:double,scale:double,time:double>>"
    far = lambda kept, x: ~F.exists(kept, lambda k: F.abs(k["time"] - x["time"]) < apart)
    # Of one segment a key keeps no more than of all.
    kept = F.aggregate("items", F.array().cast(kind), lambda kept, x: F.when((F.size(kept) < most) & far(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    each = grouped.select(*by, F.explode(kept).alias("k"))
    first = each.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy("k"))).filter(F.col("_rank") <= most)
    found = first.groupBy(*by).agg(F.array_sort(F.collect_list("k")).alias("kept"))
    return found.select(*by, F.transform("kept", lambda k: F.struct(k["time"].alias("time"), k["scale"].alias("scale"), (-k["neg"]).alias("score"))).alias("kept"))
