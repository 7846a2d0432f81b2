"""A modified Kneser-Ney model over pairs of words of all documents, as sorted hash arrays in Spark.

Words are runs of word characters in lower case. A pair is known by 32 bits of its first word's hash,
its context, and 24 bits of the second's; a pair counts the documents that have it. Tasks put runs
of about ``RUN`` words into sorted arrays for each shard of contexts: a context once, with its pairs
in order, each with its documents. So a shard's task gets few and dense rows, and a hot pair is one
entry a run. All pairs of all documents are counted, so what is gathered grows with the input, and
nothing of it reaches the driver. Below pairs, a word counts the different words before it, in one of
``CELLS`` cells by its hash: an array of fixed size, which is all that is broadcast.

Two passes over the texts: the first adds up the arrays for discounts and cells, the second holds each
text's pairs against its shard's counts less the text itself, as a text would else vouch for itself,
and returns sums by text. Texts of all languages are in one model, so a text may change languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.shared import lean, stored

WORD = re.compile(r"\w+")
#: Words and texts of a run at most, and bytes of text for each shard.
RUN, MOST_TEXTS = 800_000, 4096
SHARD_BYTES, LEAST_SHARDS = 24 << 20, 8
#: Ranges of contexts that a shard's task takes one after the other.
LOTS = 16
#: Rows that a worker gets at once: one may have a few hundred thousand bytes.
GROUPED = 32
#: Second words are known by this many bits, of which the upper ones are the cell.
BITS, CELL_BITS = 24, 20
CELLS = 1 << CELL_BITS
#: Cells of one row of the sums, and groups of shards that are summed first.
RANGE, GROUPS = 1 << 12, 64
ROW = "shard int, run long, h binary, hn binary, w binary, dn binary, d binary, keys binary"
EMPTY = {c: b"" for c in ("h", "hn", "w", "dn", "d", "keys")}


def text_of(docs: DataFrame) -> DataFrame:
    """(key, text); the key stands for id, language and text."""
    return docs.select(key_of("doc_id", F.coalesce("lang", F.lit("")), F.xxhash64("text")).alias("key"), "text")


def key_of(doc_id, lang, text_key) -> Column:
    return F.xxhash64(doc_id, lang, text_key)


def shards_of(texts: DataFrame) -> int:
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_SHARDS, -(-int(total) // SHARD_BYTES))


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def _hashed(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pair, text) of the different pairs of each text, by pair and then by text, from the hashes of words."""
    hashes = np.concatenate(words)
    text = np.repeat(np.arange(len(words), dtype=np.uint16), [len(ws) for ws in words])
    same = text[1:] == text[:-1]
    pair = (hashes[:-1][same] & np.uint64(0xFFFFFFFF)) << np.uint64(BITS) | hashes[1:][same] >> np.uint64(64 - BITS)
    text = text[1:][same]
    order = np.lexsort((text, pair))
    pair, text = pair[order], text[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
    return pair[new], text[new]


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _small(x: np.ndarray, width: int) -> bytes:
    """Numbers below 256 ** width in so many bytes each."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _wide(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u4").ravel()


def _texts_packed(x: np.ndarray) -> bytes:
    """Places among a run's texts, twelve bits each."""
    x = np.append(x, np.zeros(len(x) % 2, x.dtype)).astype(np.uint32)
    return _small(x[0::2] | x[1::2] << 12, 3)


def _texts_of(raw: bytes, n: int) -> np.ndarray:
    two = _wide(raw, 3)
    return np.stack([two & 0xFFF, two >> 12], axis=1).ravel()[:n].astype(np.int64)


def shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _rows(keys: list[int], words: list[np.ndarray], run: int, shards: int, texts: bool) -> list[dict]:
    """A run's rows, one a shard: contexts, how many pairs each has, second words, how many texts each
    pair has and, where ``texts``, which; then one row of the texts' keys."""
    pair, text = _hashed(words)
    of = shard_of(pair >> np.uint64(BITS), shards)
    order = np.argsort(of, kind="stable")
    pair, text, bounds = pair[order], text[order], np.searchsorted(of[order], np.arange(shards + 1))
    out = []
    for shard in range(shards):
        p, t = pair[bounds[shard] : bounds[shard + 1]], text[bounds[shard] : bounds[shard + 1]]
        if not len(p):
            continue
        at = _starts(p)
        single = p[at]
        context = single >> np.uint64(BITS)
        first = _starts(context)
        second = _small(single & np.uint64((1 << BITS) - 1), BITS // 8)
        row = {"h": context[first].astype("<u4").tobytes(), "hn": _sizes(first, len(context)).astype("<u4").tobytes(), "w": second, "dn": _sizes(at, len(p)).astype("<u2").tobytes()}
        out.append(EMPTY | row | {"shard": shard, "run": run} | ({"d": _texts_packed(t)} if texts else {}))
    if texts:
        out.append(EMPTY | {"shard": -1, "run": run, "keys": np.array(keys, np.int64).tobytes()})
    return out


def packed(texts: DataFrame, shards: int, with_texts: bool) -> DataFrame:
    """The rows of all runs."""
    names = [c.split()[0] for c in ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        keys, words, n = [], [], 0

        def flush() -> pa.RecordBatch:
            rows = _rows(keys, words, task << 32 | number, shards, with_texts)
            return pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in rows], schema=pa.schema([("shard", pa.int32()), ("run", pa.int64()), *[(c, pa.binary()) for c in names[2:]]]))

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = WORD.findall((text or "").lower())
                if len(found) < 2:
                    continue
                keys.append(key)
                words.append(word_hashes(found))
                n += len(found)
                if n > RUN or len(keys) >= MOST_TEXTS:
                    yield flush()
                    number += 1
                    keys, words, n = [], [], 0
        if words:
            yield flush()

    return texts.select("key", "text").mapInArrow(lean(run), ROW)


def _buffers(table: pa.Table) -> list[dict]:
    """The binary columns' values by row, where they lie, without a copy."""
    columns: dict[str, list[pa.Buffer]] = {c: [] for c in EMPTY}
    for batch in table.to_batches():
        for c, values in columns.items():
            _, offsets, data = batch.column(c).buffers()
            ends = np.frombuffer(offsets, "<i4")[batch.column(c).offset :][: len(batch) + 1].tolist()
            data = pa.py_buffer(b"") if data is None else data
            values += [data.slice(a, b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)]


def _counted(rows: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, slice, np.ndarray]]]]:
    """A shard's pairs and their counts, a range of contexts at a time, and for each row that has some of
    them its number, which of its pairs these are, and their places. Pairs are unfolded for one range."""
    edges = np.array([(i << 32) // LOTS for i in range(LOTS)], np.uint32)
    parts = []
    for row in rows:
        h, hn = np.frombuffer(row["h"], "<u4"), np.frombuffer(row["hn"], "<u4")
        contexts = np.append(np.searchsorted(h, edges), len(h))
        parts.append((h, hn, contexts, np.append(0, np.cumsum(hn, dtype=np.int64))[contexts]))
    for lot in range(LOTS):
        some, pairs, times = [], [], []
        for i, (row, (h, hn, contexts, bounds)) in enumerate(zip(rows, parts, strict=True)):
            at, own = slice(contexts[lot], contexts[lot + 1]), slice(int(bounds[lot]), int(bounds[lot + 1]))
            if own.start < own.stop:
                width = BITS // 8
                some.append((i, own))
                pairs.append(np.repeat(h[at], hn[at]).astype(np.uint64) << np.uint64(BITS) | _wide(row["w"][own.start * width : own.stop * width], width))
                times.append(np.frombuffer(row["dn"], "<u2")[own])
        if some:
            pairs, place = np.unique(np.concatenate(pairs), return_inverse=True)
            counts = np.bincount(place, np.concatenate(times), len(pairs)).astype(np.int64)
            at = np.split(place, np.cumsum([s.stop - s.start for _, s in some])[:-1])
            yield pairs, counts, [(i, s, x) for (i, s), x in zip(some, at, strict=True)]


def discounts(n: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and from 3 on, by modified Kneser-Ney, from how many pairs are found once to four times."""
    y = n[0] / max(n[0] + 2 * n[1], 1)
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return np.array([0.0, *[max(min(x, k - 0.01), 0.01) for k, x in zip((1, 2, 3), d, strict=True)]])


def fit(texts: DataFrame, shards: int) -> dict[str, np.ndarray]:
    """{'discounts', 'cells'}: the discounts, and each cell's share of the different words before."""

    def count(table: pa.Table) -> pa.Table:
        cells, times = np.zeros(CELLS, np.int64), np.zeros(RANGE, np.int64)
        for pairs, counts, _ in _counted(_buffers(table)):
            cells += np.bincount((pairs & np.uint64((1 << BITS) - 1)).astype(np.int64) >> (BITS - CELL_BITS), minlength=CELLS)
            times[:6] += np.bincount(np.minimum(counts, 5), minlength=6)
        sums = [(-1, times), *[(i, cells[i * RANGE : (i + 1) * RANGE]) for i in range(CELLS // RANGE)]]
        group = table["shard"][0].as_py() % GROUPS
        return pa.table({"part": pa.array([i for i, _ in sums], pa.int32()), "group": pa.array([group] * len(sums), pa.int32()), "sums": pa.array([s.astype("<i8").tobytes() for _, s in sums], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s, "<i8") for s in table["sums"].to_pylist()], axis=0)
        return pa.table({"part": table["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    sums = stored(packed(texts, shards, False).groupBy("shard").applyInArrow(lean(count), "part int, group int, sums binary"), "wordSums", batch=GROUPED)
    sums = sums.groupBy("part", "group").applyInArrow(add, "part int, sums binary")
    found = {r["part"]: np.frombuffer(r["sums"], "<i8") for r in stored(sums.groupBy("part").applyInArrow(add, "part int, sums binary"), "wordCells").collect()}
    cells = np.concatenate([found.get(i, np.zeros(RANGE, np.int64)) for i in range(CELLS // RANGE)])
    times = found.get(-1, np.zeros(RANGE, np.int64))
    return {"discounts": discounts(times[1:5]), "cells": ((cells + 0.5) / (cells.sum() + 0.5 * CELLS)).astype(np.float32)}


def nats_of(pairs: np.ndarray, counts: np.ndarray, d: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Nats of each pair for a text that has it, without that text's own count."""
    first = _starts(pairs >> np.uint64(BITS))
    size = _sizes(first, len(pairs))
    total = np.repeat(np.add.reduceat(counts, first), size)
    off = np.repeat(np.add.reduceat(d[np.minimum(counts, 3)], first), size)
    low = cells[(pairs & np.uint64((1 << BITS) - 1)).astype(np.int64) >> (BITS - CELL_BITS)].astype(np.float64)
    others = counts - 1
    share = np.maximum(others - d[np.minimum(others, 3)], 0) / np.maximum(total - 1, 1)
    return -np.log(np.where(total > 1, np.minimum(share + np.minimum(off / total, 1) * low, 1), low))


def score(texts: DataFrame) -> DataFrame:
    """(key, word_nats): nats a pair, of the different pairs of each text that has one; stored."""
    shards = shards_of(texts)
    model = texts.sparkSession.sparkContext.broadcast(fit(texts, shards))

    def meet(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            none = pa.array([b""] * len(table), pa.binary())
            return pa.table({"run": table["run"], "keys": table["keys"], "d": none, "n": none, "x": none})
        rows = _buffers(table)
        of_pair = [np.zeros(len(r["dn"]) // 2, np.float32) for r in rows]
        for pairs, counts, found in _counted(rows):
            nats = nats_of(pairs, counts, model.value["discounts"], model.value["cells"]).astype(np.float32)
            for i, s, place in found:
                of_pair[i][s] = nats[place]
        ds, ns, xs = [], [], []
        for row, nats in zip(rows, of_pair, strict=True):
            times = np.frombuffer(row["dn"], "<u2")
            d = _texts_of(row["d"], int(times.sum()))
            n = np.bincount(d)
            some = np.flatnonzero(n)
            ds.append(some.astype("<u2").tobytes())
            ns.append(n[some].astype("<u4").tobytes())
            xs.append(np.bincount(d, np.repeat(nats, times))[some].astype("<f4").tobytes())
        return pa.table({"run": table["run"], "keys": pa.array([b""] * len(rows), pa.binary()), "d": pa.array(ds, pa.binary()), "n": pa.array(ns, pa.binary()), "x": pa.array(xs, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = np.frombuffer(next(r["keys"] for r in rows if r["keys"]), np.int64)
        n, x = np.zeros(len(keys), np.int64), np.zeros(len(keys))
        for r in rows:
            at = np.frombuffer(r["d"], "<u2")
            n[at] += np.frombuffer(r["n"], "<u4")
            x[at] += np.frombuffer(r["x"], "<f4")
        return pa.table({"key": pa.array(keys), "n": pa.array(n), "x": pa.array(x)})

    met = packed(texts, shards, True).withColumn("lot", F.when(F.col("shard") < 0, F.pmod(F.col("run"), F.lit(64)).cast("int")).otherwise(0))
    sums = stored(met.groupBy("shard", "lot").applyInArrow(lean(meet), "run long, keys binary, d binary, n binary, x binary"), "wordNats", batch=GROUPED)
    scored = sums.groupBy("run").applyInArrow(add, "key long, n long, x double")
    return stored(scored.groupBy("key").agg((F.sum("x") / F.sum("n")).alias("word_nats")), "wordScores")
