"""Simple-8b word-aligned coding of integers below 2 ** 64, and the file that holds documents so coded.

A word has a selector in its upper four bits and 60 bits of values, the first lowest. Selector 0 is an
escape: its value, of more than 60 bits, is in the block's list of escapes, at the place that the payload
names. Selector 1 stands for 120 zeros, the others for as many values as fit at the selector's width. A
block of ``BLOCK`` values begins a new word, and the last word of a block may have fewer values than its
selector says.

A file is, little-endian: ``MAGIC``; five 64-bit counts, of documents, values, blocks, words and escapes;
one byte a document that says whether it has an id; the ids and the numbers of values of documents, 64
bits each; for each block and the end where its words and its escapes begin; the words; the escapes; the
32-bit CRC of all before. Offsets let a reader decode some blocks alone.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np

MAGIC = b"S8B1"
BLOCK = 1024
ESCAPE, ZEROS = 0, 1
#: Values of a word and bits of a value by selector. Fixed values of the coding.
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_POWERS = np.array([1 << k for k in range(61)], np.uint64)


class Coded(NamedTuple):
    """``words_at`` and ``escapes_at``: where each block begins in ``words`` and ``escapes``, and their ends."""

    n: int
    words: np.ndarray
    words_at: np.ndarray
    escapes: np.ndarray
    escapes_at: np.ndarray


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 61 at most."""
    out = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    large = np.flatnonzero(out > 52)
    out[large] = np.searchsorted(_POWERS, values[large], "right")
    return out


def _most(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of each block (a row) the values that one word can take from there, and its selector.
    Past a block's end there is nothing, which fits any width."""
    blocks, width = bits.shape
    padded = np.zeros((blocks, width + int(COUNTS.max())), np.uint8)
    padded[:, :width] = bits
    taken, selector = np.ones(bits.shape, np.uint8), np.full(bits.shape, ESCAPE, np.uint8)
    widest, reach = padded, 1
    for s in range(15, 0, -1):
        count = int(COUNTS[s])
        while reach < count:
            step = min(reach, count - reach)
            widest = np.maximum(widest[:, : widest.shape[1] - step], widest[:, step:])
            reach += step
        fits = widest[:, :width] <= WIDTHS[s]
        if fits.any():
            taken[fits], selector[fits] = count, s
    return taken, selector


def encode(values: np.ndarray) -> Coded:
    """All blocks advance together, a word at a time; each word takes as many values as it can."""
    values = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    bits = np.zeros((blocks, BLOCK), np.uint8)
    bits.ravel()[:n] = _bits(values)
    most, selector = (x.ravel() for x in _most(bits))
    ends = np.minimum((np.arange(blocks) + 1) * BLOCK, n)
    begins = np.zeros(blocks * BLOCK, bool)
    at = np.arange(blocks) * BLOCK
    last = ends
    while len(at):
        begins[at] = True
        at = at + most[at]
        on = at < last
        if not on.all():
            at, last = at[on], last[on]
    starts = np.flatnonzero(begins)
    of, chosen = starts // BLOCK, selector[starts]
    left = ends[of] - starts
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        mine = np.flatnonzero(chosen == s)
        for k in range(int(COUNTS[s])):
            some = mine[left[mine] > k] if k else mine
            if not len(some):
                break
            words[some] |= values[starts[some] + k] << np.uint64(k * WIDTHS[s])
    escaped = np.flatnonzero(chosen == ESCAPE)
    escapes_at = np.searchsorted(of[escaped], np.arange(blocks + 1))
    words[escaped] |= (np.arange(len(escaped)) - escapes_at[of[escaped]]).astype(np.uint64)
    return Coded(n, words, np.searchsorted(of, np.arange(blocks + 1)), values[starts[escaped]], escapes_at)


def decode(coded: Coded, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks ``first`` to before ``last``, all words of a selector at once."""
    last = len(coded.words_at) - 1 if last is None else last
    a, b = int(coded.words_at[first]), int(coded.words_at[last])
    words = coded.words[a:b]
    selector = (words >> np.uint64(60)).astype(np.int64)
    block = np.searchsorted(coded.words_at[: last + 1], np.arange(a, b), "right") - 1
    ends = np.minimum((block + 1) * BLOCK, coded.n)
    taken = COUNTS[selector]
    begins = np.cumsum(taken) - taken
    head = np.flatnonzero(np.diff(block, prepend=-1))
    begins += np.repeat(block[head] * BLOCK - begins[head], np.diff(np.append(head, len(block))))
    base = first * BLOCK
    out = np.zeros(max(min(last * BLOCK, coded.n) - base, 0), np.uint64)
    for s in range(2, 16):
        mine = np.flatnonzero(selector == s)
        for k in range(int(COUNTS[s])):
            some = mine[begins[mine] + k < ends[mine]] if k else mine
            if not len(some):
                break
            out[begins[some] + k - base] = words[some] >> np.uint64(k * WIDTHS[s]) & np.uint64((1 << int(WIDTHS[s])) - 1)
    escaped = np.flatnonzero(selector == ESCAPE)
    place = (words[escaped] & np.uint64((1 << 60) - 1)).astype(np.int64) + coded.escapes_at[block[escaped]]
    out[begins[escaped] - base] = coded.escapes[place]
    return out


class Documents(NamedTuple):
    ids: list[int | None]
    sizes: np.ndarray
    coded: Coded

    def values(self, place: int) -> np.ndarray:
        """One document's values, from its blocks alone."""
        end = int(self.sizes[: place + 1].sum())
        begin = end - int(self.sizes[place])
        first = begin // BLOCK
        some = decode(self.coded, first, max(-(-end // BLOCK), first))
        return some[begin - first * BLOCK : end - first * BLOCK]


def to_bytes(ids: list[int | None], sizes: np.ndarray, values: np.ndarray) -> bytes:
    coded = encode(values)
    head = np.array([len(ids), coded.n, len(coded.words_at) - 1, len(coded.words), len(coded.escapes)], "<u8")
    there = np.array([i is not None for i in ids], np.uint8)
    known = np.array([i or 0 for i in ids], "<i8")
    parts = [MAGIC, head, there, known, np.asarray(sizes, "<u8"), coded.words_at.astype("<u8"), coded.escapes_at.astype("<u8"), coded.words.astype("<u8"), coded.escapes.astype("<u8")]
    body = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


def from_bytes(raw: bytes) -> Documents:
    if raw[:4] != MAGIC or zlib.crc32(memoryview(raw)[:-4]) != int(np.frombuffer(raw, "<u4", 1, len(raw) - 4)[0]):
        raise ValueError("not a whole file of this format")
    at = 4

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    docs, n, blocks, words, escapes = take("<u8", 5).tolist()
    there, known = take("u1", docs), take("<i8", docs)
    sizes = take("<u8", docs).astype(np.int64)
    words_at, escapes_at = (take("<u8", blocks + 1).astype(np.int64) for _ in range(2))
    coded = Coded(n, take("<u8", words), words_at, take("<u8", escapes), escapes_at)
    return Documents([k if t else None for k, t in zip(known.tolist(), there.tolist(), strict=True)], sizes, coded)
