"""Words of many texts as arrays: what the counting operators do inside tasks.

Texts become bytes, every byte is of one kind (word, blank, break), and words are runs of word bytes.
Bytes of a character beyond ASCII are alike in kind, so no character is cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

WORD, BLANK, BREAK = 0, 1, 2


def kinds(blank: bytes, breaks: bytes) -> np.ndarray:
    """Kinds of the 256 bytes; those not named are word bytes."""
    table = np.full(256, WORD, np.uint8)
    table[list(blank)] = BLANK
    table[list(breaks)] = BREAK
    return table


class Words(NamedTuple):
    """``names``: the different words; ``ids``: each word's place among them; ``first``: whether a piece
    (of a text, between breaks) begins with it; ``text``: which text it is of."""

    names: list[bytes]
    ids: np.ndarray
    first: np.ndarray
    text: np.ndarray


def words_of(texts: list[str], table: np.ndarray) -> Words:
    """The words of the texts, A-Z in lower case."""
    raw = [t.encode().lower() for t in texts]
    begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    kind = table[data]
    word = kind == WORD
    edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    starts, lengths = edge[0::2], edge[1::2] - edge[0::2]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    coded = found.dictionary_encode()
    text = np.searchsorted(begins, starts, "right") - 1
    piece = np.cumsum(kind == BREAK, dtype=np.int64)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    return Words(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), first, text)


def hashes(names: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n) for n in names], np.uint64)


def lots(batches: Iterable[pa.RecordBatch], most_bytes: int) -> Iterator[list[tuple]]:
    """Rows of the batches, so many together that their strings have about ``most_bytes``; a longer row
    stands alone."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            wide = sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if rows and size + wide > most_bytes:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += wide
    if rows:
        yield rows
