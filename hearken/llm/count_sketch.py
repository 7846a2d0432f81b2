"""A count-min sketch that many tasks fill and all may ask: never an underestimate.

A key is a 64-bit hash; each of ``ROWS`` rows of the sketch counts it in one of ``2 ** bits`` cells. A
task puts out the cells that it has filled, in blocks of ``BLOCK`` cells, sorted, by gaps and counts; the
tasks that add them up hold one array a block, and read their parts as a stream. Only whether a count
reaches ``least`` is asked later, so counts stop at 255 and the merged sketch is one bit a cell: a fixed
size, ``ROWS * 2 ** bits / 8`` bytes, which is what the driver gets and broadcasts. Where the keys are
too many for the cells more of them pass; what passes must be counted exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from hearken.llm.shared import stored

ROWS, BLOCK_BITS, MOST_COUNT = 2, 18, 255
BLOCK = 1 << BLOCK_BITS
#: The largest sketch: 2 * 64 MiB.
MOST_BITS = 29
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PART = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(_ODD[row])
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _packed(gaps: np.ndarray, counts: np.ndarray) -> bytes:
    planes = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + counts.astype(np.uint8).tobytes())


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1).astype(np.int64)
    return np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16), planes[3]


def _parts(keys: np.ndarray, counts: np.ndarray | None, bits: int) -> pa.RecordBatch:
    blocks, cells = [], []
    for row in range(ROWS):
        at = cells_of(keys, row, bits)
        if counts is None:
            at = np.sort(at)
            new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total = np.diff(np.append(new, len(at)))
            at = at[new]
        else:
            at, place = np.unique(at, return_inverse=True)
            total = np.bincount(place, counts, len(at))
        total = np.minimum(total, MOST_COUNT)
        bounds = np.flatnonzero(np.diff(at >> BLOCK_BITS, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            inside = at[a:b] & (BLOCK - 1)
            blocks.append(row << (bits - BLOCK_BITS) | int(at[a]) >> BLOCK_BITS)
            cells.append(_packed(np.diff(inside, prepend=0), total[a:b]))
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], schema=_PART)


class Sketch:
    """The merged sketch; ``reaches`` says for keys whether their count may be ``least`` or more."""

    def __init__(self, bits: int, reached: np.ndarray) -> None:
        self.bits, self.reached = bits, reached

    def reaches(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for row in range(ROWS):
            cell = cells_of(keys, row, self.bits) + (row << self.bits)
            out &= (self.reached[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def merged(df: DataFrame, keys_of: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray | None]]], least: int, bits: int) -> Sketch:
    """The sketch of all keys that ``keys_of`` finds in batches of ``df``, with counts or once each."""
    if not BLOCK_BITS <= bits <= MOST_BITS or not 0 < least <= MOST_COUNT:
        raise ValueError(f"bits from {BLOCK_BITS} to {MOST_BITS}, least from 1 to {MOST_COUNT}")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in keys_of(batches):
            if len(keys):
                yield _parts(keys, counts, bits)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                at, counts = _unpacked(raw)
                total = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                total[at] = np.minimum(total[at] + counts, MOST_COUNT)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], schema=_PART)

    filled = df.mapInArrow(fill, "block int, cells binary").repartition("block")
    reached = np.zeros(ROWS << (bits - 3), np.uint8)
    for r in stored(filled.mapInArrow(add, "block int, cells binary"), "sketch").collect():
        at = r["block"] << (BLOCK_BITS - 3)
        reached[at : at + (BLOCK >> 3)] = np.frombuffer(r["cells"], np.uint8)
    return Sketch(bits, reached)
