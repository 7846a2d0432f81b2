"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share, and their groups.

Exact, with work that follows the candidates and not all pairs:

1. Every text becomes a sorted array of shingle hashes; equal sets are one class, and only classes
   go on. A class has a hashed bitmap of one bit or more a shingle, by size.
2. Prefixes. Two sets that overlap enough share a shingle among the first n - ceil(t n) + 1 of each,
   in any order common to all. The order puts shingles of many documents last (counted over all
   documents), then goes by hash, so that passages that many texts share seldom make candidates.
3. Tiles. Classes that share a prefix shingle are banded by size; sets that link lie in the same or
   in adjacent bands. First each tile's members are held against one class of each band, in rounds
   with another class each; what links is merged to components, and only members of different
   components meet from then on. A small tile's members meet by a join. In a large one those outside
   the tile's main component are held against all members, which are dealt to blocks.
4. A pair's bit counts bound its overlap from above, first those of a quarter of all hashes, which are
   short and turn most pairs away, then those of all; what passes is intersected exactly. A block of a
   large tile returns links that merge components, fewer than its members, and not its pairs.

Null or empty texts have no shingles, n_shingles 0, and link with nothing; their component is their
own id. Null ids take part, but a component's id is the smallest id that is not null. Repeated rows
are one class. Each input row gives one result row. Hashes have 64 bits. An empty table gives an
empty result; columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.shared import fresh, lean, removed, small, stored

WORDS = 5
PERCENT = 80
#: Documents from which on a shingle goes to the end of the order, and most such shingles broadcast.
OFTEN = 40
MOST_OFTEN = 2_000_000
#: Members from which on a tile is compared in blocks, and members of a block.
LARGE = 64
BLOCK = 1024
#: Candidates a row of a block up to which they are put out as pairs.
MOST_PAIRS = 4
#: Rounds of one class a band against the others, before blocks.
ROUNDS = 2
#: Words whose hashes a worker keeps.
MOST_WORDS = 50_000
MOST_BROADCAST = 1_000_000
#: Rows with sets or bitmaps that a worker gets at once: a set may have many thousand shingles.
WIDE = 200
#: Bits of a shingle's hash by which shingles are counted; shingles that a worker packs at once, and rows of
#: documents at most that these span; shingles of a shard.
KEY_BITS = 40
IN_LOT = 1 << 19
MOST_IN_LOT = 1 << 22
IN_SHARD = 1 << 20
_CUT = np.uint64(64 - KEY_BITS)
#: Parts of all hashes of which the first bitmap has one.
QUARTER = 4

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """Hashes of words met lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Shingler:
    """Texts to sorted distinct shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode().lower().split()
        if not tokens:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.known.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(tokens))
        mixed = np.full(len(tokens) - k + 1, len(tokens) if len(tokens) < self.words else 0, np.uint64)
        for i in range(k):
            mixed += hashes[i : len(hashes) - k + 1 + i] * _FACTORS[i % 5] + np.uint64(i // 5)
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed.sort()
        return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The smallest intersection of sets of sizes a and b that links: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Of a set of n: its prefix against smaller sets, and against sets of its size or larger."""
    return n + (-percent * n // 100) + 1, n - least_overlap(n, n, percent) + 1


def bitmap(shingles: np.ndarray, part: int = 1) -> bytes:
    """One bit for each hash, at the hash modulo a power of two of twice the size at least; or for those of
    the lowest ``part``-th of all hashes, in a width that follows the whole size as well."""
    width = max(64, (1 << (2 * len(shingles) - 1).bit_length()) // part)
    bits = np.zeros(width, bool)
    some = shingles if part == 1 else shingles[: np.searchsorted(shingles, np.uint64((1 << 64) // part))]
    bits[(some & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_link(a: bytes, na: int, b: bytes, nb: int, percent: int = PERCENT) -> bool:
    """Whether the bit counts leave room: bits of one set alone are shingles outside the other."""
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = _fold(x, width).view(np.uint64), _fold(y, width).view(np.uint64)
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return most >= least_overlap(na, nb, percent)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, row, n, cls, shingles, bits, few), one row a document row, stored: texts are read and
    cut to shingles this once. cls is null for empty sets; shingles are eight bytes each, ascending; few is
    the bitmap of the lowest quarter of all hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            sets = [shingle(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", "text_key", "row")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([bitmap(s, QUARTER) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_key", "row", "n", "cls", "shingles", "bits", "few"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"))
    return stored(read.mapInArrow(lean(run), f"doc_id {kind}, text_key long, row long, n long, cls long, shingles binary, bits binary, few binary"), "described", batch=WIDE)


def _planes(values: np.ndarray, wide: int) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())


def _values(raw: bytes, wide: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(wide, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :wide] = planes.T
    return out.view("<u8").reshape(-1)


def _packed(keys: np.ndarray, beside: np.ndarray, base: int, shards: int, known: bool) -> pa.RecordBatch:
    """Ascending keys, by gaps, and a number beside each, in a row for each shard that has some; shards are
    ranges of keys. Known ones all go to one further shard, any."""
    of = (keys >> np.uint64(KEY_BITS - shards.bit_length() + 1)).astype(np.int64)
    bounds = np.array([0, len(keys)]) if known else np.flatnonzero(np.diff(of, prepend=-1, append=-1))
    spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([shards + (hash((base, int(keys[0]))) % shards) if known else int(of[i]) for i, _ in spans], pa.int32()),
            pa.array([base] * len(spans), pa.int64()),
            pa.array([_planes(np.diff(keys[i:j], prepend=np.uint64(0)), 5) for i, j in spans], pa.binary()),
            pa.array([_planes(beside[i:j], 3) for i, j in spans], pa.binary()),
        ],
        names=["shard", "base", "keys", "beside"],
    )


_PACKED = "shard int, base long, keys binary, beside binary"


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all rows of a shard, what is beside them, and their row's base; keys ascend."""
    keys = [np.cumsum(_values(x.as_buffer(), 5), dtype=np.uint64) for x in rows["keys"]]
    beside = np.concatenate([_values(x.as_buffer(), 3).astype(np.int32) for x in rows["beside"]])
    base = np.repeat(rows["base"].to_numpy(), [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return keys[order], beside[order], base[order]


def _each(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_unpacked`` gives, of one packed row after the other: a shard is never unpacked whole."""
    for i in range(len(rows)):
        yield _unpacked(rows.slice(i, 1))


def _sorted_keys(rows: pa.Table, bits: int = 0) -> np.ndarray:
    """All keys of a shard, ascending, in one array sorted in place; with ``bits``, times that power of two and
    with the number beside a key in its low bits."""
    parts = [(keys << np.uint64(bits)) | (beside.astype(np.uint64) if bits else np.uint64(0)) for keys, beside, _ in _each(rows)]
    out = np.empty(sum(map(len, parts)), np.uint64)
    at = len(out)
    while parts:
        last = parts.pop()
        out[at - len(last) : at] = last
        at -= len(last)
    out.sort()
    return out


def _shards(shingles: int) -> int:
    """A power of two of shards, of about ``IN_SHARD`` shingles each."""
    return 1 << min(20, max(0, shingles // IN_SHARD).bit_length())


def _often(firsts: DataFrame, percent: int, often: int, most: int, shards: int) -> np.ndarray:
    """Sorted keys of the shingles of more than ``often`` classes, among those near the prefixes. If
    they number more than ``most``, those of the most classes: any choice gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return _packed(found, counts, 0, shards, False)

        for batch in batches:
            for raw in batch.column("shingles"):
                found = np.frombuffer(raw.as_buffer(), np.uint64)
                waiting.append(found[: int(1.3 * prefix_lengths(len(found), percent)[0]) + 4] >> _CUT)
            if sum(map(len, waiting)) > IN_LOT:
                yield flush()
        if waiting:
            yield flush()

    def add(rows: pa.Table) -> pa.Table:
        both = _sorted_keys(rows, 64 - KEY_BITS)
        counts = (both & np.uint64((1 << 64 - KEY_BITS) - 1)).astype(np.int32)
        both >>= np.uint64(64 - KEY_BITS)
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        total = np.add.reduceat(counts, first, dtype=np.int64)
        return pa.table({"shingle": _signed(both[first[total > often]]), "c": pa.array(total[total > often])})

    found = stored(firsts.select("shingles").mapInArrow(lean(run), _PACKED).groupBy("shard").applyInArrow(lean(add), "shingle long, c long"), "often", batch=WIDE)
    if found.count() > most:
        least = found.agg(F.percentile_approx("c", 1 - most / found.count(), 10000)).first()[0]
        found = found.filter(F.col("c") > least)
    return np.sort(found.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def _postings(firsts: DataFrame, classes: DataFrame, often: np.ndarray, percent: int, shards: int) -> DataFrame:
    """(shingle, cls, size), stored: prefix shingles that two classes or more have. size is 2 n + 1 where the
    shingle also lies in the shorter prefix, which is enough against sets of the same size or larger, else 2 n.

    Most shingles are of one class. So all go by the first bits of their hashes, packed, to shards, which put out
    those that recur; two shingles of one key are one, which makes more candidates and no other links."""
    shared = firsts.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        base = size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, who = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], who[order]
            # Of two shingles of a class with one key the earlier in its prefix stays.
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (who[1:] >> 1 != who[:-1] >> 1)])
            keys, who = keys[new], who[new]
            # A key of several classes here recurs for certain: two go to its shard, for others, the rest anywhere.
            known = np.zeros(len(keys), bool)
            known[2:] = (keys[2:] == keys[:-2])
            yield _packed(keys[~known], who[~known], base, shards, False)
            if known.any():
                yield _packed(keys[known], who[known], base, shards, True)

        for batch in batches:
            for row, raw in zip(batch.column("row").to_pylist(), batch.column("shingles"), strict=True):
                if waiting and (size > IN_LOT or not 0 <= row - base < MOST_IN_LOT):
                    yield from flush()
                if not waiting:
                    base, size = row, 0
                found = np.frombuffer(raw.as_buffer(), np.uint64) >> _CUT
                longer, shorter = prefix_lengths(len(found), percent)
                if len(last):
                    at = np.minimum(np.searchsorted(last, found), len(last) - 1)
                    late = last[at] == found
                    found = np.concatenate([found[~late], found[late]])
                waiting.append((found[:longer], 2 * (row - base) + (np.arange(longer) < shorter)))
                size += longer
        if waiting:
            yield from flush()

    def again(rows: pa.Table) -> pa.Table:
        several = None
        if rows["shard"][0].as_py() < shards:
            keys = _sorted_keys(rows)
            several = np.unique(keys[1:][keys[1:] == keys[:-1]])
            del keys
        out = []
        for keys, who, base in _each(rows):
            if several is not None:
                kept = several[np.minimum(np.searchsorted(several, keys), len(several) - 1)] == keys if len(several) else np.zeros(len(keys), bool)
                keys, who, base = keys[kept], who[kept], base[kept]
            out.append(pa.table({"shingle": _signed(keys), "row": pa.array(base + (who >> 1)), "short": pa.array(who & 1)}))
        return pa.concat_tables(out)

    recurring = firsts.select("row", "shingles").mapInArrow(lean(run), _PACKED).groupBy("shard").applyInArrow(lean(again), "shingle long, row long, short int")
    named = small(classes.select(F.col("first").alias("row"), "cls", "n"), MOST_BROADCAST)
    return stored(recurring.join(named, "row").select("shingle", "cls", (2 * F.col("n") + F.col("short")).alias("size")), "postings", batch=WIDE)


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """(shingle, cls, n, short, band, c): postings of shingles that two classes or more share, one
    shingle for each different list of members. c counts the members."""
    # Sums that combine before the exchange, so that no task reads the whole list of a hot shingle. A class has
    # a shingle once, so the count is that of classes; most shingles are of one class, and their rows are short.
    several = postings.groupBy("shingle").agg(F.bit_xor(F.xxhash64("cls", "size")).alias("members"), F.count("*").alias("c")).filter("c > 1")
    # Near copies share most of their prefix; their lists are the same for many shingles.
    chosen = stored(several.groupBy("c", "members").agg(F.min("shingle").alias("shingle")).select("shingle", "c"), "chosen", batch=WIDE)
    n = F.shiftright("size", 1)
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    return stored(postings.join(small(chosen, MOST_BROADCAST), "shingle").select("shingle", "cls", n.alias("n"), (F.col("size") % 2 == 1).alias("short"), band.alias("band"), "c").distinct(), "lists", batch=WIDE)


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fits(percent: int):
    return 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")


def _needed(firsts: DataFrame, rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(cls, columns) of the classes that ``rows`` names, stored: picked out while ``firsts`` is read, so
    that no exchange carries the sets or bitmaps of all classes."""
    named = rows.select(by[0]) if len(by) == 1 else rows.select(F.explode(F.array(*by)))
    wanted = stored(named.toDF("cls").distinct(), "wanted")
    return stored(firsts.join(small(wanted, MOST_BROADCAST), "cls").select("cls", *columns), "needed")


def _left(pairs: DataFrame, firsts: DataFrame, bits: str, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that may link by the bitmaps in the column ``bits``, stored."""

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("x", "n", "y", "n2")]
            yield batch.select(["a", "b"]).filter(pa.array([may_link(*row, percent) for row in zip(*columns, strict=True)], pa.bool_()))

    maps = _needed(firsts, pairs, ["a", "b"], ["n", bits])
    joined = pairs.join(maps.select(F.col("cls").alias("a"), "n", F.col(bits).alias("x")), "a").join(maps.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col(bits).alias("y")), "b")
    left = stored(joined.select("a", "b", "n", "x", "n2", "y").mapInArrow(by_bits, "a long, b long"), "left", batch=WIDE)
    removed(pairs.sparkSession, [maps._stored_at])
    return left


def _linked(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: by bit counts, then by exact intersection."""

    return _intersecting(_left(_left(pairs, firsts, "few", percent), firsts, "bits", percent), firsts, percent)


def _intersecting(left: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) in ``left`` that link, by exact intersection, stored."""
    sets = _needed(firsts, left, ["a", "b"], ["shingles"])

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [overlap(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            kept = [i >= least_overlap(a, b, percent) for a, b, i in met]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = left.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    linked = stored(both.select("a", "b", "x", "y").mapInArrow(exactly, "a long, b long"), "linked", batch=100)
    removed(left.sparkSession, [sets._stored_at])
    return linked


def overlap(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Sizes of two sets and of their intersection."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return len(x), len(y), int((both[1:] == both[:-1]).sum())


def candidates(cls: np.ndarray, n: np.ndarray, short: np.ndarray, comp: np.ndarray, outside: np.ndarray, asks: np.ndarray, bits: list, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each row of a block that asks, the rows that do not ask, are of another component and may link with it
    by the bit counts, and their most possible overlaps. A pair of two classes outside the main component is
    looked at from the smaller class alone. ``comp`` may change between rows."""
    there = np.flatnonzero(~asks)
    maps = [np.frombuffer(bits[i], np.uint8) for i in there]
    widths = np.array([len(m) for m in maps], np.int64)
    folded: dict[int, np.ndarray] = {}
    for x in np.flatnonzero(asks):
        of, nx = n[there], n[x]
        near = (comp[there] != comp[x]) & (100 * np.minimum(of, nx) >= percent * np.maximum(of, nx)) & np.where(of >= nx, short[x], short[there]) & (~outside[there] | (cls[there] > cls[x]))
        at = np.flatnonzero(near)
        if not len(at):
            continue
        # Sizes this near have bitmaps of one width or of two, of which the narrower is common.
        own = np.frombuffer(bits[x], np.uint8)
        common = np.minimum(len(own), widths[at])
        most = np.zeros(len(at), np.int64)
        for width in np.unique(common).tolist():
            some = common == width
            if width not in folded:
                folded[width] = np.stack([_fold(m, width) if len(m) >= width else np.zeros(width, np.uint8) for m in maps]).view(np.uint64)
            a, b = _fold(own, width).view(np.uint64), folded[width][at[some]]
            most[some] = np.minimum(nx - np.bitwise_count(a & ~b).sum(axis=1, dtype=np.int64), of[at[some]] - np.bitwise_count(b & ~a).sum(axis=1, dtype=np.int64))
        passed = most >= -(-percent * (nx + of[at]) // (100 + percent))
        if passed.any():
            yield x, there[at[passed]], most[passed]


def merging_links(cls: np.ndarray, n: np.ndarray, short: np.ndarray, comp: np.ndarray, outside: np.ndarray, asks: np.ndarray, bits: list, sets: list, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links of a block that merge components: rows that ask against rows that do not."""
    label = comp.copy()
    out: list[tuple[int, int]] = []
    for x, found, most in candidates(cls, n, short, label, outside, asks, bits, percent):
        for i in found[np.argsort(-most, kind="stable")]:
            if label[i] == label[x]:
                continue
            a, b, both = overlap(sets[x], sets[i])
            if both >= least_overlap(a, b, percent):
                out.append((min(int(cls[x]), int(cls[i])), max(int(cls[x]), int(cls[i]))))
                label[label == label[i]] = label[x]
    return out


def met(rows: pa.Table, bits: str, most: float, percent: int = PERCENT) -> pa.Table:
    """Of a block, by the bitmaps in the column ``bits``: the candidates, a row each with ``other``, if they
    number at most ``most`` times the rows; else those rows that are in a candidate, without ``other``."""
    columns = [rows[c].to_numpy() for c in _OF_ROW]
    kept = np.zeros(len(rows), bool)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for x, found, _ in candidates(*columns, [b.as_buffer() for b in rows[bits]], percent):
        kept[x] = kept[found] = True
        size += len(found)
        if size <= most * len(rows):
            pairs.append((np.full(len(found), x), found))
    rows = rows.drop_columns([bits])
    if size > most * len(rows):
        return rows.filter(pa.array(kept)).append_column("other", pa.nulls(int(kept.sum()), pa.int64()))
    one, other = (np.concatenate(c) if pairs else np.zeros(0, np.int64) for c in (zip(*pairs, strict=True) if pairs else ((), ())))
    return rows.take(pa.array(one)).append_column("other", rows["cls"].take(pa.array(other)))


_OF_ROW = ("cls", "n", "short", "comp", "outside", "asks")


def _met(rows: DataFrame, firsts: DataFrame, bits: str, most: float, percent: int) -> DataFrame:
    """``met`` of each block of ``rows``, stored; ``rows`` go."""
    maps, at = _needed(firsts, rows, ["cls"], [bits]), rows._stored_at
    rows = rows.drop("other")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    columns = [*rows.columns, bits]
    of_block = lean(lambda table: met(table.select(columns), bits, most, percent))
    found = stored(rows.join(maps, "cls").groupBy("shingle", "band", "block").applyInArrow(of_block, f"{fields}, other long"), "met", batch=WIDE)
    removed(firsts.sparkSession, [at, maps._stored_at])
    return found


def _within_large(large: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """(a, b), links between different components within large tiles: enough to merge all that link.

    A class may be in many tiles, so its set should not go to each. Rows of a block meet with the short bitmaps,
    those left with the whole ones, and what then may link is pairs, each once, that are intersected like others.
    Only blocks with more than ``MOST_PAIRS`` candidates a row get the sets of those rows."""
    counts = large.groupBy("shingle", "comp").agg(F.count("*").alias("k"))
    main = stored(counts.groupBy("shingle").agg(F.max_by("comp", F.struct("k", "comp")).alias("main")), "main")
    blocks = stored(large.groupBy("shingle", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    tiles = small(blocks, MOST_BROADCAST)
    placed = stored(large.join(small(main, MOST_BROADCAST), "shingle").join(tiles, ["shingle", "band"]).withColumn("outside", F.col("comp") != F.col("main")).drop("main", "c"), "placed")
    held = placed.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int")).withColumn("asks", F.lit(False))
    asking = placed.filter("outside").drop("blocks").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    # Bands that nobody asks send nothing.
    asked = stored(asking.select("shingle", "band").distinct(), "asked")
    asking = asking.join(tiles, ["shingle", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    held = held.join(small(asked, MOST_BROADCAST), ["shingle", "band"], "left_semi")
    rows = stored(held.unionByName(asking).drop("blocks"), "meeting")
    # By the short bitmaps no pair is put out, as most candidates go by the whole ones.
    found = _met(_met(rows, firsts, "few", -1, percent), firsts, "bits", MOST_PAIRS, percent)
    links = _intersecting(stored(found.filter("other IS NOT NULL").select(*_pair("cls", "other")).distinct(), "pairs"), firsts, percent)

    def compare(rows: pa.Table) -> pa.Table:
        found = merging_links(*[rows[c].to_numpy() for c in _OF_ROW], *[[x.as_buffer() for x in rows[c]] for c in ("bits", "shingles")], percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    # Rows of a class one after the other: its set is packed with the copies beside it.
    dense = found.filter("other IS NULL").drop("other").sortWithinPartitions("cls")
    if dense.limit(1).count():
        sets = _needed(firsts, dense, ["cls"], ["bits", "shingles"])
        merging = stored(dense.join(sets, "cls").groupBy("shingle", "band", "block").applyInArrow(lean(compare), "a long, b long").distinct(), "merging", batch=WIDE)
        removed(firsts.sparkSession, [sets._stored_at])
        links = links.unionByName(merging)
    removed(firsts.sparkSession, [placed._stored_at, found._stored_at])
    return links


def components(edges: DataFrame) -> DataFrame:
    """(cls, comp): the smallest class reachable, for classes with an edge. Smallest labels spread over
    the edges and through the labels' own labels, so chains halve with each round."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("heard"))
        near = labels.join(heard, "cls").select("cls", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        up = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("up"))
        new = stored(near.join(up, "comp", "left").select("cls", "was", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        changed = new.filter("was <> comp").limit(1).count()
        labels = new.select("cls", "comp")
        if not changed:
            return labels


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` (cls, comp) after ``links`` between its components, and classes that are in none yet."""
    for c in ("a", "b"):
        links = links.join(comp.select(F.col("cls").alias(c), F.col("comp").alias("of")), c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
    links = stored(links.filter("a <> b").distinct(), "between")
    if not links.limit(1).count():
        return comp
    up = components(links)
    moved = comp.join(up.select(F.col("cls").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("cls", F.coalesce("up", "comp").alias("comp"))
    return stored(moved.unionByName(up.join(comp, "cls", "left_anti").select("cls", "comp")), "merged")


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, often: int = OFTEN, large: int = LARGE, most_often: int = MOST_OFTEN) -> DataFrame:
    """One row a document row: doc_id, text_key, n_shingles, component_id, and comp, the component itself:
    ids may be null or repeat. comp is null for rows of no shingle."""
    described = _described(docs, words)
    rows_of = stored(described.select("doc_id", "text_key", "n", "cls"), "rows")
    sets = described.filter("cls IS NOT NULL")
    classes = stored(sets.groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("row").alias("first"), F.first("n").alias("n"), F.count("*").alias("rows")), "classes")
    # Rows that only repeat a class stay out, by a table of those rows and not of all classes.
    several = small(stored(classes.filter("rows > 1").select("cls", "first"), "several"), MOST_BROADCAST)
    again = stored(sets.select("cls", "row").join(several, "cls").filter("row <> first").select("row"), "again")
    firsts = sets.join(small(again, MOST_BROADCAST), "row", "left_anti").select("row", "cls", "n", "shingles", "bits", "few")
    shards = _shards((classes.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100)
    late = _often(firsts, percent, often, most_often, shards)
    postings = _postings(firsts, classes, late, percent, shards)
    lists = _lists(postings, percent)
    removed(docs.sparkSession, [postings._stored_at])

    def mixed(comp: DataFrame) -> DataFrame:
        """Tiles that still hold several components, with each member's."""
        placed = lists.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        apart = placed.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("shingle")
        return stored(placed.join(apart, "shingle"), "mixed")

    comp = apart = None
    done = []
    for turn in range(ROUNDS):
        # One class of each band for the tile's members of that band and the next, another each round.
        rows = lists.withColumn("comp", F.col("cls")) if apart is None else apart.filter(F.col("c") > large)
        order = F.struct(F.lit(0) if turn else F.col("n"), F.xxhash64("cls", F.lit(turn)))
        centre = rows.groupBy("shingle", "band").agg(F.min_by(F.struct(F.col("n").alias("n2"), F.col("cls").alias("cls2"), F.col("comp").alias("comp2")), order).alias("z")).select("shingle", "band", "z.*")
        near = centre.unionByName(centre.withColumn("band", F.col("band") + 1))
        pairs = rows.join(near, ["shingle", "band"]).filter(_fits(percent) & (F.col("cls") != F.col("cls2")) & (F.col("comp") != F.col("comp2"))).select(*_pair("cls", "cls2")).distinct()
        for before in done:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        done.append(pairs)
        links = _linked(pairs, firsts, percent)
        comp = components(links) if comp is None else merged(comp, links)
        apart = mixed(comp)
        if not apart.filter(F.col("c") > large).limit(1).count():
            break
    many = apart.filter(F.col("c") > large)
    if many.limit(1).count():
        comp = merged(comp, _within_large(many, firsts, percent))
        apart = mixed(comp)
    few = apart.filter(F.col("c") <= large)
    right = few.select("shingle", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("short").alias("short2"), F.col("comp").alias("comp2"))
    enough = F.when(F.col("n") <= F.col("n2"), F.col("short")).otherwise(F.col("short2"))
    more = few.join(right, "shingle").filter((F.col("cls") < F.col("cls2")) & (F.col("comp") != F.col("comp2")) & _fits(percent) & enough).select(*_pair("cls", "cls2")).distinct()
    for before in done:
        more = more.join(before, ["a", "b"], "left_anti")
    comp = stored(merged(comp, _linked(stored(more, "pairs"), firsts, percent)), "components")
    # The sets are the largest table, and nothing reads them from here on.
    removed(docs.sparkSession, [described._stored_at])
    of_class = classes.select("cls", "least").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    ids = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = of_class.join(ids, "comp").select("cls", "comp", "component_id")
    out = rows_of.join(named, "cls", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce(F.col("component_id"), F.col("doc_id")).alias("component_id"), "comp")


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id. Rows of no shingle all stay;
    of rows that repeat both id and text one stays. Columns keep their names, whatever these are."""
    found = groups(docs, words, percent)
    # Keys that must go, and keys that several rows have: few beside all rows.
    keyed = found.filter("n_shingles > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.first("comp").alias("comp"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = keyed.groupBy("comp").agg(F.min(order).alias("first"))
    marked = keyed.join(first, "comp").withColumn("gone", order != F.col("first"))
    id_, key, gone = fresh(docs.columns, "_id", "_key", "_gone")
    odd = small(stored(marked.filter("gone OR rows > 1").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("gone").alias(gone)), "goes"), MOST_BROADCAST)
    joined = docs.join(odd, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left").filter(~F.coalesce(F.col(gone), F.lit(False)))
    columns = [docs[c] for c in docs.columns]
    single = joined.filter(F.col(key).isNull()).select(*columns)
    repeated = joined.filter(F.col(key).isNotNull()).dropDuplicates([id_, key]).select(*docs.columns)
    return single.unionByName(repeated)
