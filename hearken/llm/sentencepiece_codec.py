"""SentencePiece encoding and decoding by the best path through a model's pieces.

A text's segmentation is the path of highest summed piece scores. That is an algebra of maximum and
plus, so a chunk of a text is a matrix: from the characters that the piece before reaches into the
chunk, to those that its own last piece reaches beyond. Matrices combine associatively. A giant
text is cut to chunks, whose matrices arise independently; blocks of ``FAN`` of them are combined,
blocks of a text are scanned, then the chunks of each block, and every chunk is traced back alone
between the two states it got. No task holds more than ``FAN`` matrices or one for ``FAN`` chunks.

Other texts are encoded whole. A space piece never follows other characters inside a piece (which
is checked), and a character of no longer piece stands alone, so every word is a chunk with one
state at either end, and its best path is kept.

The public model file here is of merges, whose scores are only their order. Paths need scores that
add up, so a piece's is the logarithm of one over its rank, as of Zipf's law, less ``PIECE_COST``, which
makes paths short as merges do (``scores='zipf'``); a unigram model's own scores are used as they are (``scores='model'``). Ids are the model's, and its
own library decodes them. Characters without a piece become their UTF-8 bytes' pieces; so does the
space sign itself where a text has one, and decoding gives back every text exactly.

Null texts have null ids and decode to null; empty texts have none and decode to the empty text.
Each input row, repeated ones too, gives one result row, with whatever columns were asked to be kept;
a kept column named like a result gives way to it. An empty table gives an empty result. Between
paths of equal score the one found first is taken, so a text's ids are always the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, pairwise
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearken.llm.shared import fresh, kept, lean, stored

SPACE, LITERAL = "▁", "\ud800"
GIANT = 1 << 16
CHUNK = 1 << 15
FAN = 256
#: Scores: what every piece costs beside its rank, and a byte of a character without a piece.
PIECE_COST, BYTE_SCORE = 6.0, -40.0
#: Words whose ids a worker keeps, and characters of texts that it takes at once.
MOST_WORDS, RUN = 200_000, 1 << 20
#: Characters from which on a word is not kept, and words encoded at once.
LONG, AT_ONCE = 64, 8192
NEVER = -1e18


def _spelling(model: bytes) -> tuple[list, list[bytes], dict[int, int]]:
    """Of a model file: its normal pieces (id, piece, score), every id's bytes, and each byte's id."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    spec.ParseFromString(model)
    of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == p.BYTE}
    spelled = [p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
    for byte, i in of_byte.items():
        spelled[i] = bytes([byte])
    return [(i, p.piece, p.score) for i, p in enumerate(spec.pieces) if p.type == p.NORMAL], spelled, of_byte


class Decoder:
    """Ids to text: all that decoding needs of a model."""

    def __init__(self, model: bytes):
        self.spelled = _spelling(model)[1]

    def decode(self, ids) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


class _Words(dict):
    """Ids of words met lately, four bytes each; a word that is not there is encoded on the way."""

    def __init__(self, best):
        super().__init__()
        self.best = best

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.best(word)[1], np.int32).tobytes()
        if len(word) < LONG and len(self) < MOST_WORDS:
            self[word] = ids
        return ids


class _Trie:
    """The pieces as arrays: edges by node and character, and each node's piece if it is one."""

    def __init__(self, pieces: dict[str, tuple[float, int]]):
        node_of = {"": 0} | {p: i + 1 for i, p in enumerate(dict.fromkeys(p[:k] for p in pieces for k in range(1, len(p) + 1)))}
        edges = [(node_of[p[:-1]] << 21 | ord(p[-1]), i) for p, i in node_of.items() if p]
        self.keys, self.child = np.array([k for k, _ in edges], np.int64), np.array([i for _, i in edges], np.int32)
        self.score, self.piece = np.full(len(node_of), np.nan), np.zeros(len(node_of), np.int32)
        for p, (score, i) in pieces.items():
            self.score[node_of[p]], self.piece[node_of[p]] = score, i
        # Edges by hash, each in its slot or the next free one after it.
        self.bits = (4 * len(edges)).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int32)
        edge, slot = np.arange(len(edges), dtype=np.int32), self._slot(self.keys)
        while len(edge):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = edge[free]
            later = self.slots[slot] != edge
            edge, slot = edge[later], (slot[later] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, node: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which edges there are, and where these lead."""
        wanted = node.astype(np.int64) << 21 | chars
        slot = self._slot(wanted)
        edge = self.slots[slot]
        open_ = np.flatnonzero((self.keys[edge] != wanted) & (edge >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.slots) - 1)
            edge[open_] = self.slots[slot[open_]]
            open_ = open_[(self.keys[edge[open_]] != wanted[open_]) & (edge[open_] >= 0)]
        there = edge >= 0
        return there, self.child[edge[there]]


class Codec(Decoder):
    """A model's pieces, with encoding of texts and of chunks."""

    def __init__(self, model: bytes, scores: str = "zipf"):
        normal, self.spelled, self.bytes = _spelling(model)
        #: Score and id of each piece, in the order of the model.
        self.pieces = {p: (score if scores == "model" else -float(np.log(r + 2)) - PIECE_COST, i) for r, (i, p, score) in enumerate(normal)}
        self.longest = max(map(len, self.pieces))
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece has a space inside")
        self.trie = _Trie(self.pieces)
        # Characters of no piece but their own have borders on both sides, whatever the path.
        joined = "".join(sorted({x for p in self.pieces if len(p) > 1 for x in p} - {SPACE}))
        self.units = re.compile(f"{SPACE}*[{re.escape(joined)}]+|{SPACE}+|." if joined else f"{SPACE}+|.", re.DOTALL)
        self.known = _Words(self.word)

    @staticmethod
    def normal(text: str) -> str:
        return text.replace(SPACE, LITERAL).replace(" ", SPACE)

    def _bytes(self, char: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in (SPACE if char == LITERAL else char).encode())

    def _best(self, text: str, start: int, length: int) -> tuple[list[float], list]:
        """Scores of the best paths from ``start`` to every place up to where pieces that start before
        ``length`` reach, and each place's last step. A lone character without a piece goes by bytes."""
        n, begun = len(text), self.begun.get
        last: list = [None] * (n + 1)
        best = [NEVER] * (n + 1)
        if start <= n:
            best[start] = 0.0
        for at in range(start, length):
            here = best[at]
            if here == NEVER:
                continue
            hit = begun(text[at], 0)
            if not hit:
                ids = self._bytes(text[at])
                hit, longer = (BYTE_SCORE * len(ids), ids), hit is None
            else:
                longer = True
            to = at + 1
            while True:
                if hit and here + hit[0] > best[to]:
                    best[to], last[to] = here + hit[0], (at, hit[1])
                to += 1
                if to > n or not longer:
                    break
                hit = begun(text[at:to], 0)
                if hit == 0:
                    break
        return best, last

    @staticmethod
    def _trace(last: list, start: int, end: int) -> list[int]:
        ids: list[int] = []
        while end > start:
            end, step = last[end]
            if type(step) is int:
                ids.append(step)
            else:
                ids.extend(reversed(step))
        ids.reverse()
        return ids

    def word(self, word: str) -> tuple[float, list[int]]:
        """The best path of a text between two forced borders: its score and ids."""
        score, last = self._best(word, 0, len(word))
        return score[len(word)], self._trace(last, 0, len(word))

    @cached_property
    def begun(self) -> dict:
        """The pieces and, with nothing, what they begin with."""
        return dict.fromkeys(p[:k] for p in self.pieces for k in range(1, len(p))) | self.pieces

    def many(self, words: list[str]) -> list[bytes]:
        """Ids of many short words at once: each step of the best paths is taken for all of them, place
        by place and, of pieces that end alike, from the earliest start on, as for a single text."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(chars)) - (ends - sizes)[word]
        left = sizes[word] - place
        at, node, steps = np.arange(len(chars)), np.zeros(len(chars), np.int32), []
        for size in range(1, self.longest + 1):
            room = left[at] >= size
            at, node = at[room], node[room]
            there, node = self.trie.follow(node, chars[at + (size - 1)])
            at = at[there]
            ends_here = ~np.isnan(self.trie.score[node])
            by_place = np.argsort(place[at[ends_here]], kind="stable")
            start, last = at[ends_here][by_place], node[ends_here][by_place]
            steps.append((size, start + word[start], self.trie.score[last], self.trie.piece[last], np.searchsorted(place[start], np.arange(LONG + 1))))
            if not len(at):
                break
        # A word of n characters has n + 1 states, the first its beginning.
        first = ends - sizes + np.arange(len(words))
        best, back, piece = np.full(len(chars) + len(words), NEVER), np.zeros(len(chars) + len(words), np.int64), np.zeros(len(chars) + len(words), np.int32)
        best[first] = 0.0
        for at_place in range(int(sizes.max(initial=0))):
            for size, start, score, ids, bounds in steps:
                a, b = bounds[at_place], bounds[at_place + 1]
                if a < b:
                    total, to = best[start[a:b]] + score[a:b], start[a:b] + size
                    better = total > best[to]
                    to = to[better]
                    best[to], back[to], piece[to] = total[better], size, ids[a:b][better]
        state, active = first + sizes, np.arange(len(words))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            found.append((active, piece[state[active]]))
            state[active] -= back[state[active]]
            active = active[(state[active] > first[active]) & (back[state[active]] > 0)]
        owner, ids = np.concatenate([w for w, _ in found][::-1]), np.concatenate([i for _, i in found][::-1])
        in_order = np.argsort(owner, kind="stable")
        raw, at_byte = ids[in_order].astype(np.int32).tobytes(), np.concatenate([[0], 4 * np.cumsum(np.bincount(owner, minlength=len(words)))]).tolist()
        out = [raw[a:b] for a, b in pairwise(at_byte)]
        # Characters without a piece of their own go by bytes: those words one by one.
        alone = np.zeros(len(best), bool)
        alone[steps[0][1]] = True
        for i in np.unique(word[~alone[np.arange(len(chars)) + word]]).tolist():
            out[i] = np.array(self.word(words[i])[1], np.int32).tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else self.units.findall(SPACE + self.normal(t)) if t else [] for t in texts]
        known = self.known
        words = [w for w in set(chain.from_iterable(ws for ws in cut if ws)) if len(w) < LONG]
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MOST_WORDS:
            known.clear()
            new = words
        for at in range(0, len(new), AT_ONCE):
            known.update(zip(new[at : at + AT_ONCE], self.many(new[at : at + AT_ONCE]), strict=True))
        return [None if ws is None else np.frombuffer(b"".join(map(known.__getitem__, ws)), np.int32) for ws in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def _borders(self, core: str) -> list[int]:
        """Places inside a chunk that every path has."""
        return [m.start() + 1 for m in re.finditer(f"[^{SPACE}](?={SPACE})", core)]

    def matrix(self, core: str, ahead: str) -> np.ndarray:
        """states x states: best scores from s characters into the chunk to t beyond its end. A piece
        counts where it starts; ``ahead`` is what follows the chunk, as far as a piece may reach."""
        m, n, text = self.longest, len(core), core + ahead
        out = np.full((m, m), NEVER)
        borders = self._borders(core)
        head = borders[0] if borders else n
        if borders:
            tail_at = borders[-1]
            middle = sum(self.word(core[a:b])[0] for a, b in zip(borders, borders[1:], strict=False))
            tail = np.array(self._best(text[tail_at:], 0, n - tail_at)[0][n - tail_at :][:m])
        for s in range(min(m - 1, head) + 1):
            if borders:
                into = self._best(core[:head], s, head)[0][head]
                out[s, : len(tail)] = into + middle + tail
            else:
                reach = self._best(text, s, n)[0][n:][:m]
                out[s, : len(reach)] = reach
        for s in range(n, m):  # a piece may reach over a whole short chunk
            out[s, s - n] = 0.0
        return np.maximum(out, NEVER)

    def between(self, core: str, ahead: str, s: int, t: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on its best path from state s to state t."""
        n, text = len(core), core + ahead
        if s >= n:
            return []
        borders = [b for b in self._borders(core) if b >= s]
        if not borders:
            return self._trace(self._best(text, s, n)[1], s, n + t)
        ids = self._trace(self._best(core[: borders[0]], s, borders[0])[1], s, borders[0])
        for a, b in zip(borders, borders[1:], strict=False):
            ids += np.frombuffer(self.known[core[a:b]], np.int32).tolist()
        tail = text[borders[-1] :]
        return ids + self._trace(self._best(tail, 0, n - borders[-1])[1], 0, n - borders[-1] + t)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product: associative, so chunks combine in any grouping."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), NEVER)


def states(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The states at all borders of a row of chunks on the best path from ``first`` to ``last``."""
    reach = [np.where(np.arange(len(matrices[0])) == first, 0.0, NEVER)]
    for m in matrices:
        reach.append(np.maximum((reach[-1][:, None] + m).max(axis=0), NEVER))
    out = [last]
    for m, v in zip(reversed(matrices), reversed(reach[:-1]), strict=True):
        out.append(int((v + m[:, out[-1]]).argmax()))
    return out[::-1]


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``RUN`` bytes of a text column."""
    ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    """An array of integer lists from one flat array."""
    sizes = np.array([0 if x is None else len(x) for x in rows], np.int32)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    flat = np.concatenate([x for x in rows if x is not None] or [np.zeros(0, np.int32)])
    nulls = pa.array([x is None for x in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=nulls)


@kept(2)
def codec(path: str, scores: str) -> Codec:
    """One codec a process; the model file is installed on every machine, at the path given."""
    return Codec(Path(path).read_bytes(), scores)


@kept(2)
def decoder(path: str) -> Decoder:
    return Decoder(Path(path).read_bytes())


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, keep: list[str], model: str | None = None, scores: str = "zipf", giant: int = GIANT, chunk: int = CHUNK, fan: int = FAN, checked: bool = False) -> DataFrame:
    """The columns ``keep`` + ids, from ``text``, and where ``checked`` round_trip: whether decoding the
    ids gives the text. Kept columns of these names are replaced."""
    path = str(model or public_model())
    results = ["ids", "round_trip"][: 1 + checked]
    keep = [k for k in keep if k.lower() not in results]
    source, row = fresh(keep, "_text", "_row")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, scores)
        for batch in batches:
            for part in _runs(batch, source):
                texts = part.column(source).to_pylist()
                ids = c.encode_all(texts)
                out = part.select(keep).append_column("ids", _lists(ids))
                if checked:
                    same = [t is None if i is None else c.decode(i.tolist()) == t for t, i in zip(texts, ids, strict=True)]
                    out = out.append_column("round_trip", pa.array(same, pa.bool_()))
                yield out

    read = docs.select(*keep, F.col("text").alias(source))
    kinds = "".join(f"`{k}` {read.schema[k].dataType.simpleString()}, " for k in keep)
    is_giant = F.coalesce(F.length(source) > giant, F.lit(False))
    usual = read.filter(~is_giant).mapInArrow(lean(whole), f"{kinds}ids array<int>{', round_trip boolean' * checked}")
    giants = stored(read.filter(is_giant).withColumn(row, F.monotonically_increasing_id()), "giants")
    if not giants.limit(1).count():
        return usual
    ids = _giants(giants.select(F.col(row).alias("_row"), F.col(source).alias("_text")), path, scores, chunk, fan)
    if checked:
        ids = decode(ids, model)
    met = giants.join(ids.withColumnRenamed("_row", row), row)
    return usual.unionByName(met.select(*keep, "ids", *[F.col("decoded").eqNullSafe(F.col(source)).alias("round_trip")] * checked))


def _giants(giants: DataFrame, path: str, scores: str, chunk: int, fan: int) -> DataFrame:
    ahead = codec(path, scores).longest - 1
    # One sign more at the start, as of every text; the space sign itself is marked as in ``normal``.
    text = F.concat(F.lit(" "), "_text")
    cut = giants.select("_row", text.alias("t"), F.explode(F.sequence(F.lit(0), F.floor(F.length("_text") / chunk).cast("int"))).alias("c"))
    chunks = cut.select("_row", "c", F.substring("t", F.col("c") * chunk + 1, F.lit(chunk)).alias("core"), F.substring("t", (F.col("c") + 1) * chunk + 1, F.lit(ahead)).alias("ahead")).filter("core <> ''")
    chunks = stored(chunks.repartition("_row", "c"), "chunks")

    def to_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, scores)
        for batch in batches:
            ms = [c.matrix(c.normal(x), c.normal(y)).ravel() for x, y in zip(batch.column("core").to_pylist(), batch.column("ahead").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("c"), pa.array(ms, pa.list_(pa.float64()))], names=["_row", "c", "m"])

    square = lambda m: np.asarray(m).reshape(ahead + 1, ahead + 1)

    def combined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        total = square(rows["m"].iloc[0])
        for m in rows["m"].iloc[1:]:
            total = product(total, square(m))
        return pd.DataFrame({"_row": [rows["_row"].iloc[0]], "block": [rows["block"].iloc[0]], "m": [total.ravel()]})

    def scanned(rows: pd.DataFrame) -> pd.DataFrame:
        """Blocks of a text, from state 0 to state 0."""
        rows = rows.sort_values("block")
        at = states([square(m) for m in rows["m"]], 0, 0)
        return pd.DataFrame({"_row": rows["_row"], "block": rows["block"], "first": at[:-1], "last": at[1:]})

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        """Chunks of a block, between the block's two states."""
        rows = rows.sort_values("c")
        at = states([square(m) for m in rows["m"]], rows["first"].iloc[0], rows["last"].iloc[0])
        return pd.DataFrame({"_row": rows["_row"], "c": rows["c"], "s": at[:-1], "t": at[1:]})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, scores)
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in ("core", "ahead", "s", "t")]
            ids = [np.array(c.between(c.normal(x), c.normal(y), s, t), np.int32) for x, y, s, t in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("c"), pa.array(ids, pa.list_(pa.int32()))], names=["_row", "c", "ids"])

    matrices = stored(chunks.mapInArrow(to_matrix, "_row long, c int, m array<double>").withColumn("block", F.floor(F.col("c") / fan).cast("int")), "matrices")
    blocks = matrices.groupBy("_row", "block").applyInPandas(combined, "_row long, block int, m array<double>")
    ends = blocks.groupBy("_row").applyInPandas(scanned, "_row long, block int, first int, last int")
    placed = matrices.join(ends, ["_row", "block"]).groupBy("_row", "block").applyInPandas(within, "_row long, c int, s int, t int")
    ids = chunks.join(placed, ["_row", "c"]).select("_row", "c", "core", "ahead", "s", "t").mapInArrow(traced, "_row long, c int, ids array<int>")
    return ids.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "ids"))), lambda x: x["ids"])).alias("ids"))


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` + decoded, the text of its ids; a column of that name is replaced."""
    path = str(model or public_model())

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = decoder(path)
        for ids in parts:
            yield pd.Series([None if x is None else d.decode(x.tolist()) for x in ids], dtype=object)

    return encoded.withColumn("decoded", text_of("ids"))
