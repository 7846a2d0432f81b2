"""Token ids of documents in files of their own format, in the order of document ids.

Tasks take documents by ranges of ids, encode the texts, and write files of about ``FILE_IDS`` ids each:
under another name first, so that a file is there whole or not at all, and a task that runs again writes
the same files. A file's name has its range and its number there, so names in order are documents in
order. Reading is a job over the files.

Null text is empty and has the end id alone. Null ids come first; of rows that repeat an id the order is
that of a hash of the text, and each is a document of its own, rows alike in both included. Further
columns are ignored, whatever their names. An empty table writes files without documents, or none. A very
long text is encoded whole; files end between documents, so such a text makes a longer file.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from hearken.llm import simple8b
from hearken.llm.shared import deleted_on_exit, kept, shared_folder, small, stored
from hearken.llm.word_arrays import lots

#: Ids of a file, bytes of text that are encoded at once, and words of which the ids are kept.
FILE_IDS, LOT, KEPT_WORDS = 2 << 20, 8 << 20, 300_000
#: Copies of one row are dealt to so many parts of their range.
COPIES = 4096
_PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+").fullmatch
#: Of each byte: whether it is of a word, a mark that may end one, a letter or digit, or the first or second
#: byte of an accented letter.
_OF_WORD, _MARK, _ALNUM, _LEAD, _SECOND = 1, 2, 4, 8, 16
_CLASS = np.full(256, _OF_WORD, np.uint8)
_CLASS[list(b" \n")] = 0
_CLASS[list(b".,;:!?")] |= _MARK
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] |= _ALNUM
_CLASS[0xC3] |= _LEAD
_CLASS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] |= _SECOND


class Encoder:
    """Ids of texts by a tokenizer file, the same as the library's ``encode`` gives.

    A tokenizer that drops white space and never joins letters to marks is asked once a word: texts are
    cut at blanks and line ends, and before a last mark that follows a letter or digit. Words of plain
    lower-case letters go to its model at once, others through all of it. Other tokenizers get whole texts."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            says = json.load(file)
        steps = [x["type"] for x in (says.get("normalizer") or {}).get("normalizers", [])]
        cuts = (says.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in cuts[0]["pattern"]["Regex"] and not says.get("post_processor")
        bytes_as = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): bytes_as.pre_tokenize_str(c)[0][0] for c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size, self.pool = [], [], np.zeros(0, np.uint32)

    def _learn(self, names: list[bytes]) -> None:
        # Of bytes, isalpha and islower look at ASCII alone.
        plain = [n.decode() if n.isalpha() and n.islower() else None for n in names]
        others = [k for k, w in enumerate(plain) if w is None]
        whole = []
        for k in others:
            word = names[k].decode()
            if _PLAIN(word):
                plain[k] = word.lower().translate(self.letters)
            else:
                whole.append(word)
        rest = iter(self.tokenizer.encode_batch(whole, add_special_tokens=False))
        new, n, tokenize = [], len(self.pool), self.tokenizer.model.tokenize
        for name, word in zip(names, plain, strict=True):
            ids = next(rest).ids if word is None else [t.id for t in tokenize(word)]
            self.known[name] = len(self.begin)
            self.begin.append(n + len(new))
            self.size.append(len(ids))
            new += ids
        self.pool = np.concatenate([self.pool, np.array(new, np.uint32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of them."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.array([len(ids) for ids in found], np.int64)
        raw = [t.encode() for t in texts]
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])[:-1]
        joined = b"\n".join(raw)
        # Small letters at once are few words; special tokens are found before letters are made small.
        data = np.frombuffer(joined if b"<|" in joined else joined.lower(), np.uint8)
        kind = _CLASS[data]
        word = (kind & _OF_WORD).astype(bool)
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        letter = (kind & _ALNUM).astype(bool)
        letter[1:] |= (kind[1:] & _SECOND).astype(bool) & (kind[:-1] & _LEAD).astype(bool)
        mark = (kind[1:] & _MARK).astype(bool) & letter[:-1]
        mark[:-1] &= ~word[2:]
        starts[1:] |= mark
        starts = np.flatnonzero(starts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        kept = np.cumsum(word, dtype=np.int32)
        offsets = np.append(kept[starts] - 1, kept[-1]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])]).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self._forget()
        self._learn([n for n in names if n not in self.known])
        place = np.array([self.known[n] for n in names], np.int32)[coded.indices.to_numpy()]
        size = np.array(self.size, np.int32)[place]
        from_pool = np.repeat(np.array(self.begin, np.int32)[place] - (np.cumsum(size, dtype=np.int32) - size), size)
        ids = self.pool[from_pool + np.arange(len(from_pool), dtype=np.int32)]
        text = np.searchsorted(begins, starts, "right") - 1
        return ids, np.bincount(text, size, len(texts)).astype(np.int64)


@kept(1)
def encoder(path: str) -> Encoder:
    """One a worker: the words that it has learned serve the next tasks too."""
    return Encoder(path)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text's ids."""
    out = np.full(len(ids) + len(sizes), end, np.uint32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    out[inner] = ids
    return out, sizes + 1


def _put(folder: str, name: str, content: bytes) -> None:
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, f"{path}/{name}")


def write(docs: DataFrame, folder: str, tokenizer: str, end: int) -> DataFrame:
    """Write the documents' ids into new files of ``folder``, a place that pyarrow can open; returns (file,
    documents, ids), a row a file."""
    _, path = pyarrow.fs.FileSystem.from_uri(folder)
    pyarrow.fs.FileSystem.from_uri(folder)[0].create_dir(path)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_copy")]
    copy = F.monotonically_increasing_id() % COPIES
    ranged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("_hash"), copy.alias("_copy"))
    ranged = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, sizes, ids = [], [], []

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{number:06d}.s8b"
            all_ids, n = np.concatenate(ids), np.concatenate(sizes)
            _put(folder, name, simple8b.to_bytes(doc_ids, n, all_ids))
            return pa.RecordBatch.from_pydict({"file": [name], "documents": [len(doc_ids)], "ids": [len(all_ids)]})

        for rows in lots(batches, LOT):
            found, n = with_end(*encoder(tokenizer).encode([t for _, t in rows]), end)
            doc_ids.extend(i for i, _ in rows)
            sizes.append(n)
            ids.append(found)
            if sum(map(len, ids)) >= FILE_IDS:
                yield flush()
                number += 1
                doc_ids, sizes, ids = [], [], []
        if doc_ids:
            yield flush()

    return stored(ranged.mapInArrow(put, "file string, documents long, ids long"), "tokenFiles", batch=1000)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, doc_id, ids) of all documents; place counts from 0 in a file."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                found = simple8b.from_bytes(content.as_buffer().to_pybytes())
                values = simple8b.decode(found.coded).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(found.sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found.ids)), pa.array(np.arange(len(found.ids))), pa.array(found.ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["file", "place", "doc_id", "ids"])

    return _files(spark, folder).mapInArrow(take, "file string, place long, doc_id long, ids array<long>")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: ids of all documents before, those of the document,
    and the CRC of these as little-endian 32-bit integers."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                found = simple8b.from_bytes(content.as_buffer().to_pybytes())
                values = memoryview(simple8b.decode(found.coded).astype("<u4"))
                ends = np.cumsum(found.sizes)
                starts = ends - found.sizes
                crc = [zlib.crc32(values[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                part, number = (int(x) for x in file.removesuffix(".s8b").split("-")[1:])
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(crc), pa.int64()) for x in (part, number)] + [pa.array(found.ids, pa.int64()), pa.array(starts), pa.array(found.sizes), pa.array(crc, pa.int64())], names=["part", "number", "doc_id", "inside", "n_tokens", "ids_crc32"])

    found = stored(_files(spark, folder).mapInArrow(take, "part long, number long, doc_id long, inside long, n_tokens long, ids_crc32 long"), "tokenDigests", batch=1)
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("before_part"))
    files = files.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("before_file")).join(parts, "part")
    files = files.select("part", "number", (F.col("before_part") + F.col("before_file")).alias("before"))
    return found.join(small(files, 500_000), ["part", "number"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    """A folder of the shared one, removed with the application."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    deleted_on_exit(spark, folder)
    return folder
