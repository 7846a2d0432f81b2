"""Source divergence audit: how far the vocabularies of a language's sources lie apart.

Terms are runs of letters A-Z and of characters beyond ASCII, A-Z in lower case. A language keeps the
terms that at least ``least`` of its documents have. Document frequencies first go to a count-min
sketch, which never says too little: terms that cannot reach ``least`` stay in their task. The others
are counted exactly, by language, source and term.

Every source and every language gives each kept term a share in billionths,
``1 + floor(10**9 * (count + 2) / (N + 2 * V))``; two shares p and q differ by
``floor((p - q)**2 / (p + q))``. Sources of a language are compared over all its kept terms, but terms
that a source lacks all have the same share there, so only terms that both have are joined (sparse),
and the rest is summed by how often each count occurs.

Null text, language and source are empty strings. Ids play no part but that each row is a document, so
repeated rows count again; further columns are ignored. A source without terms has the share of count 0
for all; without kept terms all sums are 0. Ties go by the item's UTF-8 bytes. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm import count_sketch
from hearken.llm.shared import small, stored
from hearken.llm.word_arrays import Words, hashes, kinds, lots, words_of

KINDS = kinds(b"", bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: Bytes of text that a task counts at once, and those of a longer text that are looked at together.
LOT = 16 << 20
#: Cells of the sketch, as a power of two.
BITS = 24
#: Sources of all languages that a broadcast may have.
MOST_SOURCES = 200_000


class Lot:
    """Words of some documents, with each document's language and source as numbers."""

    def __init__(self, rows: list[tuple[str, str, str]]) -> None:
        groups = {g: k for k, g in enumerate(dict.fromkeys((lang, source) for lang, source, _ in rows))}
        langs = {g: k for k, g in enumerate(dict.fromkeys(lang for lang, _ in groups))}
        self.groups, self.langs = list(groups), list(langs)
        self.words: Words = words_of([text for _, _, text in rows], KINDS)
        self.group_of = np.array([groups[lang, source] for lang, source, _ in rows], np.int64)
        self.lang_of = np.array([langs[lang] for lang, _ in groups], np.int64)
        self.size = max(len(self.words.names), 1)
        seen = np.unique(self.words.text * self.size + self.words.ids)
        self.seen_text, self.seen_id = seen // self.size, seen % self.size

    def keys(self, lang: np.ndarray, ids: np.ndarray) -> np.ndarray:
        by_lang, by_word = hashes(x.encode() for x in self.langs), hashes(self.words.names)
        return (by_lang[lang] ^ (by_word[ids] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """(key, documents) of each language's terms."""
        both, n = np.unique(self.lang_of[self.group_of[self.seen_text]] * self.size + self.seen_id, return_counts=True)
        return self.keys(both // self.size, both % self.size), n

    def counts(self, sketch: count_sketch.Sketch) -> Iterator[pa.RecordBatch]:
        both, n = np.unique(self.group_of[self.words.text] * self.size + self.words.ids, return_counts=True)
        _, documents = np.unique(self.group_of[self.seen_text] * self.size + self.seen_id, return_counts=True)
        group, ids = both // self.size, both % self.size
        keep = np.flatnonzero(sketch.reaches(self.keys(self.lang_of[group], ids)))
        names = pa.array([x.decode() for x in self.words.names], pa.string())
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for at in range(0, len(keep), 50_000):
            k = keep[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(group[k])), sources.take(pa.array(group[k])), names.take(pa.array(ids[k])), pa.array(n[k]), pa.array(documents[k])], names=["lang", "source", "term", "n", "documents"])


def term_counts(texts: DataFrame, least: int = 10, bits: int = BITS) -> DataFrame:
    """(lang, source, term, n, documents) of at least all terms that ``least`` documents of a language have;
    stored. ``texts`` has lang, source and text without nulls."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows in lots(batches, LOT):
            yield Lot(rows).documents()

    sketch = texts.sparkSession.sparkContext.broadcast(count_sketch.merged(texts, keys, least, bits))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in lots(batches, LOT):
            yield from Lot(rows).counts(sketch.value)

    found = texts.mapInArrow(count, "lang string, source string, term string, n long, documents long")
    return stored(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")), "termCounts")


def share(n: Column, total: Column, kept: Column) -> Column:
    wide = F.lit(1_000_000_000).cast("decimal(38,0)") * (n + 2).cast("decimal(38,0)")
    return F.call_function("div", wide, (total + 2 * kept).cast("decimal(38,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """Shares are below 2 ** 30 and a bit, so squares stay within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = 10, most: int = 10, bits: int = BITS) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: each other source of the language and how far
    it lies apart over all kept terms. Part ``term``: the ``most`` terms by which a source lies farthest
    above its language."""
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(texts, least, bits)
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents")).filter(F.col("documents") >= least).drop("documents"), "keptTerms")
    rows = counts.drop("documents").join(kept, ["lang", "term"])
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    of_source = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    groups = texts.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    absent = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
    groups = stored(groups.withColumn("absent", absent), "sources")
    beside = small(groups, MOST_SOURCES)

    shares = rows.join(beside, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    shares = stored(shares.select("lang", "source", "term", "n", "p", "absent", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")), "shares")
    above = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    one, two = (shares.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p{k}"), F.col("absent").alias(f"z{k}")) for k, s in ((1, "source"), (2, "other")))
    p1, p2, z1, z2 = (F.col(c) for c in ("p1", "p2", "z1", "z2"))
    shared = one.join(two, ["lang", "term"]).filter(F.col("source") < F.col("other"))
    shared = shared.groupBy("lang", "source", "other").agg(F.sum(apart(p1, p2) - apart(p1, z2) - apart(z1, p2) + apart(z1, z2)).alias("value"))
    shared = shared.unionByName(shared.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))

    others = small(groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("z2"), F.col("present").alias("present2")), MOST_SOURCES)
    times = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = times.join(others, "lang").filter(F.col("source") != F.col("other")).select("lang", "source", "other", (F.col("times") * apart(F.col("p"), z2)).alias("value"))
    alone = alone.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    alone = alone.unionByName(alone.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pairs = groups.join(others, "lang").filter(F.col("source") != F.col("other"))
    neither = F.coalesce(apart(F.col("absent"), z2) * (F.col("kept") - F.col("present") - F.col("present2")), F.lit(0))
    pairs = pairs.select("lang", "source", "other", neither.alias("value")).unionByName(shared).unionByName(alone)
    pairs = pairs.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    top = above.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(top)
