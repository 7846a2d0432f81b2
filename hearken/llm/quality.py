"""Quality rules: plain counts, and bands on n-gram perplexity under modified Kneser-Ney models.

Two models: one of words (``word_model``), which sees their order, and one of character classes,
which sees how words are spelt.

Class model. Spark counts 4-grams of character classes (``CLASSES`` of them, over UTF-8 bytes) for
each language over all documents; continuation counts, the three discounts, the discounted shares
and the back-off weights of every order are DataFrame aggregations of those counts. The numbers stay
in a stored table. Up to ``MOST_NUMBERS`` of them, which is checked, they are broadcast; beyond that
texts are dealt by language and slot of about ``SLOT`` bytes and meet the numbers of that language
alone. Either way a task unfolds a language's to rows by context, and every text gets the same nats.

Verdict. The nats a word (the logarithm of the perplexity) of each text under its language's model;
per language the median over all texts is the band's middle, and its half-width is a share of the
median plus the noise of a text of that length. Texts below are rejected. Those above get a second
look, as they may change languages: every stretch of ``STRETCH`` n-grams counts under the one of
all learned languages that suits it best, and texts still above are rejected. Texts above the
language's band of the word model (nats a pair of words) are rejected; that model has the pairs of
all languages, so a text may change between them. It has no lower limit: copies make it low.

Null or empty texts have no words and fail the base rule. A null language is a language of its own.
Languages of fewer than ``LEAST_TEXTS`` texts have the band of all texts; texts too short to score are
not rejected by the method. Very long texts are scored in slices. Each input row gives one result
row, repeated rows equal ones; an empty table gives none. Other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.llm import word_model
from hearken.llm.shared import fresh, lean, small, stored

CLASSES = 64
ORDER = 4
LEAST_TEXTS = 50
SHARE, NOISE = 0.25, 2.5
SLICE = 1 << 20
STRETCH = 256
SLOT = 8 << 20
#: Numbers of the class model up to which it is broadcast: sixteen bytes each.
MOST_NUMBERS = 4_000_000
#: Languages whose numbers a task has unfolded at once.
MOST_UNFOLDED = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"


def _class_table() -> np.ndarray:
    """Class of each byte: letters by name, capitals, digits and rare marks together, and the bytes
    of other characters spread over the last twenty."""
    kinds = np.zeros(256, np.uint8)
    for byte in range(256):
        char = chr(byte)
        if "a" <= char <= "z":
            kinds[byte] = byte - 97
        elif "A" <= char <= "Z":
            kinds[byte] = 26
        elif char.isdigit() and byte < 128:
            kinds[byte] = 27
        elif char in " \n.,":
            kinds[byte] = 28 + " \n.,".index(char)
        else:
            kinds[byte] = 44 + byte % 20 if byte >= 128 else 32 + byte % 12
    return kinds


KIND_OF = _class_table()


def _grams(raw: bytes, order: int = ORDER) -> Iterator[np.ndarray]:
    """The packed n-grams of a text, a slice at a time."""
    for at in range(0, max(len(raw) - order + 1, 0), SLICE):
        kinds = KIND_OF[np.frombuffer(raw[at : at + SLICE + order - 1], np.uint8)].astype(np.uint32)
        packed = np.zeros(len(kinds) - order + 1, np.uint32)
        for i in range(order):
            packed = packed << 6 | kinds[i : len(kinds) - order + 1 + i]
        yield packed


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, c), summed over runs of a few megabytes of each language."""
    waiting: dict[str, list[np.ndarray]] = {}

    def flush(lang: str) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "c"])

    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for grams in _grams((text or "").encode()):
                waiting.setdefault(lang, []).append(grams)
                if sum(map(len, waiting[lang])) > 4 * SLICE:
                    yield flush(lang)
        if len(waiting) > 64:
            for lang in list(waiting):
                yield flush(lang)
    for lang in list(waiting):
        yield flush(lang)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over all documents."""
    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return read.mapInArrow(lean(_count), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, v), each n-gram's discounted share of its context, and (lang, gram, v), each
    context's weight for the next lower order. Discounts are those of modified Kneser-Ney."""
    n = lambda k: F.sum((F.col("c") == k).cast("double"))
    steps = counts.groupBy("lang").agg(*[n(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    # A discount is between nothing and its count, also where few n-grams leave the formula undefined.
    d = [F.greatest(F.least(F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(0.5)), F.lit(k - 0.01)), F.lit(0.01)) for k in (1, 2, 3)]
    by_context = W.partitionBy("lang", "context")
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    placed = counts.join(F.broadcast(steps.select("lang", *[x.alias(f"d{i + 1}") for i, x in enumerate(d)])), "lang").withColumn("context", F.shiftright("gram", 6)).withColumn("off", off).withColumn("all", F.sum("c").over(by_context))
    shares = placed.select("lang", "gram", ((F.col("c") - F.col("off")) / F.col("all")).alias("v"))
    weights = placed.groupBy("lang", F.col("context").alias("gram")).agg((F.sum("off") / F.max("all")).alias("v"))
    return shares, weights


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, part, gram, v): the model's numbers of all orders; part is 'share' or 'weight'."""
    tables = []
    for n in range(order, 0, -1):
        for part, df in zip(("share", "weight"), _shares(counts), strict=True):
            tables.append(df.select("lang", F.lit(n).alias("n"), F.lit(part).alias("part"), "gram", "v"))
        # Below the highest order an n-gram counts the different classes before it.
        if n > 1:
            lower = counts.groupBy("lang", F.col("gram").bitwiseAND((1 << 6 * (n - 1)) - 1).alias("gram")).agg(F.count("*").alias("c"))
            counts = stored(lower, "continuations")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def learn(docs: DataFrame) -> DataFrame:
    """(lang, kind, gram, v), stored: the model's numbers; kind is twice the order, and one more for weights."""
    model = kneser_ney(stored(gram_counts(docs), "gramCounts"))
    return stored(model.select("lang", (2 * F.col("n") + (F.col("part") == "weight").cast("int")).alias("kind"), "gram", F.col("v").cast("float").alias("v")), "kneserNey")


def _arrays(kind: np.ndarray, gram: np.ndarray, v: np.ndarray) -> dict:
    """{(n, part): (sorted n-grams, values)} of one language."""
    found = {}
    for n in range(1, ORDER + 1):
        for w, part in enumerate(("share", "weight")):
            at = np.flatnonzero(kind == 2 * n + w)
            at = at[np.argsort(gram[at])]
            found[(n, part)] = (gram[at], v[at])
    return found


def fit(docs: DataFrame) -> dict:
    """{'order', 'arrays': {lang: {(n, part): (sorted n-grams, values)}}}: a model of a few languages in
    memory. The verdicts do without it."""
    found = learn(docs).toPandas()
    return {"order": ORDER, "arrays": {lang: _arrays(*(rows[c].to_numpy() for c in ("kind", "gram", "v"))) for lang, rows in found.groupby("lang")}}


class Scorer:
    """One language's model unfolded: for each known context a row of log-probabilities of the next class."""

    def __init__(self, arrays: dict, order: int):
        self.order = order
        lower = np.full((1, CLASSES), 1 / CLASSES, np.float32)
        row_of = np.zeros(1, np.int32)
        for n in range(1, order + 1):
            grams, shares = arrays[(n, "share")]
            contexts, weights = arrays[(n, "weight")]
            # The lower order's context drops the first class.
            known = row_of[contexts & ((1 << 6 * max(n - 2, 0)) - 1)] if n > 1 else np.zeros(len(contexts), np.int32)
            rows = weights[:, None] * lower[known]
            rows[np.searchsorted(contexts, grams >> 6), grams & 63] += shares
            row_of = np.full(1 << 6 * (n - 1), -1, np.int32)
            row_of[contexts] = np.arange(len(contexts), dtype=np.int32)
            # The last row, which -1 finds, is for contexts that the language lacks.
            lower = np.concatenate([rows, np.full((1, CLASSES), 1 / CLASSES, np.float32)])
        self.row_of, self.logs = row_of, np.log(np.maximum(lower, 1e-12))

    def nats(self, raw: bytes) -> tuple[float, int]:
        """Nats of a text and how many n-grams they come from."""
        total, count = 0.0, 0
        for grams in _grams(raw, self.order):
            total -= float(self.logs[self.row_of[grams >> 6], grams & 63].sum(dtype=np.float64))
            count += len(grams)
        return total, count

    def stretches(self, grams: np.ndarray) -> np.ndarray:
        """Nats of each stretch of a slice's n-grams."""
        return -np.add.reduceat(self.logs[self.row_of[grams >> 6], grams & 63], np.arange(0, len(grams), STRETCH))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n = len(words)
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pairs = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1] if len(ids) > 1 << 20 else seq[:-1] * len(ids) + seq[1:]
        windows = pairs[:-1] * len(ids) + seq[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        marked = np.zeros(n, bool)
        for i in range(3):
            marked[i : n - 2 + i] |= twice
        repeated = int(marked.sum())
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), repeated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


KEYS = ("doc_id", "lang", "text_key")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("text_key"), "text")


def _scorer(numbers: pa.Table) -> Scorer | None:
    return Scorer(_arrays(*(numbers[c].to_numpy() for c in ("kind", "gram", "v"))), ORDER) if numbers.num_rows else None


def _meeting(texts: DataFrame, model: DataFrame, by: str, work, schema: str) -> DataFrame:
    """``work(texts, scorer)`` over the texts of each language, as the column ``by`` has it."""
    if model.limit(MOST_NUMBERS + 1).count() <= MOST_NUMBERS:
        return _beside(texts, model, by, work, schema)
    slots = stored(texts.groupBy(by).agg(F.ceil(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64) / SLOT).cast("long").alias("slots")), "slots")
    few = small(slots, 100_000)
    placed = texts.withColumn("row", F.monotonically_increasing_id()).join(few, by).withColumn("slot", F.expr("row % slots")).drop("row", "slots")
    numbers = model.withColumnRenamed("lang", by).join(few, by).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    met = placed.groupBy(by, "slot").cogroup(numbers.groupBy(by, "slot"))
    return met.applyInArrow(lambda left, right: work(left, _scorer(right)), schema)


def _beside(texts: DataFrame, model: DataFrame, by: str, work, schema: str) -> DataFrame:
    """The same with the numbers, whose count was checked, beside every task: texts are not moved."""
    numbers = model.select("lang", "kind", "gram", "v").toArrow()
    shared = texts.sparkSession.sparkContext.broadcast({lang: numbers.filter(pc.equal(numbers["lang"], lang)).drop_columns("lang") for lang in pc.unique(numbers["lang"]).to_pylist()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers: dict[str, Scorer | None] = {}
        for batch in batches:
            table = pa.table(batch)
            for lang in pc.unique(table[by]).to_pylist():
                if lang not in scorers:
                    if len(scorers) >= MOST_UNFOLDED:
                        scorers.pop(next(iter(scorers)))
                    scorers[lang] = _scorer(shared.value[lang]) if lang in shared.value else None
                yield from work(table.filter(pc.equal(table[by], lang)), scorers[lang]).to_batches()

    return texts.mapInArrow(lean(run), schema)


def measured(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, lang, text_key, the base counts, nats a word (null where not scored), stored."""

    def measure(rows: pa.Table, scorer: Scorer | None) -> pa.Table:
        counts, nats = [], []
        for text in rows["text"].to_pylist():
            counts.append(base_counts(text or ""))
            total, n = scorer.nats((text or "").encode()) if scorer else (0.0, 0)
            nats.append(total / counts[-1][0] if n and counts[-1][0] else None)
        return pa.table([*[rows[c] for c in KEYS], *[pa.array([c[i] for c in counts], pa.int64()) for i in range(5)], pa.array(nats, pa.float64())], names=[*KEYS, *COUNTS, "nats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, text_key long, {', '.join(f'{c} long' for c in COUNTS)}, nats double"
    return stored(_meeting(_read(docs), model, "lang", measure, schema), "measured")


def _second_look(docs: DataFrame, model: DataFrame, above: DataFrame) -> DataFrame:
    """(doc_id, lang, text_key, switched): nats a word of the texts ``above`` where each stretch may be
    in the language, of all learned, that suits it best."""

    def look(rows: pa.Table, scorer: Scorer | None) -> pa.Table:
        found, words = [], []
        for text in rows["text"].to_pylist():
            raw = text.encode()
            found.append([float(x) for g in _grams(raw) for x in scorer.stretches(g)] if scorer else [])
            words.append(max(len(raw.split()), 1))
        return pa.table([*[rows[c] for c in KEYS], pa.array(words, pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=[*KEYS, "words", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = small(above.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_key").alias("_key")).distinct(), 1_000_000)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("text_key") == F.col("_key"))
    texts = stored(_read(docs).join(keys, same, "left_semi").dropDuplicates(list(KEYS)), "textsAbove")
    asked = texts.crossJoin(F.broadcast(model.select(F.col("lang").alias("under")).distinct()))
    seen = _meeting(asked, model, "under", look, f"doc_id {kind}, lang string, text_key long, words long, found array<double>")
    best = seen.select(*KEYS, "words", F.posexplode("found").alias("at", "x")).groupBy(*KEYS, "at").agg(F.min("x").alias("x"), F.first("words").alias("words"))
    return best.groupBy(*KEYS).agg((F.sum("x") / F.first("words")).alias("switched"))


def _bands(scored: DataFrame, value: str) -> DataFrame:
    """(lang, middle, noise) of a value, for every language; stored. Those of few texts have all texts'."""
    scored = scored.filter(F.col(value).isNotNull() & (F.col("n_words") > 0)).select("lang", "n_words", value)
    # Each text counts for its language and, under null, for all.
    both = scored.withColumn("of", F.explode(F.array("lang", F.lit(None).cast("string"))))
    middle = stored(both.groupBy("of").agg(F.percentile_approx(value, F.lit(0.5), F.lit(10000)).alias("middle"), F.count("*").alias("texts")), "middles")
    off = F.abs(F.col(value) - F.col("middle")) * F.sqrt("n_words")
    near = small(middle.select(F.col("of").alias("at"), "middle", "texts"), 100_000)
    noise = both.join(near, F.col("of").eqNullSafe(F.col("at"))).groupBy("of").agg(F.percentile_approx(off * 1.4826, F.lit(0.5), F.lit(10000)).alias("noise"), F.first("middle").alias("middle"), F.first("texts").alias("texts"))
    found = stored(noise, "bands")
    every = found.filter("of IS NULL").select(F.col("middle").alias("m"), F.col("noise").alias("x"))
    own = F.col("texts") >= LEAST_TEXTS
    return found.filter("of IS NOT NULL").crossJoin(small(every, 1)).select(F.col("of").alias("lang"), F.when(own, F.col("middle")).otherwise(F.col("m")).alias("middle"), F.when(own, F.col("noise")).otherwise(F.col("x")).alias("noise"))


def _word_scores(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with word_nats and word_failed, whether that is above the language's band."""
    scores = word_model.score(word_model.text_of(docs))
    scored = stored(found.withColumn("key", word_model.key_of("doc_id", "lang", "text_key")).join(scores, "key", "left").drop("key"), "wordScored")
    half = SHARE * F.col("middle") + NOISE * F.col("noise") / F.sqrt(F.greatest("n_words", F.lit(1)))
    banded = scored.join(small(_bands(scored, "word_nats"), 100_000), "lang", "left")
    return stored(banded.withColumn("word_failed", F.coalesce(F.col("word_nats") > F.col("middle") + half, F.lit(False))).drop("middle", "noise"), "wordVerdicts")


def verdicts(docs: DataFrame) -> DataFrame:
    """One row a document row: doc_id, lang, text_key, the counts, nats, word_nats, base_failed, kept."""
    model = learn(docs)
    found = _word_scores(docs, measured(docs, model))
    bands = _bands(found, "nats")
    half = SHARE * F.col("middle") + NOISE * F.col("noise") / F.sqrt(F.greatest("n_words", F.lit(1)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    columns = ["doc_id", "lang", "text_key", *COUNTS, "nats", "word_nats"]
    banded = stored(found.join(small(bands, 100_000), "lang", "left").select(*columns, "word_failed", failed.alias("base_failed"), (F.col("middle") - half).alias("low"), (F.col("middle") + half).alias("high")), "banded")
    above = stored(banded.filter(~F.col("base_failed") & (F.col("nats") > F.col("high"))).select("doc_id", "lang", "text_key"), "above")
    looked = stored(_second_look(docs, model, above), "secondLook").select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_key").alias("_key"), "switched")
    joined = banded.join(small(looked, 1_000_000), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("text_key") == F.col("_key")), "left")
    inside = F.coalesce((F.col("nats") >= F.col("low")) & (F.coalesce("switched", "nats") <= F.col("high")), F.lit(True))
    return joined.select(*columns, "base_failed", (~F.col("base_failed") & ~F.col("word_failed") & inside).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without those rejected. The verdict depends on text and language alone, so rows are
    matched by id, language and text and repeated rows fare alike."""
    id_, lang, key = fresh(docs.columns, "_id", "_lang", "_key")
    rejected = verdicts(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("lang").alias(lang), F.col("text_key").alias(key)).distinct()
    rejected = small(stored(rejected, "rejected"), 2_000_000)
    return docs.join(rejected, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.coalesce(docs["lang"], F.lit("")) == F.col(lang)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")
