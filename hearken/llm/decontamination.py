"""Benchmark decontamination: a positional inverted index, searched from the rarest terms.

The documents' words are stored once, with their places. From them come the postings
(term, document, position) of those terms that the search needs: of every benchmark window its
``RAREST`` rarest words by their frequency over all documents. A posting at place p of a word
that stands at place q of an item lies on the diagonal p - q, which is the offset adjustment; the
lists meet in a grouping by (item, document, diagonal), which keeps one bit for each place, and a
window is a candidate where the bits of all its rare words are set. The words between them are
compared at last, so matches are exact.

Only DataFrame functions run here. Broadcasts hold benchmark words and are checked by rows and bytes;
beyond the bounds the same joins shuffle. Nulls: a null text has no words, a null item text has
no window, a null item_id counts as a hit but is not listed. Each input row gets one result row,
so repeated rows and repeated ids give repeated results. Words of equal frequency go by their place.
Empty tables give empty results or no hits; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.llm.shared import ascii_lower, fresh, small, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
RAREST = 3
#: Windows of one section of an item.
SECTION = 64
#: Rows of benchmark terms (a word and a count each) that may be broadcast; about 100 MB at most.
MOST_BROADCAST = 1_000_000
#: As much for rows with arrays of windows: an item's, or a document's candidates.
MOST_ARRAYS = 20_000


def words(text: Column) -> Column:
    split = F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")
    return F.coalesce(split, F.array().cast("array<string>"))


def forward_store(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, n_words, words), written once: every later pass reads the columns it needs."""
    return stored(
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("words")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "text_key", F.size("words").cast("long").alias("n_words"), "words"
        ),
        "forward",
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, item_words, start, length): every run of ``window`` words, or a shorter item whole.
    A long item is cut into sections of ``SECTION`` windows, each an item of its own with the words of its
    windows alone, so rows are of one size whatever the item's."""
    n = F.size("all")
    sections = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)), F.lit(SECTION))
    cut = F.transform(sections, lambda at: F.slice("all", at + 1, SECTION + window - 1))
    whole = benchmark.select("item_id", words(F.col("text")).alias("all")).filter(n > 0)
    items = stored(whole.select("item_id", F.explode(cut).alias("item_words")).select(F.monotonically_increasing_id().alias("item"), "item_id", "item_words"), "items")
    n = F.size("item_words")
    return items.select("item", "item_id", "item_words", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("start"), F.least(n, F.lit(window)).alias("length"))


def term_counts(forward: DataFrame, terms: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(term, tf) over all documents for those ``terms`` that occur at all."""
    return forward.select(F.explode("words").alias("term")).join(small(terms, most_broadcast), "term").groupBy("term").agg(F.count("*").alias("tf"))


def rare_terms(windows: DataFrame, counts: DataFrame, rarest: int = RAREST) -> DataFrame:
    """windows + rare: the places in the item of each window's rarest words. A window with a word
    that no document has is gone: it cannot occur."""
    placed = windows.select("item", "start", "length", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("q"), "item_words").withColumn("term", F.element_at("item_words", F.col("q") + 1))
    ranked = placed.drop("item_words").join(counts, "term").withColumn("rank", F.row_number().over(W.partitionBy("item", "start").orderBy("tf", "q")))
    chosen = (
        ranked.groupBy("item", "start", "length")
        .agg(F.count("*").alias("known"), F.array_sort(F.collect_list(F.when(F.col("rank") <= rarest, F.col("q")))).alias("rare"))
        .filter(F.col("known") == F.col("length"))
    )
    return windows.join(chosen.select("item", "start", "rare"), ["item", "start"])


def postings(forward: DataFrame, terms: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The index: (term, row, p), every place p where one of ``terms`` stands in document row ``row``."""
    return forward.select("row", F.posexplode("words").alias("p", "term")).join(small(terms, most_broadcast), "term")


def _bit(place: Column) -> Column:
    """Places 64 apart share a bit; the words are compared later, so a shared bit costs only work."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def _met(probes: DataFrame, index: DataFrame, most_broadcast: int) -> DataFrame:
    """(item, row, diagonal, met): a bit for each probed item place whose posting lies on the
    diagonal. A document's postings are in one task, so its groups are summed before the shuffle."""
    return (
        index.join(small(probes, most_broadcast), "term")
        .groupBy("item", "row", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.bit_or(_bit(F.col("q"))).alias("met"), F.min("fewest").alias("fewest"))
        .filter(F.bit_count("met") >= F.col("fewest"))
        .drop("fewest")
    )


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(forward store, matches). A match: (row, item_id, start, length), an exact occurrence of a
    window of the item at word ``start`` of the document."""
    forward = forward_store(docs)
    windows = item_windows(benchmark, window)
    terms = stored(windows.select(F.explode("item_words").alias("term")).distinct(), "terms")
    counts = stored(term_counts(forward, terms, most_broadcast), "counts")
    chosen = stored(rare_terms(windows, counts, rarest), "windows")
    bits = F.aggregate("rare", F.lit(0).cast("long"), lambda bits, q: bits.bitwiseOR(_bit(q)))
    chosen = chosen.withColumn("bits", bits)
    probes = chosen.select("item", "item_words", F.explode("rare").alias("q"), F.bit_count("bits").alias("k"))
    probes = stored(probes.groupBy("item", "q", F.element_at("item_words", F.col("q") + 1).alias("term")).agg(F.min("k").alias("fewest")), "probes")
    index = stored(postings(forward, probes.select("term").distinct(), most_broadcast), "postings")
    # One row an item; a window is a candidate on a diagonal where all its rare places have met.
    per_item = stored(chosen.groupBy("item", "item_id", "item_words").agg(F.collect_list(F.struct("start", "length", "bits")).alias("windows")), "perItem")
    candidates = (
        _met(probes, index, most_broadcast)
        .join(small(per_item, MOST_ARRAYS), "item")
        .withColumn("windows", F.filter("windows", lambda w: (w["start"] + F.col("diagonal") >= 0) & (w["bits"].bitwiseAND(F.col("met")) == w["bits"])))
        .filter(F.size("windows") > 0)
        .groupBy("row")
        .agg(F.collect_list(F.struct("item_id", "item_words", "diagonal", "windows")).alias("candidates"))
    )
    candidates = stored(candidates, "candidates")
    at = lambda c, w: c["diagonal"] + w["start"]
    same = lambda c, w: F.slice(F.col("words"), at(c, w) + 1, w["length"]) == F.slice(c["item_words"], w["start"] + 1, w["length"])
    checked = F.flatten(F.transform("candidates", lambda c: F.transform(F.filter(c["windows"], lambda w: same(c, w)), lambda w: F.struct(c["item_id"].alias("item_id"), at(c, w).alias("start"), w["length"].alias("length")))))
    matches = forward.select("row", "words").join(small(candidates, MOST_ARRAYS), "row").select("row", F.explode(checked).alias("m")).select("row", "m.*")
    return forward, matches


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 3, window: int = WINDOW, rarest: int = RAREST, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(row, doc_id, item_id, start): a window's rare words all present near each other, each at most
    ``slop`` words off its place relative to the rarest one. Insertions and changed words in
    between, which an exact phrase misses, still match."""
    forward = forward_store(docs)
    windows = item_windows(benchmark, window)
    terms = stored(windows.select(F.explode("item_words").alias("term")).distinct(), "terms")
    chosen = stored(rare_terms(windows, stored(term_counts(forward, terms, most_broadcast), "counts"), rarest), "windows")
    probe = chosen.select("item", "item_id", "start", "item_words", F.posexplode("rare").alias("rank", "q"), F.size("rare").alias("k")).withColumn("term", F.element_at("item_words", F.col("q") + 1)).drop("item_words")
    index = stored(postings(forward, probe.select("term").distinct(), most_broadcast), "postings")
    placed = index.join(small(stored(probe, "probe"), most_broadcast), "term").select("row", "item", "item_id", "start", "rank", "k", "p", "q").withColumn("d", F.col("p") - F.col("q"))
    first = placed.filter("rank = 0").select("row", "item", "start", F.col("d").alias("d0"))
    # The band |d - d0| <= slop as an equi-join: both sides in blocks of slop + 1, one side in three.
    width = slop + 1
    block = lambda c: F.floor(F.col(c) / width)
    near = (
        first.withColumn("block", F.explode(F.array(block("d0") - 1, block("d0"), block("d0") + 1)))
        .join(placed.withColumn("block", block("d")), ["row", "item", "start", "block"])
        .filter(F.abs(F.col("d") - F.col("d0")) <= slop)
        .groupBy("row", "item", "item_id", "start", "d0", "k")
        .agg(F.countDistinct("rank").alias("met"))
        .filter("met = k")
    )
    return near.select("row", "item_id", (F.col("d0") + F.col("start")).alias("start")).distinct().join(forward.select("row", "doc_id"), "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document row: doc_id, n_words, n_hit, items (ids with an occurring window, sorted as
    strings), items_sha256, contaminated."""
    forward, matches = phrase_matches(docs, benchmark, window)
    found = matches.groupBy("row").agg(
        F.collect_set(F.struct("start", "length")).alias("runs"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    hit = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))))
    none = F.array().cast("array<string>")
    out = forward.select("row", "doc_id", "n_words").join(found.select("row", hit.cast("long").alias("n_hit"), "items"), "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
    ).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "items",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark. What a text holds depends on the
    text alone, so rows are matched by id and text, and repeated rows fare alike."""
    forward, matches = phrase_matches(docs, benchmark, window)
    id_, key = fresh(docs.columns, "_id", "_key")
    hit = forward.join(matches.select("row").distinct(), "row", "left_semi").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    hit = small(stored(hit, "contaminated"), MOST_BROADCAST)
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")
