"""Secret scans: three plain patterns, and a randomness test battery for what has no pattern.

Battery. Every run of 20 or more characters that an encoding could have made is a candidate; its
characters tell the encoding (hexadecimal, base32, base62, base64, base64url, letters of one case). A run
that fits none, as where a path leads to a key, is cut at its separators, and parts of 20 or more
are candidates. Three statistics are taken of each: chi-squared of the symbol counts, the number of
runs, and the serial correlation at lag one. Against uniform symbols a candidate that is off by
``VETO`` standard errors in one is not random. Against text, in which symbols are uneven, runs of a
class of characters are long and neighbours are alike, each gives a p-value; the three are combined
by Fisher's rule. The false-discovery control is Benjamini and Hochberg's over all candidates of one
encoding and length band, as a short string can show less than a long one.

Only DataFrame functions run here. One pass over the texts writes the matches with their lengths
and gaps; places follow by running sums, so a text with many matches costs no more than linearly.
The table of thresholds has at most encodings x bands rows, so its broadcast is bounded.

Null or empty texts have no span; every input row, repeated or not, gives one result row, and an
empty table none. Candidates of equal p-value are found or left together. Offsets count code points,
ends are exclusive. Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.llm.shared import fresh, small, stored

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs shorter than 24 fail in any case, and a run's match starts at its start: the same spans, faster.
HEX_FOUND = r"[0-9a-f]{24,}+"
RANDOM = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")
#: Encoding: what its strings look like, symbols, the first character of the alphabet's upper half.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, "8"),
    "upper": (r"^[A-Z]+$", 26, "N"),
    "base32": (r"^[A-Z2-7]+=*$", 32, "K"),
    "lower": (r"^[a-z]+$", 26, "n"),
    "base62": (r"^[A-Za-z0-9]+$", 62, "V"),
    "base64": (r"^[A-Za-z0-9+/]+=*$", 64, "V"),
    "base64url": (r"^[A-Za-z0-9_-]+=*$", 64, "V"),
}
#: Parts of a run that fits no encoding.
PART = r"[A-Za-z0-9+]{20,}+"
BANDS = (24, 32, 48, 96)
VETO = 3.3
#: Of text: how much more often than uniform symbols two are equal; and, by encoding, the changes of
#: character class a step and the correlation of neighbours. None where text of that look has no classes.
TEXT_COINCIDENCE = 1.73
TEXT_CHANGES = {"hex": 0.25, "upper": None, "base32": 0.08, "lower": None, "base62": 0.25, "base64": 0.25, "base64url": 0.25}
TEXT_SERIAL = {"hex": 0.3, "upper": None, "base32": 0.3, "lower": None, "base62": 0.3, "base64": 0.3, "base64url": 0.3}
FALSE_DISCOVERIES = 0.01
#: Texts with spans that may be broadcast to be cut.
MOST_BROADCAST = 200_000


def _matches(text: Column, kind: str, pattern: str, passes: Column | None, group: int = 0) -> Column:
    """array<struct<kind, i, gap, len, ok, token>>: the matches in order; gap counts the characters
    between the match before and this one. The text is matched again only where there is a match."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("g"), tested.alias("t"))
    as_hits = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(z["g"]).alias("gap"),
            F.length(z["m"]).alias("len"),
            (F.lit(True) if passes is None else F.length(z["t"]) >= passes).alias("ok"),
            (z["m"] if kind == "random" else F.lit(None).cast("string")).alias("token"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,len:int,ok:boolean,token:string>>")
    return F.when(text.rlike(pattern), as_hits).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hits) for every row, stored: the one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    hits = F.concat(
        _matches(text, "assign", ASSIGN, F.lit(6), group=2),
        _matches(text, "access", ACCESS, F.lit(20)),
        _matches(text, "hex", HEX_FOUND, F.lit(24)),
        _matches(text, "random", RANDOM, None),
    )
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", hits.alias("hits")), "secretHits")


def placed(scanned: DataFrame) -> DataFrame:
    """(row, kind, start, end, token) of the matches that hold."""
    hit = scanned.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    before = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    ends = hit.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    return ends.filter("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "token")


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), after Abramowitz and Stegun 26.2.17; one half at most, as for negative z."""
    z = F.greatest(z, F.lit(0.0))
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) * 0.3989422804 * poly, F.lit(1e-300))


def _of_encoding(values: dict) -> Column:
    """What a table by encoding says of the column ``encoding``."""
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(F.col("encoding") == name, F.lit(value).cast("double")).otherwise(out)
    return out


def _fits_none(token: Column) -> Column:
    bare = F.regexp_replace(token, "=+$", "")
    fits = F.lit(False)
    for shape, _, _ in ENCODINGS.values():
        fits = fits | bare.rlike(shape)
    return ~fits


def parted(candidates: DataFrame) -> DataFrame:
    """candidates (row, start, end, token), those that fit no encoding as their parts."""
    odd = candidates.filter(_fits_none(F.col("token"))).withColumn("h", F.explode(_matches(F.col("token"), "random", PART, None))).select("row", F.col("start").alias("from"), "h.*")
    before = W.partitionBy("row", "from").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed_ = odd.withColumn("end", F.col("from") + F.sum(F.col("gap") + F.col("len")).over(before))
    parts = placed_.select("row", (F.col("end") - F.col("len")).alias("start"), "end", "token")
    return candidates.filter(~_fits_none(F.col("token"))).unionByName(parts)


def battery(candidates: DataFrame) -> DataFrame:
    """candidates (with ``token``) + encoding, band, vetoed, p: the battery's verdict on each."""
    encoding, symbols, middle = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (shape, k, half) in reversed(ENCODINGS.items()):
        fits = F.col("bare").rlike(shape)
        encoding, symbols, middle = (F.when(fits, F.lit(v)).otherwise(c) for v, c in ((name, encoding), (float(k), symbols), (half, middle)))
    bare = F.regexp_replace("token", "=+$", "")
    df = candidates.withColumn("bare", bare).withColumn("n", F.length("bare").cast("double"))
    df = df.filter(F.col("bare").rlike("[A-Za-z]")).withColumn("encoding", encoding).withColumn("k", symbols).withColumn("half", middle).filter("encoding IS NOT NULL")
    df = df.withColumn("chars", F.split("bare", "")).withColumn("codes", F.transform("chars", lambda c: F.ascii(c).cast("double")))
    df = df.withColumn("band", F.aggregate(F.array(*map(F.lit, BANDS)), F.lit(0), lambda b, least: b + (F.col("n") >= least).cast("int")))
    zero = F.lit(0.0)
    counts = F.transform(F.array_distinct("chars"), lambda c: F.col("n") - F.length(F.replace(F.col("bare"), c, F.lit(""))))
    df = df.withColumn("squares", F.aggregate(counts, zero, lambda a, c: a + c * c)).withColumn("mean", F.aggregate("codes", zero, lambda a, v: a + v) / F.col("n"))
    nxt = F.slice("codes", 2, F.size("codes") - 1)
    most = F.slice("codes", 1, F.size("codes") - 1)
    kind = lambda v: F.when(v.between(48, 57), 0).when(v.between(65, 90), 1).when(v.between(97, 122), 2).otherwise(3)
    high = lambda v: v >= F.ascii("half")
    add = lambda a, v: a + v
    as_double = lambda c: c.cast("double")
    df = (
        df.withColumn("spread", F.aggregate(F.transform("codes", lambda v: (v - F.col("mean")) * (v - F.col("mean"))), zero, add))
        .withColumn("lagged", F.aggregate(F.zip_with(most, nxt, lambda a, b: (a - F.col("mean")) * (b - F.col("mean"))), zero, add))
        .withColumn("runs", 1 + F.aggregate(F.zip_with(most, nxt, lambda a, b: as_double(high(a) != high(b))), zero, add))
        .withColumn("changes", F.aggregate(F.zip_with(most, nxt, lambda a, b: as_double(kind(a) != kind(b))), zero, add))
        .withColumn("above", F.aggregate(F.transform("codes", lambda v: as_double(high(v))), zero, add))
    )
    n, k = F.col("n"), F.col("k")
    # Against uniform symbols.
    chi = k / n * F.col("squares") - n
    chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
    expected = 2 * F.col("above") * (n - F.col("above")) / n + 1
    runs_z = F.coalesce(F.try_divide(F.col("runs") - expected, F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), zero))), F.lit(99.0))
    serial = F.coalesce(F.try_divide(F.col("lagged"), F.col("spread")), F.lit(1.0))
    # Against text: chi-squared counts equal pairs, whose number in text is near a Poisson one.
    as_text = TEXT_COINCIDENCE / k * n * (n - 1) / 2
    pairs = (chi + n - k) * n / (2 * k)
    of_chi = _upper_tail((as_text - pairs - 0.5) / F.sqrt(as_text))
    rate, tied = _of_encoding(TEXT_CHANGES), _of_encoding(TEXT_SERIAL)
    of_runs = F.when(rate.isNull(), 1.0).otherwise(_upper_tail((F.col("changes") - 0.5 - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1))))
    of_serial = F.when(tied.isNull(), 1.0).otherwise(_upper_tail((tied - serial) * F.sqrt(n) / F.sqrt(1 - tied * tied)))
    y = -F.log(of_chi) - F.log(of_runs) - F.log(of_serial)
    vetoed = (chi_z > VETO) | (F.abs(runs_z) > VETO) | (F.abs(serial * F.sqrt(n)) > VETO)
    return df.withColumn("vetoed", vetoed).withColumn("p", F.greatest(F.exp(-y) * (1 + y + y * y / 2), F.lit(1e-300))).select(*candidates.columns, "encoding", "band", "vetoed", "p")


def discoveries(tested: DataFrame, q: float = FALSE_DISCOVERIES) -> DataFrame:
    """The tested candidates that hold at false-discovery rate ``q`` within encoding and band. Ranks
    come from counts of p-values in steps of a tenth of a nat, so no sort of all candidates."""
    level = F.least(F.floor(-10 * F.log("p")), F.lit(7000)).cast("int")
    by = W.partitionBy("encoding", "band")
    steps = tested.groupBy("encoding", "band", level.alias("level")).agg(F.count("*").alias("c"))
    held = steps.withColumn("m", F.sum("c").over(by)).withColumn("upto", F.sum("c").over(by.orderBy(F.desc("level")).rowsBetween(W.unboundedPreceding, 0)))
    least = held.filter(F.exp(-F.col("level") / 10.0) * F.col("m") / F.col("upto") <= q).groupBy("encoding", "band").agg(F.min("level").alias("least"))
    return tested.join(F.broadcast(least), ["encoding", "band"]).filter((level >= F.col("least")) & ~F.col("vetoed"))


def secret_spans(docs: DataFrame, q: float = FALSE_DISCOVERIES) -> tuple[DataFrame, DataFrame]:
    """(scanned, spans): spans has (row, kind, start, end); a random span that a base span of the same
    text covers is left out."""
    scanned = scan(docs)
    every = stored(placed(scanned), "secretPlaces")
    base = every.filter("kind <> 'random'").select("row", "kind", "start", "end")
    tested = stored(battery(parted(every.filter("kind = 'random'").select("row", "start", "end", "token"))), "secretTests")
    found = discoveries(tested, q).select("row", "start", "end")
    covers = base.select("row", F.col("start").alias("from"), F.col("end").alias("to"))
    fresh = found.join(covers, (found["row"] == covers["row"]) & (found["start"] >= covers["from"]) & (found["end"] <= covers["to"]), "left_anti")
    return scanned, base.unionByName(fresh.withColumn("kind", F.lit("random")))


def scan_secrets(docs: DataFrame, q: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row a document row: doc_id, counts of the base kinds and of random spans, and ``found``,
    the spans by start, then kind as listed."""
    scanned, spans = secret_spans(docs, q)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = spans.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("found"),
    )
    empty = F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string>>")
    out = scanned.select("row", "doc_id").join(per_row, "row", "left")
    return out.select("row", "doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS], F.coalesce("found", empty).alias("found"))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", q: float = FALSE_DISCOVERIES) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced; overlapping spans become one mark. No row
    goes, and a text without spans stays as it is."""
    # What a text holds depends on the text alone, so rows are matched by id and text.
    id_, key, cuts_ = fresh(docs.columns, "_id", "_key", "_cuts")
    both = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    scanned, spans = secret_spans(docs.select(both.alias("doc_id"), "text"), q)
    order = W.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    joined = spans.withColumn("fresh", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("g", F.sum("fresh").over(order))
    cuts = joined.groupBy("row", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts_))
    cuts = cuts.join(scanned.select("row", "doc_id.*"), "row").select(F.col("id").alias(id_), F.col("key").alias(key), cuts_).dropDuplicates([id_, key])
    cuts = small(stored(cuts, "cuts"), MOST_BROADCAST)
    from_ = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(cuts_, i)["end"])
    pieces = F.transform(cuts_, lambda c, i: F.substring("text", (from_(i) + 1).cast("int"), (c["start"] - from_(i)).cast("int")))
    last = F.element_at(cuts_, -1)["end"].cast("int")
    cleaned = F.concat(F.array_join(F.concat(pieces, F.array(F.lit(""))), mark), F.substring("text", last + 1, F.length("text")))
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(key))
    return docs.join(cuts, same, "left").withColumn("text", F.when(F.col(cuts_).isNull(), F.col("text")).otherwise(cleaned)).select(*docs.columns)
