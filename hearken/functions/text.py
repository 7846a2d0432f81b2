"""Text functions: normalization, similarities and phoneme sequences, as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def normalized(text: Column) -> Column:
    """Lower case without anything but letters, digits, underscores and white space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def tokens(text: Column) -> Column:
    """array<struct<raw, token>> of words whose normal form is not empty; words that normalize to nothing
    close up. Both arrays come from one pass over the whole text: words without a letter, digit or
    underscore are taken out first, so that the others keep their places in the normal form."""
    whole = F.coalesce(text, F.lit(""))
    raw = raw_words(F.regexp_replace(whole, r"(?<!\S)[^\p{L}\p{N}_\s]+(?!\S)", ""))
    return F.arrays_zip(raw.alias("raw"), raw_words(normalized(whole)).alias("token"))


def token_set(text: Column) -> Column:
    """Distinct ``[a-z']+`` tokens of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0)))


def keyword_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda k: F.trim(k)), lambda k: k != "")


def chunk_index(path: Column) -> Column:
    """The number before the extension, 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"_(\d+)\.[^./]*$", 1), F.lit("")).cast("int"), F.lit(0))


def keyword_of(path: Column) -> Column:
    """The keyword of a clip's file name: what follows the last hyphen, up to the index or extension. Of a
    name whose words are joined by hyphens that is the last word."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(_\d+)?\.[^.]*$", "")
    return F.substring_index(name, "-", -1)


def snippet(text: Column, most: int = 48) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def _bound(value: Column, use) -> Column:
    """``use`` on a value that is evaluated once, however often its folds look at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence by one row of the table after another, both folds in the JVM."""

    def table(pair: Column) -> Column:
        right = pair["b"]
        zeros = F.transform(F.concat(F.array(F.lit("")), right), lambda _: F.lit(0))

        def row(above: Column, x: Column) -> Column:
            cell = lambda cells, j: F.when(F.element_at(right, j) == x, F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(above, j + 1), F.element_at(cells, -1)))
            return F.aggregate(F.sequence(F.lit(1), F.size(right)), F.array(F.lit(0)), lambda cells, j: F.concat(cells, F.array(cell(cells, j))))

        return F.element_at(F.aggregate(pair["a"], zeros, row), -1)

    pair = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(_bound(pair, table))


def common_length(a: str, b: str) -> int:
    """Longest common subsequence with a row of the table in the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """100 * 2 LCS / (|a| + |b|); 100 for two empty texts. Meant for distinct pairs that lengths let
    through, to be joined back; ``lcs_length`` is the same in the JVM, for single columns."""
    for left, right in parts:
        yield pd.Series([200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0 for a, b in zip(left, right, strict=True)])


def least_edits(reference: Sequence, text: Sequence) -> int:
    """Edits between ``reference`` and the best part of ``text``, of letters or of tokens: a column of the
    table in the bits of two numbers (Myers)."""
    places: dict = {}
    for i, c in enumerate(reference):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(reference)) - 1, 1 << max(len(reference) - 1, 0)
    up, down, edits = every, 0, len(reference)
    best = edits
    for c in text:
        met = places.get(c, 0)
        across = (((met & up) + up) ^ up) | met
        more, less = down | (every & ~(across | up)), up & across
        edits += bool(more & last) - bool(less & last)
        best = min(best, edits)
        more, less = more << 1 & every, less << 1 & every
        up, down = less | (every & ~(met | down | more)), more & (met | down)
    return best


def _likeness(reference: Sequence | None, sequence: Sequence | None) -> float | None:
    """max(0, 1 - edits / |reference|) for the best part of ``sequence``; 0 where either is empty."""
    if reference is None or sequence is None:
        return None
    return max(0.0, 1 - least_edits(reference, sequence) / len(reference)) if len(reference) and len(sequence) else 0.0


@F.pandas_udf(DoubleType())
def infix_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of (reference, sequence), arrays of tokens; starting anywhere costs nothing, nor does what follows."""
    for references, sequences in parts:
        yield pd.Series([_likeness(a, b) for a, b in zip(references, sequences, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_infix_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of (references, sequence): the best of several references; 0 where there is none."""
    for references, sequences in parts:
        yield pd.Series([max([_likeness(r, b) or 0.0 for r in a], default=0.0) if a is not None else 0.0 for a, b in zip(references, sequences, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def infix_in_text(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``infix_similarity`` over the characters of two texts of any length; null for a null."""
    for references, texts in parts:
        done: dict[tuple, float | None] = {}
        for pair in zip(references, texts, strict=True):
            if pair not in done:
                done[pair] = _likeness(*pair)
        yield pd.Series([done[pair] for pair in zip(references, texts, strict=True)], dtype="float64")


def ctc_collapse(ids: Column, blank: Column | str = "") -> Column:
    """Drop repeats of the previous frame, then special tokens; a blank parts true repeats."""
    none = blank if isinstance(blank, Column) else F.lit(blank)
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), ids), 1, F.size(ids))
    pairs = F.arrays_zip(ids.alias("x"), before.alias("p"))
    kept = F.filter(pairs, lambda z: ~z["x"].eqNullSafe(z["p"]) & ~z["x"].startswith("<") & (z["x"] != "|") & (z["x"] != none))
    return F.transform(kept, lambda z: z["x"])


_VOWELS = "AEIOU"


def metaphone(word: str) -> str:
    """The classic Metaphone code, after the published rules."""
    w = re.sub(r"[^A-Z]", "", unicodedata.normalize("NFD", word).upper())
    w = re.sub(r"([^C])\1+", r"\1", w)
    if w[:2] in ("KN", "GN", "PN", "AE", "WR"):
        w = w[1:]
    elif w[:1] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    code, i = [], 0
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    while i < len(w):
        c, nxt = w[i], at(i + 1)
        if c in _VOWELS:
            code += [c] if i == 0 else []
        elif c == "B":
            code += [] if i == len(w) - 1 and at(i - 1) == "M" else ["B"]
        elif c == "C":
            if nxt == "I" and at(i + 2) == "A" or (nxt == "H" and at(i - 1) != "S"):
                code.append("X")
            elif nxt in ("I", "E", "Y") and nxt:
                code += [] if at(i - 1) == "S" else ["S"]
            else:
                code.append("K")
            i += nxt == "H"
        elif c == "D":
            soft = nxt == "G" and at(i + 2) in ("E", "I", "Y") and at(i + 2) != ""
            code.append("J" if soft else "T")
            i += soft
        elif c == "G":
            silent = (nxt == "H" and i + 2 < len(w) and at(i + 2) not in _VOWELS) or (nxt == "N" and (i + 2 == len(w) or w[i + 2 :] == "ED"))
            if not silent:
                code.append("J" if nxt in ("I", "E", "Y") and nxt else "K")
            i += nxt == "H"
        elif c == "H":
            if nxt in _VOWELS and nxt and at(i - 1) not in ("C", "S", "P", "T", "G"):
                code.append("H")
        elif c == "K":
            code += [] if at(i - 1) == "C" else ["K"]
        elif c == "P":
            code.append("F" if nxt == "H" else "P")
            i += nxt == "H"
        elif c == "Q":
            code.append("K")
        elif c == "S":
            hush = nxt == "H" or (nxt == "I" and at(i + 2) in ("O", "A") and at(i + 2) != "")
            code.append("X" if hush else "S")
            i += nxt == "H"
        elif c == "T":
            if nxt == "I" and at(i + 2) in ("O", "A") and at(i + 2):
                code.append("X")
            elif nxt == "H":
                code.append("0")
                i += 1
            elif not (nxt == "C" and at(i + 2) == "H"):
                code.append("T")
        elif c == "V":
            code.append("F")
        elif c in ("W", "Y"):
            code += [c] if nxt in _VOWELS and nxt else []
        elif c == "X":
            code += ["K", "S"]
        elif c == "Z":
            code.append("S")
        else:
            code.append(c)
        i += 1
    return "".join(code)


@F.pandas_udf(StringType())
def metaphone_code(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Meant for distinct tokens, to be joined back."""
    for words in parts:
        yield words.map(lambda w: None if w is None else metaphone(w))


def g2p_cleaned(text: Column, underscores: bool = True) -> Column:
    """Lower case, accents stripped, only letters and simple marks, abbreviations spelled out."""

    @F.pandas_udf(StringType())
    def stripped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))

    low = F.lower(stripped(text))
    low = F.replace(low, F.lit("_"), F.lit(" ")) if underscores else low
    kept = F.regexp_replace(low, r"[^ a-z'.,?!\-]", "")
    return F.replace(F.replace(kept, F.lit("i.e."), F.lit("that is")), F.lit("e.g."), F.lit("for example"))


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()


def spelled(n: int) -> str:
    """An integer in English words."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    for unit, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= unit:
            rest = n % unit
            return f"{spelled(n // unit)} {name}" + (f" {spelled(rest)}" if rest else "")
    raise AssertionError


def numbers_expanded(text: str) -> str:
    """Digits as words: separators, money, decimals, ordinals, then integers; years read in pairs."""
    text = re.sub(r"(\d),(?=\d)", r"\1", text)
    text = re.sub(r"£(\d+)", r"\1 pounds", text)

    def money(m: re.Match) -> str:
        whole, cents = int(m[1]), int((m[2] or "0")[:2].ljust(2, "0"))
        parts = [f"{whole} dollar{'s' * (whole != 1)}"] * bool(whole) + [f"{cents} cent{'s' * (cents != 1)}"] * bool(cents)
        return ", ".join(parts) or "zero dollars"

    text = re.sub(r"\$(\d+)(?:\.(\d+))?", money, text)
    text = re.sub(r"(\d+)\.(\d+)", lambda m: f"{m[1]} point {' '.join(m[2])}", text)

    def ordinal(m: re.Match) -> str:
        head, dash, tail = spelled(int(m[1])).rpartition("-") if "-" in spelled(int(m[1])) else spelled(int(m[1])).rpartition(" ")
        odd = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
        return head + dash + odd.get(tail, tail[:-1] + "ieth" if tail.endswith("y") else tail + "th")

    text = re.sub(r"(\d+)(?:st|nd|rd|th)\b", ordinal, text)

    def integer(m: re.Match) -> str:
        n = int(m[0])
        if 1000 < n < 3000 and n != 2000:
            if 2000 < n < 2010:
                return f"two thousand {spelled(n % 100)}"
            if n % 100 == 0:
                return f"{spelled(n // 100)} hundred"
            return f"{spelled(n // 100)} {'oh-' + spelled(n % 100) if n % 100 < 10 else spelled(n % 100)}"
        return spelled(n) if n < 10**15 else " ".join(spelled(int(d)) for d in m[0])

    return re.sub(r"\d+", integer, text)


@F.pandas_udf(StringType())
def numbers_as_words(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``numbers_expanded`` of a column; null for null."""
    for texts in parts:
        yield texts.map(lambda t: None if t is None else numbers_expanded(t))


#: The graphemes of the pronunciation model by id, three signs before the letters.
GRAPHEMES = ["<pad>", "<unk>", "</s>", *"abcdefghijklmnopqrstuvwxyz"]


def grapheme_ids(text: Column) -> Column:
    """Ids of a text's characters; those that the model does not have get the id of the unknown."""
    unknown, first = GRAPHEMES.index("<unk>"), GRAPHEMES.index("a")
    code = lambda c: F.ascii(c) - ord("a") + first
    return F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[a-z]$"), code(c)).otherwise(F.lit(unknown)))


def homographs(lines: Column) -> Column:
    """struct<head, first, second, pos> of a line HEAD|PRON1|PRON2|POS; null for comments and others."""
    parts = F.split(lines, r"\|")
    entry = F.struct(F.lower(F.trim(parts[0])).alias("head"), F.split(F.trim(parts[1]), " ").alias("first"), F.split(F.trim(parts[2]), " ").alias("second"), F.trim(parts[3]).alias("pos"))
    return F.when(~F.trim(lines).startswith("#") & (F.size(parts) == 4), entry)
