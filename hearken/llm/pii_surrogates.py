"""PII: every detected entity gets a surrogate of its own kind, the same wherever it stands.

Detection is one pattern over the kinds below, leftmost and without overlaps. A name is found by its
title, with all its parts: given names, initials, particles and family name. Persons of a text are told
apart by family name, given name and gender; a shorter titled form is the nearest person that fits, and
once a text has a titled name, its family and given names are that person wherever they stand in the
text, titled or not. An entity is its kind and canonical form
(letters in lower case, digits alone, a phone without its country code, a name's gender and words), so
mentions in other formats are the same entity. Its surrogate
follows from a keyed hash of that form: digits for digits, letters of the same case for letters,
separators, country codes and top-level domains kept, a valid check digit where the card had one;
names get given names of the title's gender and family names made of syllables, in the script of
the original. Collision checks: where two entities get one surrogate, or a surrogate is an entity of
the corpus, all but the least form hash again with the next counter, until none is left, so
distinct entities stay distinct and no one's data becomes another's.

Only DataFrame functions run here. The mapping has a row for each distinct entity, is made by sums
before the shuffle, and joins with skew handling or, up to ``MOST_BROADCAST`` rows, a broadcast, so
an address in a third of all texts is no single task. Texts without entities are not shuffled.

Null and empty texts stay as they are. Each input row gives one result row, also repeated ones, and
an empty table none. Of two persons of a text with one given or family name, a bare mention is the
one named last before it. Words beside numbers, as in dates, are no names. Input columns n_entities and kinds are replaced by the results; other names do not
matter. Not covered: names that no title introduces in their text, and street addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearken.llm.shared import small, stored

MOST_BROADCAST = 500_000
ROUNDS = 40

# Titles by gender, given names by gender and script, syllables by script.
MALE = "Mr|Herr|Herrn|Señor|Sr|Monsieur|Sir|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа|Κυρία"
#: Of either gender: other mentions or the given name may say which.
NEUTRAL = "Dr|Prof|Professor|Доктор"
#: Names of months that may be persons' too, and what stands before a time.
MONTHS = "april august january july june march may september october november december february"
TIMES = "in|since|until|till|last|next|this|early|late|mid|every|each|during"
PARTICLES = "von|van|der|den|de|del|della|da|di|du|la|le|ter|zu"
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Robin Simon Tomas Victor",
    ("latin", "f"): "Anna Berta Clara Diana Elena Frida Greta Helena Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга",
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος Χρήστος",
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ge ha he ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te va ve wa we",
    "cyrillic": "ба бе ви во га да де жа за ка ки ла ле ма ми на не по ра ро са се та ти",
    "greek": "βα γα δα θα κα κο λα λε μα με να νι πα πε ρα ρο σα σε τα τι",
}

TITLES = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.?"
#: A part of a name: an initial, or a capital and letters, with inner capitals after a mark.
_PART = r"\p{Lu}(?:\.|\p{L}*(?:['’-]\p{L}+)*)"
_NAME = rf"(?<!\p{{L}}){TITLES}(?:\x20{TITLES})*+(?:\x20(?:(?:{PARTICLES})\x20)*{_PART})+(?!\p{{L}})"
#: Words that may be a name's where the text has a titled one.
_WORD = r"(?<![\p{L}'’-])\p{Lu}\p{L}*(?:['’-]\p{L}+)*(?![\p{L}])"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ip6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d+])(?:\d{4}[\x20-]?){3}\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{3}\)[\x20.-]?|\d{3}[\x20.-])\d{3}[\x20.-]\d{4}|\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,4}|(?<![.-])[2-9]\d{2}[2-9]\d{6}(?![.-]?\w))(?!\d)",
    "name": _NAME,
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What any match has: texts without it are not searched.
HINT = rf"[0-9@:]|(?<!\p{{L}}){TITLES}\x20"


def kind_of(token: Column) -> Column:
    kind = F.lit("name")
    for name in ("phone", "ssn", "card", "iban", "ip6", "ip", "email"):
        shape = rf"^(?:{KINDS[name]})$"
        kind = F.when(token.rlike(shape), F.lit(name)).otherwise(kind)
    return kind


def _digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def canonical(kind: Column, token: Column) -> Column:
    digits = _digits(token)
    # A phone without country code: what follows it, or ten digits where it has no separator.
    local = F.when(F.length(digits) == 11, F.expr("right(regexp_replace(token, '[^0-9]', ''), 10)")).otherwise(digits)
    plain = F.upper(F.replace(token, F.lit(" "), F.lit("")))
    return F.when(kind.isin("email", "ip6"), F.lower(token)).when(kind == "iban", plain).when(kind == "phone", local).when(kind == "ip", token).otherwise(digits)


def _untitled(token: Column) -> Column:
    return F.regexp_replace(token, rf"^(?:{TITLES}\x20)+", "")


def _number(at: Column | int, below: Column | int) -> Column:
    """A number below ``below`` from four places of the hash (column ``h``), the at-th lot, around its end."""
    lot = F.substring(F.concat("h", "h"), (F.pmod(F.lit(3) * at, F.lit(61)) + 1).cast("int"), F.lit(4))
    return F.pmod(F.conv(lot, 16, 10).cast("long"), F.lit(below) if isinstance(below, int) else below).cast("int")


def _letters(text: Column, kept_from: Column) -> Column:
    """Letters for letters and digits for digits, up to place ``kept_from``; the rest as it is."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"

    def swap(c: Column, i: Column) -> Column:
        letter = F.substring(F.lit(alphabet), _number(i, 26) + 1, F.lit(1))
        digit = _number(i, 10).cast("string")
        return F.when(i >= kept_from, c).when(c.rlike("[a-z]"), letter).when(c.rlike("[0-9]"), digit).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _hexed(text: Column) -> Column:
    """Hexadecimal digits for hexadecimal digits; a group's first one is not nought."""
    signs = F.lit("0123456789abcdef")
    swap = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(signs, 2 + _number(i, 15), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _iban(plain: Column) -> Column:
    """Letters and digits for those after the check digits, and the check digits that these need."""
    letter = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    body = F.transform(F.split(F.substring(plain, F.lit(5), F.length(plain)), ""), lambda c, i: F.when(c.rlike("[0-9]"), _number(i, 10).cast("string")).otherwise(F.substring(letter, _number(i, 26) + 1, F.lit(1))))
    country = F.substring(plain, 1, 2)
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.concat(body, F.split(country, ""), F.array(F.lit("0"), F.lit("0"))), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), F.array_join(body, ""))


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo ten of an array of digits as text."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10


def _pick(words: Column, at: int) -> Column:
    return F.element_at(words, _number(at, F.size(words)) + 1)


def surrogate() -> Column:
    """The surrogate of columns kind, canonical and attempt, in canonical form; column ``h`` is the hash."""
    c = F.col("canonical")
    top = F.length(c) - F.length(F.substring_index(c, ".", -1))
    digits = F.transform(F.split(c, ""), lambda d, i: F.when(i == 0, 1 + _number(i, 9)).otherwise(_number(i, 10)).cast("string"))
    # The first digit names a card's issuer kind; the last makes the sum right, as it was.
    card = F.concat(F.array(F.substring(c, 1, 1)), F.slice(digits, 2, F.size(digits) - 2))
    check = F.pmod(-_luhn(F.concat(card, F.array(F.lit("0")))), F.lit(10)).cast("string")
    was_valid = _luhn(F.split(c, "")) == 0
    last = F.when(was_valid, check).otherwise(F.pmod(check.cast("int") + 1 + _number(17, 9), F.lit(10)).cast("string"))
    # Private addresses; where the corpus has more than those, any.
    octets = [F.when(F.col("attempt") < 3, F.lit(10)).otherwise(1 + _number(1, 223)), _number(2, 256), _number(3, 256), _number(4, 256)]
    parts = F.split(c, "/")
    script, gender, size = F.element_at(parts, 1), F.element_at(parts, 2), F.element_at(parts, 3).cast("int")
    given, family = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for (s, g), names in NAMES.items():
        given = F.when((script == s) & (gender == g), F.split(F.lit(names), " ")).otherwise(given)
    for s, syllables in SYLLABLES.items():
        family = F.when(script == s, F.split(F.lit(syllables), " ")).otherwise(family)
    made = F.array_join(F.transform(F.sequence(F.lit(0), 2 + F.col("attempt")), lambda i: F.element_at(family, _number(i + 5, F.size(family)) + 1)), "")
    name = F.when(size == 1, F.initcap(made)).otherwise(F.concat(_pick(given, 1), F.lit(" "), F.initcap(made)))
    return (
        F.when(F.col("kind") == "email", _letters(c, top))
        .when(F.col("kind") == "ip6", _hexed(c))
        .when(F.col("kind") == "iban", _iban(c))
        .when(F.col("kind") == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
        .when(F.col("kind") == "card", F.concat(F.array_join(card, ""), last))
        .when(F.col("kind") == "name", F.concat_ws("/", script, gender, size.cast("string"), F.lower(name)))
        .otherwise(F.array_join(digits, ""))
    )


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) of distinct (kind, canonical), without collisions; stored."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canonical", F.col("attempt").cast("string")), 256)
    known = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("is_entity"))
    done, open_ = None, entities.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        made = stored(open_.withColumn("h", hashed).withColumn("surrogate", surrogate()).drop("h"), "surrogates")
        taken = known if done is None else known.unionByName(done.select("kind", "surrogate", F.lit(True).alias("is_entity")))
        first = made.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        judged = made.join(first, ["kind", "surrogate"]).join(taken.distinct(), ["kind", "surrogate"], "left")
        good = F.col("is_entity").isNull() & (F.col("canonical") == F.col("first"))
        judged = stored(judged.select("kind", "canonical", "surrogate", "attempt", good.alias("good")), "judged")
        fresh = judged.filter("good").select("kind", "canonical", "surrogate")
        done = fresh if done is None else done.unionByName(fresh)
        open_ = judged.filter("NOT good").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return done
    raise ValueError(f"collisions left after {ROUNDS} rounds: a kind has more entities than surrogates")


def render(kind: Column, token: Column, made: Column, part: Column) -> Column:
    """The canonical surrogate in the mention's format; of a name's, the part that is mentioned."""
    chars = F.split(token, "")
    before = lambda i, sign: F.length(F.regexp_replace(F.substring(token, F.lit(1), i), sign, ""))
    kept = F.length(_digits(token)) - F.length(made)
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(~c.rlike("[0-9]") | (before(i, "[^0-9]") < kept), c).otherwise(F.substring(made, (before(i, "[^0-9]") - kept + 1).cast("int"), F.lit(1)))), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, (before(i, " ") + 1).cast("int"), F.lit(1)))), "")
    cased = F.array_join(F.zip_with(chars, F.split(made, ""), lambda c, m: F.when(c.rlike("[A-Z]"), F.upper(m)).otherwise(m)), "")
    title = F.regexp_extract(token, rf"^(?:{TITLES}\x20)*", 0)
    whole = F.initcap(F.substring_index(made, "/", -1))
    name = F.when(part == "given", F.substring_index(whole, " ", 1)).when(part == "family", F.substring_index(whole, " ", -1)).otherwise(whole)
    shown = F.when(_untitled(token).rlike(r"^\p{Lu}[\p{Lu}\x20'’.-]+$"), F.upper(name)).otherwise(name)
    return F.when(kind.isin("email", "ip6"), cased).when(kind == "iban", spaced).when(kind == "ip", made).when(kind == "name", F.concat(title, shown)).otherwise(digits)


def _nearest(value: Column, by: list[str]) -> Column:
    """The last value that is not null in the rows of the group before this one by column i, else the first after."""
    before = lambda order: F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(before(F.col("i").asc()), before(F.col("i").desc()))


def _guessed(name: Column) -> Column:
    """A gender where no title says one: that of a known given name, else one by the name's letters."""
    known = {g: [n.lower() for (_, x), names in NAMES.items() if x == g for n in names.split()] for g in "fm"}
    return F.when(name.isin(known["f"]), "f").when(name.isin(known["m"]), "m").otherwise(F.when(F.crc32(name) % 2 == 0, "f").otherwise("m"))


def _persons(every: DataFrame) -> DataFrame:
    """Of titled mentions (_row, i, kind, token): (_row, i, token, kind, ws, family, canonical, part), the person
    of each. A person of a text is a family name, a given name and a gender, which a title or another mention
    of the two names says. A mention without a given name, or with an initial, is the nearest earlier person
    of its family name, else the first later one, whose gender and initial fit; else a person of its own."""
    titles, bare = F.regexp_extract("token", rf"^(?:{TITLES}\x20)+", 0), _untitled(F.col("token"))
    says = lambda names: titles.rlike(rf"(?:^|\x20)(?:{names})\.?\x20")
    script = F.when(F.col("token").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("token").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    first = F.element_at("ws", 1)
    found = every.filter("kind = 'name'").select("_row", "i", "token", "kind", script.alias("script"), F.split(F.lower(bare), " ").alias("ws"), F.when(says(FEMALE), "f").when(says(MALE), "m").alias("says"))
    found = found.withColumn("family", F.element_at("ws", -1)).withColumn("given", F.when((F.size("ws") > 1) & ~first.isin(PARTICLES.split("|")), first))
    full = F.col("given").isNotNull() & ~F.col("given").endswith(".")
    of_name = F.when(full, F.coalesce("says", _nearest(F.col("says"), ["_row", "family", "given"]), _guessed(F.col("given"))))
    found = found.withColumn("known", of_name)
    there = F.when(F.col("known").isNotNull(), F.struct(F.col("known").alias("gender"), "given"))
    near = {g: _nearest(F.when(F.col("known") == g, there), ["_row", "family"]) for g in "fm"}
    near[""] = _nearest(there, ["_row", "family"])
    found = found.withColumns({f"near_{g}": c for g, c in near.items()} | {"near_says": _nearest(F.when(F.col("known").isNull(), F.col("says")), ["_row", "family"])})
    other = F.when(F.col("says") == "f", F.col("near_f")).when(F.col("says") == "m", F.col("near_m")).otherwise(F.col("near_"))
    fits = other.isNotNull() & (F.col("given").isNull() | (F.substring("given", 1, 1) == F.substring(other["given"], 1, 1)))
    own = F.struct(F.coalesce("says", "near_says", _guessed(F.col("family"))).alias("gender"), "given")
    found = found.withColumn("p", F.when(F.col("known").isNotNull(), F.struct(F.col("known").alias("gender"), "given")).when(fits, other).otherwise(own))
    # A person's canonical form is that of the mention with most names, the first of those.
    fullest = F.max_by("ws", F.struct(F.size("ws"), -F.col("i"))).over(W.partitionBy("_row", "family", "p"))
    size = F.when(F.col("p.given").isNull(), "1").otherwise("2")
    person = F.concat_ws("/", "script", "p.gender", size, F.array_join(fullest, " "))
    part = F.when(F.col("given").isNull(), "family").otherwise("whole")
    return stored(found.select("_row", "i", "token", "kind", "ws", "family", person.alias("canonical"), part.alias("part")), "persons")


def _bare(every: DataFrame, persons: DataFrame) -> DataFrame:
    """Of words that stand without a title (_row, i, token, kind, canonical, dated, beside): (_row, i, token,
    kind, canonical, part), a name's where a titled mention of the text has the word: the nearest earlier one,
    else the first later one. A family name right after a given name is of that person. A word with a number
    beside it, as a month's has, stays."""
    names = F.filter("ws", lambda w: ~w.isin(PARTICLES.split("|")) & ~w.endswith("."))
    parts = F.transform(names, lambda w: F.struct(w.alias("word"), F.when(w == F.col("family"), "family").otherwise("given").alias("part")))
    known = persons.select("_row", "i", "family", "canonical", F.explode(parts).alias("n")).select("_row", "i", F.col("n.word").alias("word"), F.struct("canonical", "family", F.col("n.part").alias("part")).alias("person"))
    words = every.filter("kind = 'word'")
    asked = words.join(known.select("_row", "word").distinct(), (words["_row"] == known["_row"]) & (words["canonical"] == known["word"]), "left_semi")
    both = known.withColumns({"token": F.lit(None).cast("string"), "dated": F.lit(False), "beside": F.lit(False)}).unionByName(asked.select("_row", "i", F.col("canonical").alias("word"), F.lit(None).cast(known.schema["person"].dataType).alias("person"), "token", "dated", "beside"))
    met = both.withColumn("near", _nearest(F.col("person"), ["_row", "word"])).filter(F.col("token").isNotNull() & ~F.col("dated"))
    # Given names hand their person on to the family name that follows.
    in_text = W.partitionBy("_row").orderBy("i")
    before = F.when((F.lag("i").over(in_text) == F.col("i") - 1) & F.col("beside"), F.lag("near").over(in_text))
    met = met.withColumn("before", before)
    person = F.when((F.col("before.part") == "given") & (F.col("before.family") == F.col("word")), F.struct(F.col("before.canonical").alias("canonical"), F.col("before.family").alias("family"), F.lit("family").alias("part"))).otherwise(F.col("near"))
    named = met.withColumn("person", person).select("_row", "i", "token", F.lit("name").alias("kind"), F.col("person.canonical").alias("canonical"), F.col("person.part").alias("part"))
    rest = words.join(named.select("_row", "i"), ["_row", "i"], "left_anti").select("_row", "i", "token", "kind", "canonical", F.lit("whole").alias("part"))
    return rest.unionByName(named)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the text's entities replaced, + n_entities and kinds (sorted, distinct)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("n_entities", "kinds")])
    found = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    clean = docs.filter(~found).withColumn("n_entities", F.lit(0).cast("long")).withColumn("kinds", F.array().cast("array<string>"))
    others = [c for c in docs.columns if c != "text"]
    # Where the text has a titled name, every word that could be a name's is looked at too.
    named = rf"{ANY}|(?:{_WORD})"
    cut_by = lambda pattern: F.struct(F.split("text", pattern, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("tokens"))
    cut = stored(
        docs.filter(found).select(
            F.monotonically_increasing_id().alias("_row"),
            F.struct(*[F.col(f"`{c}`") for c in others]).alias("_kept") if others else F.lit(None).cast("struct<a:int>").alias("_kept"),
            F.when(F.col("text").rlike(_NAME), cut_by(named)).otherwise(cut_by(ANY)).alias("_cut"),
        ),
        "withPii",
    )
    every = cut.select("_row", "_cut.gaps", F.posexplode("_cut.tokens").alias("i", "token"))
    bare = F.col("token").rlike(rf"^(?:{_WORD})$") & ~F.col("token").rlike(rf"^(?:{ANY})$")
    every = every.withColumn("kind", F.when(bare, "word").otherwise(kind_of(F.col("token"))))
    left, right = F.get("gaps", F.col("i")), F.get("gaps", F.col("i") + 1)
    dated = right.rlike(r"^\s*(?:,\s*)?\d") | left.rlike(r"\d(?:st|nd|rd|th|\.)?\s+(?:of\s+)?$") | (F.lower("token").isin(MONTHS.split()) & left.rlike(rf"(?i)(?<!\p{{L}})(?:{TIMES})\s+$"))
    every = every.select("_row", "i", "token", "kind", (bare & dated).alias("dated"), (left == " ").alias("beside"))
    every = stored(every.withColumn("canonical", F.when(F.col("kind") == "word", F.lower("token")).when(F.col("kind") != "name", canonical(F.col("kind"), F.col("token")))), "mentions")
    persons = _persons(every)
    titled = persons.select("_row", "i", "token", "kind", "canonical", "part")
    again = _bare(every, persons)
    plain = every.filter("kind NOT IN ('name', 'word')").select("_row", "i", "token", "kind", "canonical", F.lit("whole").alias("part"))
    mention = stored(plain.unionByName(titled).unionByName(again), "linked")
    table = mapping(stored(mention.filter("kind <> 'word'").select("kind", "canonical").distinct(), "entities"), key)
    shown = mention.filter("kind <> 'word'").join(small(table, MOST_BROADCAST), ["kind", "canonical"]).select("_row", "i", "kind", render(F.col("kind"), F.col("token"), F.col("surrogate"), F.col("part")).alias("new"))
    shown = shown.unionByName(mention.filter("kind = 'word'").select("_row", "i", F.lit(None).cast("string").alias("kind"), F.col("token").alias("new")))
    per_row = shown.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("i", "new"))).alias("_new"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("kind").alias("n_entities"))
    joined = cut.select("_row", "_kept", F.col("_cut.gaps").alias("_gaps")).join(per_row, "_row")
    pieces = F.transform("_gaps", lambda g, i: F.concat(g, F.coalesce(F.get("_new", i)["new"], F.lit(""))))
    changed = joined.select(*[F.col(f"_kept.`{c}`").alias(c) for c in others], F.array_join(pieces, "").alias("text"), "n_entities", "kinds")
    columns = [*docs.columns, "n_entities", "kinds"]
    return clean.select(columns).unionByName(changed.select(columns))
