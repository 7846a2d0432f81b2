import re

from hearken.llm import pii_surrogates as P
from tests.llm.data import SMALL

ROWS = [
    (1, "Write to Ann.Lee@Mail0.Example.com or +1 (269) 555-3296, not 269-555-3296."),
    (2, "ann.lee@mail0.example.com from 67.190.110.215 paid 4111 1111 1111 1111; again 4111111111111111."),
    (3, "Mr. John Miller met Mrs Clara Weiss. Господин Иван Петров. Señora López"),
    (4, None),
    (5, ""),
    (6, "nothing here, version 1.2.3 of 2024"),
    (7, "ann.lee@mail0.example.com"),
    (7, "ann.lee@mail0.example.com"),
    (8, "id 123-45-6789. " + "x" * 50000 + " a@b.org"),
]


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_surrogates(spark):
    docs = spark.createDataFrame([(*r, 9) for r in ROWS], "doc_id long, text string, token int")
    rows = P.replace_pii(docs, "key").collect()
    assert len(rows) == len(ROWS) and all(r["token"] == 9 for r in rows)
    out = {r["doc_id"]: r for r in rows}
    a, b = out[1]["text"], out[2]["text"]
    email = re.search(r"\S+@\S+", a)[0]
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\d\.[A-Z][a-z]{6}\.com", email) and email.lower() == b.split()[0] == out[7]["text"]
    phone, plain = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)[0], re.search(r"not (\d{3}-\d{3}-\d{4})\.", a)[1]
    assert re.sub(r"\D", "", phone)[1:] == re.sub(r"\D", "", plain) != "2695553296"
    spaced, joined = re.search(r"paid ((?:\d{4} ){3}\d{4});", b)[1], re.search(r"again (\d{16})\.", b)[1]
    assert spaced.replace(" ", "") == joined != "4111111111111111" and luhn(joined) and joined[0] == "4"
    assert re.search(r"from 10\.\d+\.\d+\.\d+ paid", b)
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+)\. Господин (\w+) (\w+)\. Señora (\w+)", out[3]["text"])
    assert names[1] in P.NAMES["latin", "m"].split() and names[3] in P.NAMES["latin", "f"].split() and names[5] in P.NAMES["cyrillic", "m"].split()
    assert re.fullmatch("[А-Яа-я]+", names[6]) and "López" not in out[3]["text"]
    assert out[4]["text"] is None and out[5]["text"] == "" and out[6]["text"] == ROWS[5][1]
    assert out[1]["n_entities"] == 3 and out[6]["n_entities"] == 0 and out[2]["kinds"] == ["card", "email", "ip"]
    assert "123-45-6789" not in out[8]["text"] and len(out[8]["text"]) == len(ROWS[8][1])
    other = {r["doc_id"]: r["text"] for r in P.replace_pii(docs, "other").collect()}
    assert other[7] != out[7]["text"]
    assert P.replace_pii(docs.limit(0), "key").count() == 0


def test_distinct_entities_stay_distinct(spark):
    """Forms with few surrogates must collide, and are told apart."""
    entities = spark.createDataFrame([("email", f"{c}{d}@x.org") for c in "abcdefgh" for d in range(10)] + [("ssn", f"{i:09d}") for i in range(50)], "kind string, canonical string")
    rows = P.mapping(entities, "k").collect()
    assert len(rows) == 130 == len({(r["kind"], r["surrogate"]) for r in rows})
    assert not {(r["kind"], r["surrogate"]) for r in rows} & {(r["kind"], r["canonical"]) for r in rows}


def test_small_table_has_no_entity_left(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in P.replace_pii(docs, "key").collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        for token in re.findall(r"[\w.]+@[\w.]+\.com|(?<![\d.])\d+\.\d+\.\d+\.\d+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)", text or ""):
            assert token not in after[i]["text"]
        if not after[i]["n_entities"]:
            assert after[i]["text"] == text


def replaced(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in sorted(P.replace_pii(docs, "key").collect(), key=lambda r: r["doc_id"])]


def test_mentions_of_a_person(spark):
    a, b, c, d = replaced(
        spark,
        "Frau Anna Keller called. Keller and Anna Keller left; KELLER too. Frau Keller is Kellers friend.",
        "Mrs Anna Maria Schmidt, Mr J. Smith, Mr O'Neil and Frau von Berg met Dr Otto Hahn.",
        "Mr John Smith and Mrs Jane Doe. John saw Doe. Smith, Jane.",
        "Keller has no title here.",
    )
    m = re.fullmatch(r"Frau (\w+) (\w+) called\. (\w+) and (\w+) (\w+) left; (\w+) too\. Frau (\w+) is Kellers friend\.", a)
    assert m and m[2] == m[3] == m[5] == m[7] != "Keller" and m[1] == m[4] and m[6] == m[2].upper()
    assert re.fullmatch(r"Mrs (\w+) \w+, Mr (\w+) \w+, Mr \w+ and Frau \w+ met Dr (\w+) \w+\.", b) and not re.search("Anna Maria|Schmidt|Smith|Neil|Berg|Hahn", b)
    n = re.fullmatch(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+)\. (\w+) saw (\w+)\. (\w+), (\w+)\.", c)
    assert n and (n[5], n[6], n[7], n[8]) == (n[1], n[4], n[2], n[3]) and len({n[2], n[4]}) == 2
    assert d == "Keller has no title here."


def mod97(iban):
    return int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97


def test_account_numbers_addresses_and_plain_phones(spark):
    a, b, c = replaced(spark, "IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000.", "host 2001:db8:0:0:1:0:0:1 and 2001:db8::ff00:42:8329", "call 2695553296 or 269-555-3296, not 1700000000 or 12345678901")
    spaced, joined = re.fullmatch(r"IBAN (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20})\.", a).groups()
    assert spaced.replace(" ", "") == joined != "DE89370400440532013000" and mod97(joined) == 1
    assert "2001:db8" not in b and re.fullmatch(r"host [0-9a-f:]+ and [0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}", b)
    plain, dashed = re.fullmatch(r"call (\d{10}) or ([\d-]{12}), not 1700000000 or 12345678901", c).groups()
    assert plain == dashed.replace("-", "") != "2695553296"


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a@b.org", 5, ["x"], 7, 8)], "doc_id long, text string, n_entities int, kinds array<string>, _row int, _kept int")
    row = P.replace_pii(docs, "key").first()
    assert sorted(row.asDict()) == sorted(docs.columns) and (row["n_entities"], row["kinds"], row["_row"], row["_kept"]) == (1, ["email"], 7, 8)


def brute(text, mapping):
    """A text with the entities' surrogates, by plain replacement: e-mail addresses and addresses of hosts."""
    for token, new in mapping.items():
        text = re.sub(rf"(?<![\w.]){re.escape(token)}(?!\.?\w)", new, text)
    return text


def test_whole_texts_match_brute_force(spark):
    """Random texts of known entities: whatever stands between them stays, and each has one surrogate."""
    import random

    rng = random.Random(6)
    entities = [f"user{i}@site{i % 3}.org" for i in range(8)] + [f"{rng.randint(20, 99)}.{i}.7.{rng.randint(1, 250)}" for i in range(8)]
    words = ["to", "from", "Then", "x.y", "ver. 2", "a-b", "(", ")", "é", "12", "\n"]
    texts = [" ".join(rng.choice(entities) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    single = replaced(spark, *entities)
    assert len(set(single)) == len(entities) and not set(single) & set(entities)
    mapping = dict(zip(entities, single, strict=True))
    got = replaced(spark, *entities, *texts)[len(entities) :]
    assert got == [brute(t, mapping) for t in texts]


def test_persons_of_one_family_name_stay_apart(spark):
    a, b, c, d, e = replaced(
        spark,
        "Mr John Smith met Mrs Anna Smith. Later Anna spoke, and John left with Mrs Smith. Anna Smith and John Smith smiled; Mr Smith slept.",
        "Mr Smith and Mrs Smith came. Mrs Smith left.",
        "Dr Kim Lee and Mr Paul Lee. Then Dr Lee met Mr Lee; Lee nodded. Mr K. Lee is new.",
        "Mrs May called. May 2020 was odd, on 3 May too, and in May. Then May left.",
        "Frau Eva Maria Roth. Maria came, Eva Roth went. Herr Roth and Frau Dr. Roth stayed.",
    )
    m = re.fullmatch(r"Mr (\w+) (\w+) met Mrs (\w+) (\w+)\. Later (\w+) spoke, and (\w+) left with Mrs (\w+)\. (\w+) (\w+) and (\w+) (\w+) smiled; Mr (\w+) slept\.", a)
    john, smith_m, anna, smith_f = m.groups()[:4]
    assert smith_m != smith_f and "Smith" not in a and john in P.NAMES["latin", "m"].split() and anna in P.NAMES["latin", "f"].split()
    assert m.groups()[4:] == (anna, john, smith_f, anna, smith_f, john, smith_m, smith_m)
    n = re.fullmatch(r"Mr (\w+) and Mrs (\w+) came\. Mrs (\w+) left\.", b)
    assert n and n[1] != n[2] == n[3] and "Smith" not in (n[1], n[2])
    k = re.fullmatch(r"Dr (\w+) (\w+) and Mr (\w+) (\w+)\. Then Dr (\w+) met Mr (\w+); (\w+) nodded\. Mr (\w+) (\w+) is new\.", c)
    assert k and k[2] != k[4] and k[6] == k[4] and k[5] in (k[2], k[4]) and k[7] == k[6] and "Lee" not in c
    y = re.fullmatch(r"Mrs (\w+) called\. May 2020 was odd, on 3 May too, and in May\. Then (\w+) left\.", d)
    assert y and y[1] == y[2] != "May"
    r = re.fullmatch(r"Frau (\w+) (\w+)\. (\w+) came, (\w+) (\w+) went\. Herr (\w+) and Frau Dr\. (\w+) stayed\.", e)
    assert r and r[1] == r[3] == r[4] and r[2] == r[5] == r[7] != r[6] and "Roth" not in e


def persons(text):
    """Brute force over sentences of titled and bare names of two words: which person each mention is."""
    out, seen = [], []
    for m in re.finditer(r"(?:(Mr|Mrs) )?([A-Z]\w+)(?: ([A-Z]\w+))?", text):
        title, first, last = m.groups()
        if title and last:
            person = (title, first, last)
            seen.append(person)
        elif title:
            fits = [p for p in seen if p[2] == first and p[0] == title]
            later = [p for p in re.findall(r"(Mr|Mrs) (\w+) (\w+)", text[m.end() :]) if p[2] == first and p[0] == title]
            person = fits[-1] if fits else later[0] if later else (title, None, first)
            seen.append(person)
        else:
            person = None
        out.append(person)
    return out


def test_titled_mentions_match_brute_force(spark):
    import random

    rng = random.Random(3)
    given, family, texts = {"Mr": ["Otto", "Karl"], "Mrs": ["Anna", "Vera"]}, ["Weiss", "Braun"], []
    for _ in range(30):
        one = lambda t: f"{t} {rng.choice(given[t])} {rng.choice(family)}" if rng.random() < 0.5 else f"{t} {rng.choice(family)}"
        texts.append(" and then ".join(one(rng.choice(["Mr", "Mrs"])) for _ in range(rng.randint(1, 9))))
    for text, new in zip(texts, replaced(spark, *texts), strict=True):
        mentions = re.findall(r"(?:Mr|Mrs) (?:\w+ )?(\w+)(?= and|$)", new)
        named = persons(text)
        assert len(mentions) == len(named) and not any(f in new for f in family)
        by = {}
        for surname, person in zip(mentions, named, strict=True):
            assert by.setdefault(person, surname) == surname
        assert len(set(by.values())) == len(by), (text, new)
