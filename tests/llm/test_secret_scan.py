import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from hearken.llm import secret_scan
from hearken.llm.queries import QUERIES
from tests.llm.data import DOCS, SMALL

HEX40 = "0641917ea4e9feb9cda83477b57ac2654884f485"


def base_spans(text):
    found = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans_match_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op4_secret_scan"](spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for doc in texts:
        spans = base_spans(doc["text"])
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        row = rows[doc["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[3] == k for x in spans) for k in ("assign", "access", "hex")]
        assert {x for x in text.split(",") if x} <= set(row["spans"].split(","))


def test_edge_cases(spark):
    texts = [None, "", "password=token: abcdefgh", f'é token = "{HEX40}"', "AKIA" + "Z" * 15, "secret=abc", "x " * 5000 + HEX40, "PassWord: hunter22"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, row string")
    rows = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs).collect()}
    for i, text in enumerate([*texts, texts[3]]):
        got = [(s["start"], s["end"], s["kind"]) for s in rows[i]["found"] if s["kind"] != "random"]
        assert got == [(s, e, k) for s, _, e, k in base_spans(text)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.scan_secrets(docs).count() == 0


def test_battery_adds_random_strings_and_leaves_text(spark):
    key = "qT7mZ0xLr9Kd3VbW8nYcE5sGh2JpUf6aQiXo1R4t"
    docs = spark.createDataFrame([(1, f"the key {key} end"), (2, "a thanbleshaningtionnten b"), (3, "abcdefghijklmnopqrstuvwxyz0123456789"), (4, "a" * 40)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in rows[1]["found"]] == [(8, 8 + len(key), "random")]
    assert not rows[2]["found"] and not rows[3]["found"]
    assert [s["kind"] for s in rows[4]["found"]] == ["hex"]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, f'a token = "{HEX40}" b {HEX40} c', "en"), (2, "clean", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert rows == {1: 'a [SECRET]" b [SECRET] c', 2: "clean", 3: None}
    assert secret_scan.redact(docs).columns == docs.columns


ALPHABETS = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
ALPHABETS["base64"], ALPHABETS["base64url"] = ALPHABETS["base62"] + "+/", ALPHABETS["base62"] + "-_"


def test_recall_by_encoding(spark):
    """Random strings of every encoding among words joined without spaces, which are not secrets."""
    rng = random.Random(4)
    words = "the quick brown fox jumps over lazy dogs while ConstantName HttpRequest handler version value".split()
    rows, want = [], {}
    for name, n in (("base62", 32), ("base62", 40), ("base32", 32), ("base32", 52), ("base64", 44), ("base64url", 44)):
        for _ in range(60):
            key = "".join(rng.choice(ALPHABETS[name]) for _ in range(n))
            want[len(rows)] = (name, n, key)
            rows.append((len(rows), f"see {key} there"))
    text_like = ["".join(rng.choice(words) for _ in range(rng.randint(4, 8))) for _ in range(400)]
    text_like += ["".join(rng.choice(words) for _ in range(6)).upper() for _ in range(100)]
    rows += [(len(rows) + i, f"see {t} there") for i, t in enumerate(text_like)]
    found = {r["doc_id"]: [s for s in r["found"] if s["kind"] == "random"] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {}
    for i, (name, n, key) in want.items():
        hit.setdefault((name, n), []).append(any(s["start"] == 4 and s["end"] == 4 + len(key) for s in found[i]))
    assert all(sum(x) >= 0.9 * len(x) for k, x in hit.items() if k[1] >= 40) and all(sum(x) >= 0.75 * len(x) for x in hit.values()), {k: sum(x) for k, x in hit.items()}
    assert sum(bool(found[i]) for i in range(len(want), len(rows))) <= 5


def test_a_key_behind_a_path_is_a_candidate(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        key = "".join(rng.choice(ALPHABETS["base62"]) for _ in range(40))
        rows.append((i, f"get https://host.com/api_v1/{key} now"))
    at = len("get https://host.com/api_v1/")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((at, at + 40) in found[i] for i in range(30)) >= 27


def verdict(token):
    """encoding, band, vetoed and p of a candidate, in plain Python."""
    bare = token.rstrip("=")
    n = len(bare)
    for name, (shape, k, half) in secret_scan.ENCODINGS.items():
        if re.search(shape, bare):
            break
    else:
        return None
    codes = [ord(c) for c in bare]
    chi = sum((bare.count(c) - n / k) ** 2 / (n / k) for c in set(bare)) + (k - len(set(bare))) * n / k
    mean = sum(codes) / n
    spread, lagged = sum((c - mean) ** 2 for c in codes), sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:]))
    high = [c >= ord(half) for c in codes]
    runs, above = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    expected = 2 * above * (n - above) / n + 1
    variance = max((expected - 1) * (expected - 2) / (n - 1), 0)
    z = [(chi - k + 1) / math.sqrt(2 * (k - 1)), abs(runs - expected) / math.sqrt(variance) if variance else 99, abs(lagged / spread if spread else 1) * math.sqrt(n)]
    kinds = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in bare]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    equal = sum(a == b for i, a in enumerate(bare) for b in bare[:i])
    text = secret_scan.TEXT_COINCIDENCE / k * n * (n - 1) / 2
    tail = lambda x: math.erfc(max(x, 0) / math.sqrt(2)) / 2
    ps = [tail((text - equal - 0.5) / math.sqrt(text))]
    rate, tied = secret_scan.TEXT_CHANGES[name], secret_scan.TEXT_SERIAL[name]
    if rate is not None:
        ps += [tail((changes - 0.5 - rate * (n - 1)) / math.sqrt(rate * (1 - rate) * (n - 1))), tail((tied - (lagged / spread if spread else 1)) * math.sqrt(n) / math.sqrt(1 - tied**2))]
    y = -sum(map(math.log, ps))
    return name, sum(n >= b for b in secret_scan.BANDS), any(x > secret_scan.VETO for x in z), math.exp(-y) * (1 + y + y * y / 2)


def test_battery_matches_brute_force(spark):
    rng = random.Random(2)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(20, 70))) for a in [*ALPHABETS.values(), "0123456789abcdef", "abcdefgh", "abcdefghijklmnopqrstuvwxyz", "aB"] for _ in range(12)]
    tokens += ["a" * 30, "abc" * 10, "Z" * 25 + "=="]
    got = {r["token"]: r for r in secret_scan.battery(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    for t in tokens:
        want = verdict(t)
        r = got.get(t)
        assert (r is None) == (want is None)
        if want:
            assert (r["encoding"], r["band"], r["vetoed"]) == want[:3]
            assert math.isclose(math.log(r["p"]), math.log(max(want[3], 1e-300)), rel_tol=1e-3, abs_tol=1e-3)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, f"x {HEX40}", 1, "k", [1], 2, 3)], "doc_id long, text string, _id int, _key string, cuts array<int>, _cuts int, row int")
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and tuple(out.first()) == (1, "x [SECRET]", 1, "k", [1], 2, 3)
