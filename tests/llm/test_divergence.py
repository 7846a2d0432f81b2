import random
import re
from collections import Counter, defaultdict

import pytest

from hearken.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=10, most=10):
    n, df, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        n.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (x, t), d in df.items() if x == lang and d >= least]
        shares = lambda counts: [1 + 10**9 * (c + 2) // (sum(counts) + 2 * len(kept)) for c in counts]
        count = {s: [n[lang, s, t] for t in kept] for s in sources}
        p = {s: shares(count[s]) for s in sources}
        q = shares([sum(c[k] for c in count.values()) for k in range(len(kept))])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(map(f, p[s], p[o])), o.encode(), o) for o in sources if o != s]
            terms = [(-f(a, b), t.encode(), t) for a, b, c, t in zip(p[s], q, count[s], kept) if c and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def shown(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("bits", [18, 24])
def test_audit_matches_brute_force(spark, bits):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ["The", "É", "x", "日"] for b in ["", "ab", "Zc", "d'e", "1f"]]
    rows = []
    for _ in range(300):
        k = rng.randrange(len(words))
        rows.append((rng.choice(["en", "en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "É", None]), " ".join(rng.choice(words[: k + 1]) for _ in range(rng.choice([0, 1, 30])))))
    rows += [("en", "hot", "same words here")] * 12 + [("en", "silent", None), ("en", "marks", "12 .,"), ("lone", "only", "one two"), ("few", "a", "rare"), ("few", "b", "")]
    docs = spark.createDataFrame([(1, *r, "x", 5) for r in rows], "doc_id long, lang string, source string, text string, term string, n int").repartition(3)
    got, want = shown(divergence.audit(docs, bits=bits)), brute_force(rows)
    assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert [r for r in got if r[0] == "few"] == [("few", "a", "pair", "b", 0, 1), ("few", "b", "pair", "a", 0, 1)]
    assert not [r for r in got if r[0] == "lone" and r[2] == "pair"]


def test_ties_and_many_terms(spark):
    rows = [("en", s, " ".join(f"{s}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))) for s in "abc" for _ in range(11)]
    assert shown(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))) == brute_force(rows)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
