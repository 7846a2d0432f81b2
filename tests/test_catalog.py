"""Every query with SQL against DuckDB on the smallest tables."""

import collections
import math
import re

import duckdb
import pytest

from hearken.functions import g2p
from hearken.functions import text as T
from hearken.plans import catalog, more  # noqa: F401
from tests.test_g2p import one_by_one

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL)
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [[shown(v) for v in r] for r in want.fetchall()]
    assert sorted(rows) == sorted([shown(r[c]) for c in columns] for r in got.collect())


def test_phonetic_matches_have_the_keyword_s_code(spark):
    got = {(r["keyword"], r["token"]): r["n"] for r in catalog.QUERIES["phonetic_match"](spark, SMALL).collect()}
    tokens = collections.Counter(r["token"] for r in catalog.token_rows(spark, SMALL).collect())
    assert got == {(k, t): n for k in catalog.SINGLE for t, n in tokens.items() if T.metaphone(t) == T.metaphone(k)}


def test_phonetic_codes_are_of_distinct_tokens(spark):
    """The code is asked once for a distinct token, not under the count for every word of every text."""
    plan = catalog.QUERIES["phonetic_match"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    counted = min(i for i, line in enumerate(lines) if "Aggregate [token" in line)
    assert not any("ArrowEvalPython" in line for line in lines[counted : counted + 5])
    assert sum("ArrowEvalPython" in line for line in lines[:counted]) == 1


def test_cascade_holds_the_fuzzy_matches(spark):
    """With codes, matches only change from fuzzy to phonetic or are added."""
    count = lambda name: {(r["keyword"], r["match_type"]): r["n"] for r in catalog.QUERIES[name](spark, SMALL).collect()}
    plain, coded = count("fuzzy_keyword_match"), count("match_cascade")
    for keyword in catalog.FUZZY:
        assert plain.get((keyword, "exact")) == coded.get((keyword, "exact"))
        assert sum(n for (k, _), n in coded.items() if k == keyword) >= sum(n for (k, _), n in plain.items() if k == keyword)


def test_similar_words_against_every_pair(spark):
    split = lambda t: {w for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select("text").collect() for w in re.findall("[a-z']+", (r["text"] or "").lower())}
    tokens, wanted = split("conversations"), split("benchmark")
    got = {(r["token"], r["wanted"]): r["r"] for r in catalog.QUERIES["similar_words"](spark, SMALL).collect()}
    some = sorted(tokens)[::40]
    ratio = lambda a, b: 200.0 * T.common_length(a, b) / (len(a) + len(b))
    want = {(t, w): round(ratio(t, w), 6) for t in some for w in wanted if 4 * min(len(t), len(w)) >= 2.4 * max(len(t), len(w)) and ratio(t, w) >= 80}
    assert want and {k: v for k, v in got.items() if k[0] in set(some)} == want


def test_spoken_words_one_by_one(spark):
    got = {r["word"]: r["phonemes"] for r in catalog.QUERIES["spoken_words"](spark, SMALL).collect()}
    words = {w for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("text").collect() for w in re.findall("[a-z]+", (r["text"] or "").lower())}
    assert got.keys() == words
    weights = g2p.weights_by_rule()
    for word in sorted(words)[::300]:
        assert got[word] == " ".join(one_by_one(word, weights))


def test_numbers_are_expanded_row_by_row(spark):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    got = {(r["conv_id"], r["turn"]): r["text"] for r in catalog.QUERIES["number_expansion"](spark, SMALL).collect()}
    assert got == {k: None if t is None else T.numbers_expanded(t) for k, t in turns.items()}
    assert not any(c in "0123456789" for t in got.values() for c in t or "")
