"""Similarities over whole texts and tokens of any length."""

import pytest

from hearken.functions import text as T
from hearken.plans import catalog

SMALL = "/root/testdata/sf0.001"


def edits(reference, text):
    """The table of edits, where starting anywhere in the text costs nothing."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(reference, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("a,b", [("there", "x" * 80 + "there"), ("there", "their hare"), ("a", "b"), ("abab", "aabb" * 9), ("kitten", "a sitting kit"), ("é∂x", "xé∂"), ("ab" * 50, "ba" * 40 + "c" + "ab" * 20)])
def test_least_edits(a, b):
    assert T.least_edits(a, b) == edits(a, b)


def test_infix_query_reads_whole_turns(spark):
    rows = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    got = {(r["conv_id"], r["turn"]): r["similarity"] for r in catalog.QUERIES["infix_similarity"](spark, SMALL).collect()}
    want = {k: None if t is None else max(0.0, round(1 - edits("there", t) / 5, 6)) if t else 0.0 for k, t in rows.items()}
    assert got == pytest.approx(want)
    assert any(t and edits("there", t) < edits("there", t[:60]) for t in rows.values())


def test_indel_ratio_of_long_tokens(spark):
    got = {(r["keyword"], r["token"]): r["ratio"] for r in catalog.QUERIES["indel_ratio_by_token"](spark, SMALL).collect()}
    assert any(len(t) > 12 for _, t in got)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    for (keyword, token), ratio in got.items():
        assert ratio == pytest.approx(200 * common(keyword, token) / (len(keyword) + len(token)), abs=1e-5)
