import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearken.functions import text as T
from hearken.operators import lookup, scans, selection
from hearken.operators import scoring as S
from hearken.operators import streams as R


def test_running_sums_and_fills_over_blocks(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([None, 1, 5]), rng.choice([None, None, f"h{i}"])) for k, n in (("big", 500), ("one", 1), (None, 40)) for i in sorted(rng.sample(range(2000), n))]
    df = spark.createDataFrame(rows, "k string, i int, x int, h string").repartition(5)
    got = {(r["k"], r["i"]): (r["before"], r["last"]) for r in scans.running_last(scans.running_sums(df.fillna("none", ["k"]), ["k"], "i", scans.stretches("i", 64), {"before": "x"}), ["k"], "i", scans.stretches("i", 64), F.col("h"), "last").collect()}
    want = {}
    for k in ("big", "one", None):
        total, last = 0, None
        for _, i, x, h in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            last = h or last
            want[k or "none", i] = (total, last)
            total += x or 0
    assert got == want


def test_blocks_between_quantiles(spark):
    df = spark.createDataFrame([(float(x * x), 1) for x in range(2000)], "score double, n int")
    block = scans.ranges(df, "score", 16)
    sizes = [r["count"] for r in df.groupBy(block.alias("b")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 400
    empty = df.filter("false")
    assert empty.withColumn("b", scans.ranges(empty, "score", 16)).collect() == []


def test_largest_task_of_one_key_is_a_block(spark):
    """Rows that one window partition has, when all are of one stream."""
    chunks = spark.range(5000).select(F.lit("s").alias("stream"), F.col("id").cast("int").alias("chunk_idx"))
    marks = chunks.withColumn("block", scans.stretches("chunk_idx", 256)).groupBy("stream", "block").count()
    assert marks.agg(F.max("count")).first()[0] == 256
    known = chunks.filter("chunk_idx % 3 = 0").withColumn("duration", F.lit(2.0))
    got = {r["chunk_idx"]: r["offset"] for r in R.stream_offsets(chunks.filter("chunk_idx % 7 = 0"), known, "stream").collect()}
    assert got == {i: sum(2.0 if j % 3 == 0 else 5.0 for j in range(i)) for i in range(0, 5000, 7)}


def test_percentiles_are_exact(spark):
    rng = random.Random(9)
    hot = [0.1] * 300 + [0.30000000000000004, -0.0, 0.0, -1e300, 1e300, 5e-324, float("inf"), float("-inf")]
    rows = [("hot", x) for x in hot] + [("few", None), ("few", 2.0), ("none", None), (None, 7.5), (None, 8.5)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9)) for _ in range(700)]
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {r["k"]: [r[n] for n in wanted] for r in selection.percentiles(df, ["k"], F.col("x"), wanted).collect()}
    for key in {k for k, x in rows if x is not None}:
        have = sorted(x for k, x in rows if k == key and x is not None)
        for q, v in zip(wanted.values(), got.pop(key), strict=True):
            place = q * (len(have) - 1)
            a, b = have[int(place)], have[min(int(place) + (place > int(place)), len(have) - 1)]
            assert v == (a if a == b else pytest.approx(a + (place - int(place)) * (b - a), rel=1e-12))
    assert not got
    whole = selection.percentiles(df.filter("k = 'wide'"), [], F.col("x"), {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.percentile([x for k, x in rows if k == "wide"], 50))
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert selection.percentiles(nan, [], F.col("x"), {"m": 0.5}).first()["m"] == 2.0


@pytest.mark.parametrize("least", [100.0, 85.0, 70.0, 30.0, 0.85])
def test_words_alike_match_brute_force(spark, least):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 13])))
    tokens, words = {make() for _ in range(120)}, {make() for _ in range(60)}
    words |= {t[:-1] + "x" for t in list(tokens)[:20]} | {""}
    got = {(r["token"], r["wanted"]) for r in lookup.alike(spark.createDataFrame([(t,) for t in tokens | {""}], "token string"), spark.createDataFrame([(w,) for w in words], "wanted string"), least).collect()}
    ratio = lambda a, b: 200.0 * T.common_length(a, b) / (len(a) + len(b))
    assert got == {(t, w) for t in tokens for w in words if t and w and ratio(t, w) >= least}


def test_words_of_short_segments_meet_in_blocks(spark, monkeypatch):
    """No row for each pair that shares two letters: blocks of tokens against blocks of words."""
    monkeypatch.setattr(lookup, "TOKENS", 7)
    monkeypatch.setattr(lookup, "WORDS", 5)
    rng = random.Random(5)
    make = lambda sizes: "".join(rng.choice("abc\U0001d49e") for _ in range(rng.choice(sizes)))
    tokens, words = {make([1, 2, 5, 8, 62, 65]) for _ in range(80)}, {make([1, 3, 6, 8, 63, 64, 66]) for _ in range(60)}
    found = lookup.alike(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "wanted string"), 60.0)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    ratio = lambda a, b: 200.0 * T.common_length(a, b) / (len(a) + len(b))
    assert sorted(map(tuple, found.collect())) == sorted((t, w, ratio(t, w)) for t in tokens for w in words if ratio(t, w) >= 60.0)


def test_many_words_are_joined_not_compared(spark):
    """A hundred thousand words and as many tokens: each token meets the words that share a piece."""
    base = spark.range(100_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("wanted"))
    tokens = base.select(F.concat(F.substring("wanted", 1, 5), F.lit("#"), F.substring("wanted", 7, 6)).alias("token"))
    found = lookup.alike(tokens, base, 90.0)
    assert found.count() >= 100_000
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() or "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()


def test_cohort_products_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vector = lambda: rng.normal(size=4).tolist()
    windows = [(k, i, vector()) for k in "abc" for i in range(50 if k == "a" else 3)]
    cohort = [(k, vector()) for k, n in (("a", 30), ("b", 2), ("d", 5)) for _ in range(n)]
    df = spark.createDataFrame(windows, "key string, window_id int, embedding array<double>"), spark.createDataFrame(cohort, "key string, cohort array<double>")
    got = {(r["key"], r["window_id"]): (r["mu"], r["sigma"]) for r in S.cohort_stats(*df, ["window_id"], 5, together=8).collect()}
    assert set(got) == {(k, i) for k, i, _ in windows if k in "ab"}
    for k, i, v in windows:
        if k in "ab":
            best = sorted((float(np.dot(v, c)) for x, c in cohort if x == k), reverse=True)[:5]
            assert got[k, i] == (pytest.approx(np.mean(best)), pytest.approx(max(np.std(best), 1e-3)))


def test_chunks_of_one_length_are_dealt_out(spark):
    from hearken.functions import models

    rows = spark.range(4000).select("id", F.when(F.col("id") % 50 == 0, 3200).otherwise(80000).alias("n"))
    parts = models.by_length(rows, "n").select("id", "n", F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in parts.groupBy("p").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 2500 and len(sizes) > 1
    assert pd.DataFrame(parts.collect(), columns=parts.columns).groupby("p")["n"].nunique().max() <= 2
