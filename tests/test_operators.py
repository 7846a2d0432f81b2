import random

import pytest
from pyspark.sql import functions as F

from hearken.functions import text as T
from hearken.operators import evaluation as E
from hearken.operators import matching as M
from hearken.operators import scoring as S
from hearken.operators import streams as R


def test_gap_suppression(spark):
    rows = spark.createDataFrame([(1, 0, 0.6, "a"), (1, 1000, 0.9, "b"), (1, 2000, 0.9, "a"), (1, 3500, 0.7, "a")], "s int, start_ms long, confidence double, keyword string")
    assert sorted(r["start_ms"] for r in M.gap_suppressed(rows, ["s"]).collect()) == [1000, 3500]
    assert sorted(r["start_ms"] for r in M.gap_suppressed(rows, ["s", "keyword"]).collect()) == [0, 1000, 2000, 3500]


def test_greedy_suppression(spark):
    rows = spark.createDataFrame([("c", 1.0, 1.0, 0.9), ("c", 1.0, 1.1, 0.95), ("c", 1.0, 3.0, 0.5)], "c string, scale double, time double, score double")
    kept = M.greedy_suppressed(rows, ["c"]).first()["kept"]
    assert [(k["time"], k["score"]) for k in kept] == [(1.1, 0.95), (3.0, 0.5)]


WS = "doc_id long, ws array<struct<raw:string,token:string,start_ms:long,end_ms:long,score:double>>"


def test_cascade(spark):
    words = spark.createDataFrame([(1, [("Penalty!", "penalty", 0, 350, 0.8), ("penally", "penally", 400, 750, 0.7), ("goal", "goal", 800, 1150, 0.3)])], WS)
    got = {(r["keyword"], r["match_type"]): r["confidence"] for r in M.cascade_matches(words, M.targets(spark, ["penalty", "--", "goal"])).collect()}
    assert got == {("penalty", "exact"): pytest.approx(0.8), ("penalty", "fuzzy"): pytest.approx(0.7 * 0.85714286)}
    # A ratio meant for 0..1 on the 0..100 scale lets nearly every pair through.
    loose = M.cascade_matches(words, M.targets(spark, ["penalty"]), fuzzy_ratio=0.85, least_confidence=0.0)
    assert loose.count() == 3


def test_cascade_takes_the_mean_over_words(spark):
    stream = lambda text: (1, [(w, w, 400 * i, 400 * i + 350, 1.0) for i, w in enumerate(text.split())])
    for text, keyword, mean in (("a catch food b", "cat food", 87.5), ("is in thexx", "is in the", 275 / 3)):
        row = M.cascade_matches(spark.createDataFrame([stream(text)], WS), M.targets(spark, [keyword])).collect()
        assert [(r["match_type"], r["keyword"]) for r in row] == [("fuzzy", keyword)]
        assert row[0]["confidence"] == pytest.approx(mean / 100)


def test_cascade_keeps_words_and_windows_in_their_tasks(spark):
    """Only distinct tokens cross an exchange, not the words with their neighbours and not the windows."""
    words = [(w, w, 400 * i, 400 * i + 350, 1.0) for i, w in enumerate("the cat the cat food catch food".split())]
    found = M.cascade_matches(spark.createDataFrame([(1, words)], WS), M.targets(spark, ["cat food", "the"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan and "hashpartitioning(token" not in plan and "hashpartitioning(keyword#" not in plan.split("BroadcastExchange")[0]
    assert sorted((r["keyword"], r["pos"], r["match_type"]) for r in found.collect()) == [("cat food", 3, "exact"), ("cat food", 5, "fuzzy"), ("the", 0, "exact"), ("the", 2, "exact")]


def test_cascade_matches_brute_force(spark):
    """All windows against all keywords of one to three words, over random word streams."""
    rng = random.Random(11)
    vocabulary = ["cat", "catch", "food", "foot", "moved", "moves", "knight", "night", "a", "i", "thexx", "the", "cats", "feud"]
    keywords = ["cat", "cat food", "the night", "moves the cat", "a", "knight moved food"]
    streams = []
    for d in range(12):
        ws = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 25]))]
        streams.append((d, [(w.upper(), w, 400 * i, 400 * i + 350, rng.randint(40, 99) / 100) for i, w in enumerate(ws)]))
    want = set()
    for d, ws in streams:
        for k in keywords:
            ts = k.split()
            for at in range(len(ws) - len(ts) + 1):
                part = ws[at : at + len(ts)]
                mean = sum(200 * T.common_length(w[1], t) / (len(w[1]) + len(t)) for w, t in zip(part, ts)) / len(ts)
                if [w[1] for w in part] == ts:
                    kind, weight = "exact", 1.0
                elif [T.metaphone(w[1]) for w in part] == [T.metaphone(t) for t in ts]:
                    kind, weight = "phonetic", 0.9
                elif mean >= 80:
                    kind, weight = "fuzzy", mean / 100
                else:
                    continue
                confidence = sum(w[4] for w in part) / len(ts) * weight
                if confidence >= 0.5:
                    want.add((d, at, k, kind, round(confidence, 6), part[0][2], part[-1][3], " ".join(w[0] for w in part)))
    found = M.cascade_matches(spark.createDataFrame(streams, WS), M.targets(spark, keywords), fuzzy_ratio=80.0).collect()
    got = [(r["doc_id"], r["pos"], r["keyword"], r["match_type"], round(r["confidence"], 6), r["start_ms"], r["end_ms"], r["context"]) for r in found]
    assert len(got) == len(want) and set(got) == want


def test_recognized_streams(spark):
    rows = [("c", [("Hello,", 0.0, 0.4, 0.9), ("--", 0.5, 0.6, 0.9), ("World", 0.7, None, 0.9), ("Éa b", 1.0, 1.4, 0.5)])]
    got = M.recognized(spark.createDataFrame(rows, "chunk string, words array<struct<word:string,start:double,end:double,score:double>>")).first()["ws"]
    assert [(w["raw"], w["token"], w["start_ms"], w["end_ms"], w["score"]) for w in got] == [("Hello,", "hello", 0, 400, 0.9), ("Éa b", "éa", 1000, 1400, 0.5)]


def test_exact_matches_join_many_keywords(spark, monkeypatch):
    """More keywords than are looked up in the expression: the same result from the join."""
    streams = spark.createDataFrame([(1, [(w, w, i, i + 1, 0.5) for i, w in enumerate("a b c a b".split())]), (2, [])], WS)
    keywords = M.targets(spark, ["a b", "c", "x y z"])
    first = sorted((r["doc_id"], r["pos"], r["keyword"]) for r in M.exact_matches(streams, keywords, [1, 2, 3]).collect())
    monkeypatch.setattr(M, "LOOKED_UP", 1)
    assert sorted((r["doc_id"], r["pos"], r["keyword"]) for r in M.exact_matches(streams, keywords, [1, 2, 3]).collect()) == first == [(1, 0, "a b"), (1, 2, "c"), (1, 3, "a b")]


def test_stream_time_and_context(spark):
    chunks = spark.createDataFrame([("s", 0), ("s", 2), ("s", 3)], "stream string, chunk_idx int")
    durations = spark.createDataFrame([("s", 0, 4.0), ("s", 2, 6.0)], "stream string, chunk_idx int, duration double")
    got = {r["chunk_idx"]: r["offset"] for r in R.stream_offsets(chunks, durations, "stream").collect()}
    assert got == {0: 0.0, 2: 9.0, 3: 15.0}
    near = R.context(spark.createDataFrame([("s", 1)], "stream string, chunk_idx int"), chunks, "stream", 1)
    assert sorted(r["near"] for r in near.collect()) == [0, 2]
    assert {r["chunk_idx"] for r in R.purged(chunks, spark.createDataFrame([("s", 1, 2)], "stream string, start int, end int"), "stream").collect()} == {0, 3}
    starts = lambda n: spark.range(1).select(R.hop_starts(F.lit(n)).alias("s")).first()["s"]
    assert [starts(n) for n in (24000, 40000, 10000)] == [[0], [0, 8000, 16000], [0]]


def test_adaptive_scores(spark):
    anchor = spark.createDataFrame([("k", [1.0, 0.0])], "key string, anchor array<double>")
    cohort = spark.createDataFrame([("k", v) for v in ([0.0, 1.0], [0.8, 0.6], [-1.0, 0.0], [0.6, 0.8])], "key string, cohort array<double>")
    windows = spark.createDataFrame([("k", 1, [1.0, 0.0]), ("k", 2, [0.6, 0.8])], "key string, window_id int, embedding array<double>")
    got = {r["window_id"]: r["score"] for r in S.adaptive_scores(windows, anchor, cohort, 2).collect()}
    assert got == {1: pytest.approx(3.0), 2: pytest.approx(-10.0)}


def test_evaluation(spark):
    scored = spark.createDataFrame([("k", True, 0.9), ("k", False, 0.8), ("k", True, 0.7), ("k", False, 0.2)], "key string, truth boolean, score double")
    best = E.best_f1(scored, ["key"]).first()
    assert (best["threshold"], best["f1"], best["tp"], best["fp"]) == (0.7, pytest.approx(0.8), 2, 1)
    ranks = spark.createDataFrame([("k", True, 0.9), ("k", True, 0.5), ("k", True, 0.5), ("k", False, 0.5), ("k", False, 0.1)], "key string, truth boolean, score double")
    assert E.rank_auc(ranks, ["key"]).first()["auc"] == pytest.approx(0.833333, abs=1e-5)
    predictions = spark.createDataFrame([("k", s) for s in (1.2, 1.4, 2.5, 2.6)], "key string, start double")
    truth = spark.createDataFrame([("k", 1.0, 2.0)], "key string, start double, end double")
    row = E.interval_matches(predictions, truth, ["key"]).first()
    assert (row["tp"], row["fp"], row["fn"]) == (1, 3, 0)
    none = spark.createDataFrame([("a", True, False)], "key string, truth boolean, predicted boolean")
    for empty in (0.0, 1.0):
        assert {r["precision"] for r in E.by_class_and_total(none, "key", empty).collect()} == {empty}


def test_rescue(spark):
    d = spark.createDataFrame([("c", 1.0, 2.0)], "c string, scale double, time double")
    more = spark.createDataFrame([("c", 1.0, 2.0000005), ("c", 0.8, 2.0), ("c", 1.0, 3.0)], "c string, scale double, time double")
    assert sorted((r["scale"], r["time"], r["rescued"]) for r in R.rescued(d, more, ["c"]).collect()) == [(0.8, 2.0, True), (1.0, 2.0, False), (1.0, 3.0, True)]


def test_suppression_by_segments_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.6, 1.0]), round(rng.choice([rng.uniform(0, 3), rng.uniform(0, 300)]), 2), rng.choice([0.5, rng.random()])) for g in ("a", "a", "b", None) for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, scale double, time double, score double")
    for apart, most in ((0.25, 8), (0.25, 1000), (30.0, 8)):
        got = {r["g"]: [(k["score"], k["scale"], k["time"]) for k in r["kept"]] for r in M.greedy_suppressed(df, ["g"], apart, most).collect()}
        for g in ("a", "b", None):
            kept = []
            for s, c, t in sorted(((s, c, t) for x, c, t, s in rows if x == g), key=lambda v: (-v[0], v[1], v[2])):
                if len(kept) < most and all(abs(t - k[2]) >= apart for k in kept):
                    kept.append((s, c, t))
            assert got[g] == kept


def test_gaps_by_segments_match_brute_force(spark):
    rng = random.Random(7)
    rows = sorted({(g, rng.randrange(0, 200_000), rng.choice("xyz")) for g in ("a", None) for _ in range(150)}, key=str)
    rows = [(*r, rng.choice([0.5, 0.9])) for r in rows]
    df = spark.createDataFrame(rows, "g string, start_ms long, keyword string, confidence double")
    want = []
    for g in ("a", None):
        run = []
        for r in [*sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])), None]:
            if run and (r is None or r[1] - run[-1][1] > 1000):
                want.append(max(run, key=lambda x: (x[3], -x[1], [-ord(c) for c in x[2]])))
                run = []
            if r:
                run.append(r)
    got = [(r["g"], r["start_ms"], r["keyword"], r["confidence"]) for r in M.gap_suppressed(df, ["g"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_reports_keep_a_null_key(spark):
    scored = spark.createDataFrame([(None, True, 0.9), (None, False, 0.3), ("k", True, 0.5), ("k", False, 0.7)], "key string, truth boolean, score double")
    assert {r["key"]: r["auc"] for r in E.rank_auc(scored, ["key"]).collect()} == {None: 1.0, "k": 0.0}
    assert {r["key"]: r["threshold"] for r in E.best_f1(scored, ["key"]).collect()} == {None: 0.9, "k": 0.5}
    report = S.calibration(scored.withColumnRenamed("truth", "positive"), "key").collect()
    assert {r["key"]: r["threshold"] for r in report} == {None: 0.3, "k": 0.7}


def test_nearest_by_blocks_match_brute_force(spark, monkeypatch):
    """Blocks smaller than the table, many copies, opposite and odd vectors: as the product of each pair says."""
    for name, n in (("QUERIES", 9), ("FRAMES", 150), ("ROWS", 4), ("GROUP", 8)):
        monkeypatch.setattr(S, name, n)
    rng = random.Random(4)
    vectors = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(150)]
    rows = [(i, vectors[i % 3] if i % 4 == 0 else vectors[i % 150]) for i in range(400)]
    rows += [(400, None), (401, [1.0]), (402, [0.0] * 5), (450, [float("nan")] * 5), (None, [1.0] * 5)]
    table = spark.createDataFrame(rows, "frame_id long, embedding array<double>")
    queries = table.filter("frame_id % 10 = 0").withColumnRenamed("frame_id", "query_id")
    found = S.nearest(queries, table, 4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    pairs = queries.select("query_id", F.col("embedding").alias("q")).join(table.select("frame_id", F.col("embedding").alias("f")), F.col("query_id") != F.col("frame_id"))
    order = S.W.partitionBy("query_id").orderBy(F.desc("cosine"), "frame_id")
    want = pairs.withColumn("cosine", S.V.dot(F.col("q"), F.col("f"))).withColumn("rank", F.row_number().over(order)).filter("rank <= 4")
    shown = lambda df: sorted((r["query_id"], r["rank"], r["frame_id"], str(r["cosine"])) for r in df.collect())
    assert shown(found) == shown(want)


def test_recurring_ngrams_leave_rare_ones_out(spark):
    """Runs that occur often enough are all there, in their rows and places, and hardly any other run is made."""
    pick = random.Random(5)
    texts = [" ".join([f"w{pick.randrange(10**6)}" for _ in range(60)] + (["Odd", "old,", "owl"] if i % 3 == 0 else []) + ["a"] * (i % 5)) for i in range(300)]
    rows = [(i, [(w, w.lower().strip(","), 0, 0, 1.0) for w in t.split()]) for i, t in enumerate([*texts, "one two", ""])]
    words = spark.createDataFrame(rows, WS)
    shown = lambda df: {(r["doc_id"], r["pos"], r["gram"], r["context"]) for r in df.collect()}
    every, got = shown(M.ngrams(words, 3)), shown(M.recurring_ngrams(words, 3, 3))
    counts: dict[str, int] = {}
    for _, _, gram, _ in every:
        counts[gram] = counts.get(gram, 0) + 1
    assert got <= every and {r for r in every if counts[r[2]] >= 3} <= got
    assert {"odd old owl", "a a a"} <= {r[2] for r in got}
    assert len({r[2] for r in got} - {g for g, c in counts.items() if c >= 3}) < len(counts) / 4
    assert shown(M.recurring_ngrams(words.limit(0), 3, 3)) == set() == shown(M.recurring_ngrams(words.filter("doc_id = 300"), 3, 3))
