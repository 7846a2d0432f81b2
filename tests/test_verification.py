import pytest
from pyspark.sql import functions as F

from hearken.functions import models
from hearken.operators import verification as V
from hearken.sources import detections


def test_references_and_threshold(spark):
    refs = spark.createDataFrame([("k", 1, list("abc")), ("k", 2, list("abc")), ("k", 3, list("abd")), ("k", 4, ["a"]), ("l", 5, list("xyz"))], "key string, id int, phones array<string>")
    kept = V.distinct_references(refs, "key", "id", 5)
    assert sorted(r["id"] for r in kept.collect()) == [1, 3, 5]
    loo = {r["key"]: r["loo_mean"] for r in V.leave_one_out(kept, "key", "id").collect()}
    assert loo == {"k": pytest.approx(2 / 3), "l": 1.0}
    negatives = spark.createDataFrame([("k", 0.2), ("k", 0.4)], "key string, similarity double")
    tau = V.threshold(negatives, V.leave_one_out(kept, "key", "id"), "key")
    assert tau.first()["tau"] == pytest.approx(0.5 * (0.398 + 2 / 3))
    best = spark.range(1).select(V.best_similarity(F.array(F.split(F.lit("abc"), ""), F.split(F.lit("abd"), "")), F.split(F.lit("zabdz"), "")).alias("s")).first()["s"]
    assert best == 1.0


def test_guards_and_samples(spark):
    clips = spark.createDataFrame([(i, "a" if i % 2 else "b", s) for i, s in enumerate([0.1, 0.5, 0.6, 0.55, 0.5, 2.0, 0.52])], "id int, label string, s double")
    assert sorted(r["id"] for r in V.lengths_guarded(clips, "label", "s").collect()) == [1, 2, 3, 4, 6]
    assert V.hash_sampled(clips, ["label"], "id", 2).count() == 4
    labels = {r["id"]: r["label"] for r in clips.collect()}
    rows = V.triplets(clips, "label", "id").collect()
    assert rows and all(labels[r["anchor"]] == labels[r["positive"]] != labels[r["negative"]] and r["anchor"] != r["positive"] for r in rows)


def test_slots(spark):
    rows = spark.createDataFrame([(bytearray(b"say the word"),), (bytearray(b""),)], "content binary")
    vad = models.slot("vad", "tests.standins:stand_in_speech")
    asr = models.slot("asr", "tests.standins:stand_in_words", failed=[])
    embed = models.slot("embedder", "tests.standins:stand_in_embedder")
    out = models.speech_gate(rows, "content", vad).select(models.complete_words(asr("content"))["word"].alias("w"), embed("content").alias("e")).collect()
    assert sorted(r["w"] for r in out) == [[], ["say", "the", "word"]]
    assert all(sum(x * x for x in r["e"]) == pytest.approx(1, abs=1e-5) for r in out)


def test_detection_schema(spark):
    text = '{"keyword": "k", "chunks": [{"file": "f", "detections": [{"time": 1.0, "score": 2.0}]}]}'
    parsed = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", detections.DETECTIONS).alias("d"))
    fixed = parsed.select(detections.with_default_scale(F.col("d.chunks")[0]["detections"]).alias("x")).first()["x"]
    assert fixed[0]["scale"] == 1.0 and fixed[0]["rescued"] is None


def test_slots_of_two_inputs_and_defaults(spark):
    rows = spark.createDataFrame([(1, "hello", "anna", 3200), (2, "bye", "otto", 100)], "id long, text string, voice string, n int")
    tts = models.slot("tts", "tests.standins:stand_in_voice")
    got = {r["id"]: bytes(r["s"]) for r in rows.select("id", tts("text", "voice").alias("s")).collect()}
    assert got == {1: b"anna:hello", 2: b"otto:bye"}
    demux = models.slot("demux", "tests.standins:failing")
    assert {r["duration"] for r in models.durations_known(rows.withColumn("d", demux("text")), "d").collect()} == {5.0}
    assert sorted(r["id"] for r in models.by_length(rows, "n").collect()) == [1, 2]


def test_phones_and_matchers(spark):
    rows = spark.createDataFrame([(1, bytearray(b"a a <pad> a | b b"), 1.0), (2, bytearray(b"a b"), 0.04), (3, None, 1.0), (4, bytearray(b"fail"), 1.0), (5, bytearray(b"c"), None)], "id int, content binary, seconds double")
    phones = models.slot("phones", "tests.standins:stand_in_phones", failed=None)
    got = {r["id"]: r["phones"] for r in models.recognized_phones(rows, "content", "seconds", phones).collect()}
    assert got == {1: ["a", "a", "b"], 2: [], 3: [], 4: [], 5: []}
    matcher = models.slot("matcher", "tests.standins:stand_in_matcher")
    pairs = spark.createDataFrame([(1, bytearray(b"goal"), "goal"), (2, bytearray(b"nan"), "x"), (3, bytearray(b"gold"), "goal"), (4, bytearray(b"fail"), "x")], "id int, content binary, keyword string")
    assert {r["id"]: r["score"] for r in models.matched(pairs, "content", "keyword", matcher).collect()} == {1: 1.0, 2: None, 3: 0.5, 4: None}


def test_more_slots(spark):
    """Text recognizer, voice conversion and denoiser: values of one or two columns to one."""
    rows = spark.createDataFrame([(1, bytearray(b"say it"), bytearray(b"anna")), (2, bytearray(b""), bytearray(b"otto"))], "id int, content binary, reference binary")
    text = models.slot("asr_text", "tests.standins:stand_in_text")
    voice = models.slot("voice", "tests.standins:stand_in_conversion")
    quiet = models.slot("denoise", "tests.standins:stand_in_denoiser")
    got = {r["id"]: (r["t"], bytes(r["v"]), bytes(r["d"])) for r in rows.select("id", text("content").alias("t"), voice("content", "reference").alias("v"), quiet("content").alias("d")).collect()}
    assert got == {1: ("say it", b"say it as anna", b"say_it"), 2: ("", b" as otto", b"")}
    for kind in ("asr_text", "voice", "denoise"):
        failed = models.slot(kind, "tests.standins:failing")
        inputs = ["content", "reference"] if kind == "voice" else ["content"]
        assert [r["x"] for r in rows.select(failed(*inputs).alias("x")).collect()] == [None, None]


def test_best_of_several_references(spark):
    df = spark.createDataFrame([(1, [list("abc"), list("xyz")], list("aabd")), (2, [], list("a")), (3, None, list("a")), (4, [list("a"), []], [])], "id int, refs array<array<string>>, phones array<string>")
    got = {r["id"]: r["s"] for r in df.select("id", V.best_similarity(F.col("refs"), F.col("phones")).alias("s")).collect()}
    assert got == {1: pytest.approx(2 / 3), 2: 0.0, 3: 0.0, 4: 0.0}


def test_long_sequences_are_linear(spark):
    refs = spark.createDataFrame([("k", i, ["p"] * 20 + [str(i)] + ["q"] * 2000) for i in range(4)], "key string, id int, phones array<string>")
    assert V.leave_one_out(refs, "key", "id").first()["loo_mean"] == pytest.approx(1 - 1 / 2021)
