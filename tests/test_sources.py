import json
import wave

import numpy as np
import pytest

from hearken.sources import audio, detections, playlist, sinks

SEGMENTS = [(3, "u3"), (1, "u1"), (2, "u2")]


def segments():
    return SEGMENTS


def test_wav_directory(spark, tmp_path):
    for i in (10, 2):
        with wave.open(str(tmp_path / f"live_{i}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(np.full(800, 1000, "<i2").tobytes())
    (tmp_path / "note.txt").write_text("x")
    files = audio.chunk_files(spark, str(tmp_path)).withColumn("x", audio.samples("content")).orderBy("chunk_idx").collect()
    assert [f["chunk_idx"] for f in files] == [2, 10] and len(files[0]["x"]) == 1600


def test_transcripts(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("title\n====\n[live_0.wav]\nhello there\nagain\n\n[live_1.wav]\nbye\n")
    assert sorted(map(tuple, audio.transcripts(spark, str(path)).collect())) == [("live_0.wav", "hello there again"), ("live_1.wav", "bye")]
    lines = audio.transcript_lines(spark.createDataFrame([("a.wav", "  ")], "file string, text string")).first()[0]
    assert lines == "[a.wav]\n(no speech detected)\n"


def test_playlist_offsets():
    reader = playlist.PlaylistReader({"fetch": "tests.test_sources:segments"})
    rows, at = reader.read(reader.initialOffset())
    assert [r[1] for r in rows] == [1, 2, 3] and at == {"sequence": 3}
    assert not list(reader.read(at)[0])
    assert [r[2] for r in reader.readBetweenOffsets({"sequence": 1}, {"sequence": 2})] == ["u2"]
    waits, calls = [], iter([OSError(), OSError(), 5])

    def flaky():
        x = next(calls)
        if isinstance(x, OSError):
            raise x
        return x

    assert playlist.retried(flaky, wait=waits.append) == 5 and waits == [5, 10]
    with pytest.raises(OSError):
        playlist.retried(lambda: (_ for _ in ()).throw(OSError()), tries=2, wait=waits.append)


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "k string, v double")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    assert [r["k"] for r in sinks.missing(new, old, ["k"]).collect()] == ["c"]
    sinks.backup_once(old, str(tmp_path / "b"))
    sinks.backup_once(new, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b")).count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"live_0": 4.5, "live_12": 5.0}))
    assert sorted(map(tuple, sinks.durations(spark, str(tmp_path / "d.json")).collect())) == [("live", 0, 4.5), ("live", 12, 5.0)]


def test_wav_round_trip_and_selected_keyword(spark, tmp_path):
    sound = [0.0, 0.5, -0.5, 2.0]
    clip = spark.createDataFrame([(sound,)], "s array<float>").select(audio.samples(audio.wav_files("s")).alias("s")).first()["s"]
    assert [round(x, 3) for x in clip] == [0.0, 0.5, -0.5, 1.0]
    (tmp_path / "k.txt").write_text("\n  penalty \nother\n")
    (tmp_path / "none.txt").write_text("\n")
    assert audio.selected_keyword(spark, str(tmp_path / "k.txt")) == "penalty"
    assert audio.selected_keyword(spark, str(tmp_path / "none.txt"), "goal") == "goal"


def test_declared_documents(spark, tmp_path):
    calibration = {"keyword": "k", "threshold": 2.5, "top_k": 50, "n_pos": 3, "calibrated_at": "2026-07-02T10:00:00", "new_field": 1}
    (tmp_path / "k_calibration.json").write_text(json.dumps(calibration, indent=2))
    row = detections.documents(spark, str(tmp_path / "*_calibration.json"), detections.CALIBRATION).first()
    assert (row["keyword"], row["threshold"], row["top_k"], row["n_pos"], row["neg_p99"]) == ("k", 2.5, 50, 3, None) and len(row) == 16
    (tmp_path / "thresholds.json").write_text('{"goal": 0.4, "penalty": 0.61, "none": null}')
    assert sorted(map(tuple, detections.thresholds(spark, str(tmp_path / "thresholds.json")).collect())) == [("goal", 0.4), ("penalty", 0.61)]
    manifest = {"sample_rate": 16000, "voices": 5, "eval_words": ["goal"], "bank": {"goal": ["a/1.wav"], "cat": ["b/1.wav", "b/2.wav"], "empty": []}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    assert sorted(map(tuple, detections.bank(spark, str(tmp_path / "manifest.json")).collect())) == [("cat", "b/1.wav", False, 16000), ("cat", "b/2.wav", False, 16000), ("goal", "a/1.wav", True, 16000)]
    (tmp_path / "truth.json").write_text('{"live_0.wav": [{"word": "goal", "start": 1.0, "end": 1.5}], "live_1.wav": []}')
    assert list(map(tuple, detections.truth(spark, str(tmp_path / "truth.json")).collect())) == [("live_0.wav", "goal", 1.0, 1.5)]


def test_anchor_and_cohort_tables(spark, tmp_path):
    anchors = [("goal", [0.5, 0.25], [[1.0, 0.0], [0.0, 1.0]], 24000), ("cat", [1.0], [], 100)]
    detections.write_table(spark.createDataFrame(anchors, "keyword string, centroid array<double>, positives array<array<double>>, window_samples int"), str(tmp_path / "a"), detections.ANCHORS)
    found = detections.read_table(spark, str(tmp_path / "a"), detections.ANCHORS)
    assert sorted(map(tuple, found.collect())) == sorted(anchors) and found.dtypes[0] == ("keyword", "string") and found.dtypes[1] == ("centroid", "array<float>")
    cohorts = [("goal", 1, "stream", [0.5]), ("goal", 2, "tts", [0.25])]
    detections.write_table(spark.createDataFrame(cohorts, detections.COHORTS), str(tmp_path / "c"), detections.COHORTS)
    assert sorted(map(tuple, detections.read_table(spark, str(tmp_path / "c"), detections.COHORTS).collect())) == cohorts
