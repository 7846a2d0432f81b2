import json

import pytest
from pyspark.sql import functions as F

from hearken.sources import audio, files


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_json_documents_are_overwritten_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5, None), ("b", 0.7, [1, 2])], "keyword string, threshold double, hits array<int>")
    files.write_json(rows, str(tmp_path), F.concat("keyword", F.lit(".json")))
    files.write_json(rows.filter("keyword = 'a'").withColumn("threshold", F.lit(0.9)), str(tmp_path), F.concat("keyword", F.lit(".json")))
    assert names(tmp_path) == ["a.json", "b.json"]
    assert json.loads((tmp_path / "a.json").read_text()) == {"keyword": "a", "threshold": 0.9}
    assert json.loads((tmp_path / "b.json").read_text()) == {"keyword": "b", "threshold": 0.7, "hits": [1, 2]}


def test_sounds_in_folders(spark, tmp_path):
    clips = spark.createDataFrame([("x", 1, [0.0, 0.5, -1.0]), ("y", 2, None), ("x", 3, [])], "keyword string, n int, s array<float>").repartition(3)
    files.write_wav(clips, str(tmp_path), F.format_string("%s/live_%d.wav", "keyword", "n"), F.col("s"))
    assert names(tmp_path) == ["x/live_1.wav", "x/live_3.wav"]
    found = audio.chunk_files(spark, str(tmp_path / "x")).withColumn("s", audio.samples("content")).orderBy("chunk_idx").collect()
    assert [[round(v, 3) for v in r["s"]] for r in found] == [[0.0, 0.5, -1.0], []]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    (tmp_path / "keep").write_text("old")
    rows = spark.range(40).repartition(8).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.lit("x").cast("binary")).alias("content"))
    with pytest.raises(Exception, match="stop"):
        files.write_files(rows, str(tmp_path))
    assert names(tmp_path) == ["keep"] and [p.name for p in tmp_path.iterdir()] == ["keep"]


def test_names_are_guarded(spark, tmp_path):
    one = lambda *n: spark.createDataFrame([(x, bytearray(b"1")) for x in n], "name string, content binary").repartition(4)
    files.write_files(one("a"), str(tmp_path))
    for bad in (one("a"), one("b", "b"), one("../c"), one("_d"), one("")):
        with pytest.raises(Exception):
            files.write_files(bad, str(tmp_path))
    assert names(tmp_path) == ["a"]
    files.write_files(one("a", "e"), str(tmp_path), replace=True)
    files.write_files(one().filter("false"), str(tmp_path))
    assert names(tmp_path) == ["a", "e"]
