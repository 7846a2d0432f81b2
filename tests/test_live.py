import json
import random

import pytest
from pyspark.sql import functions as F

from hearken.operators import streams as R
from hearken.sources import playlist
from hearken.streaming import store

STATE = "/tmp/hearken-live-test"
SCHEMA = "stream long, kind string, first long, last long, at timestamp"


def live():
    """The list in a file: a window that moves on, and an error where the file says so."""
    with open(f"{STATE}.list") as f:
        listed = json.load(f)
    if listed == "down":
        raise OSError("no list")
    return [tuple(s) for s in listed]


def content(uri):
    with open(f"{STATE}.gone") as f:
        if uri in json.load(f):
            raise OSError("expired")
    return f"bytes of {uri}".encode()


def put(listed, gone=()):
    for name, value in (("list", listed), ("gone", list(gone))):
        with open(f"{STATE}.{name}", "w") as f:
            json.dump(value, f)


def reader(tmp_path, **more):
    return playlist.SegmentReader({"fetch": "tests.test_live:live", "get": "tests.test_live:content", "log": str(tmp_path / "log"), "poll": "0", "tries": "1"} | more)


def taken(r, start, end):
    return [(n, u, c) for p in r.partitions(start, end) for _, n, u, c in r.read(p)]


def test_segments_are_kept_until_committed(tmp_path):
    put([[3, "u3"], [4, "u4"], [5, "u5"]])
    r = reader(tmp_path)
    start = r.initialOffset()
    end = r.latestOffset()
    assert end == {"sequence": 5, "count": 3}
    first = taken(r, start, end)
    assert [n for n, _, _ in first] == [3, 4, 5] and first[0][2] == b"bytes of u3"
    # The list moves on and the bytes expire before the batch counts; a new reader runs it again.
    put([[6, "u6"]], gone=["u3", "u4", "u5"])
    again = reader(tmp_path)
    assert taken(again, start, end) == first
    later = again.latestOffset()
    assert later == {"sequence": 6, "count": 4} and [n for n, _, _ in taken(again, end, later)] == [6]
    again.commit(end)
    assert [n for n, _, _ in taken(again, end, later)] == [6] and not taken(again, start, end)
    again.commit(later)
    put("down")
    assert reader(tmp_path).latestOffset() == later
    put([[6, "u6"], [7, "u7"], [9, "u9"]])
    assert reader(tmp_path).latestOffset() == {"sequence": 9, "count": 6}
    kept = sorted(p.name for p in (tmp_path / "log").iterdir())
    assert kept == ["ends.json", "list-000000000000007.json"]


def test_a_bounded_source_ends(tmp_path):
    put([[n, f"u{n}"] for n in range(10, 20)])
    r = reader(tmp_path, target="4", each="3")
    end = r.latestOffset()
    assert end == {"sequence": 13, "count": 4} and [len(p.segments) for p in r.partitions(r.initialOffset(), end)] == [3, 1]
    r.commit(end)
    put([[n, f"u{n}"] for n in range(15, 25)])
    assert r.latestOffset() == end


def test_stream_survives_a_failing_batch(spark, tmp_path):
    """A batch fails after its segments were read; the list moves on; the run after it has them all."""
    spark.dataSource.register(playlist.Live)
    put([[1, "u1"], [2, "u2"]])
    stream = spark.readStream.format("segments").option("fetch", "tests.test_live:live").option("get", "tests.test_live:content").option("log", str(tmp_path / "log")).option("poll", "0").option("target", "4").load()
    seen, failing = [], [True]

    def take(batch, number):
        rows = [tuple(r) for r in batch.collect()]
        if failing and rows:
            failing.clear()
            put([[2, "u2"], [3, "u3"], [4, "u4"], [5, "u5"]], gone=["u1", "u2"])
            raise RuntimeError("the sink is down")
        seen.extend(rows)

    start = lambda: stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").foreachBatch(take).start()
    with pytest.raises(Exception):
        start().awaitTermination(120)
    assert not seen
    assert playlist.run_until(start(), 4, longest=120) == 4
    assert sorted((n, c) for _, n, _, c in seen) == [(n, f"bytes of u{n}".encode()) for n in (1, 2, 3, 4)]


def events(rng, n=300):
    rows = []
    for _ in range(n):
        s, i = rng.choice([1, 1, 1, 2, 3]), rng.randrange(0, 60)
        minute = 3 * i + rng.randrange(0, 3)
        if rng.random() < 0.02 and i > 40:
            rows.append((s, "range", i - 45, i - 40, minute))
        else:
            rows.append((s, "chunk", i, i, minute))
    return rows


def test_store_matches_batch_form_over_restarts(spark, tmp_path):
    """The same chunks are left whether the events come in one batch, in several runs from one checkpoint, with a
    batch that fails and runs again, or are looked at as tables."""
    rng = random.Random(6)
    rows = sorted(set(events(rng)), key=lambda r: (r[4], rng.random()))
    as_time = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60).alias("at")
    table = spark.createDataFrame(rows, "stream long, kind string, first long, last long, minute long").select("stream", "kind", "first", "last", as_time)
    keep, after, delay = 50, 60 * 60_000, 30

    def run(name, parts, fail=False):
        folder, out, failing = tmp_path / name, [], [fail]
        for k, part in enumerate(parts):
            part.coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))

            def take(batch, number):
                found = [tuple(r) for r in batch.collect()]
                if failing[0] and found:
                    failing[0] = False
                    raise RuntimeError("the sink is down")
                out.extend(found)

            for _ in range(2):
                try:
                    with store.rocks(spark):
                        gone = store.gone_chunks(stream, keep, after, f"{delay} minutes")
                        gone.writeStream.option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
                    break
                except Exception:
                    assert fail
        return out

    whole = run("one", [table])
    cut = F.col("at") < F.timestamp_seconds(F.lit(1_700_000_000 + 90 * 60))
    parts = run("two", [table.filter(cut), table.filter(~cut)], fail=True)
    chunks = table.filter("kind = 'chunk'").select("stream", F.col("first").alias("chunk_idx"), "at").groupBy("stream", "chunk_idx").agg(F.min("at").alias("at"))
    consumed = table.filter("kind = 'range'").select("stream", "first", "last")
    now = (1_700_000_000 + (max(r[4] for r in rows) - delay) * 60) * 1000
    left = {(r["stream"], r["chunk_idx"]) for r in store.kept_chunks(chunks, consumed, keep, after, now).collect()}
    every = {(r["stream"], r["chunk_idx"]) for r in chunks.collect()}
    for found in (whole, parts):
        assert every - {(s, c) for s, c, _ in found} == left
    assert {w for _, _, w in parts} == {"consumed", "old", "expired"} and left and len(parts) == len({(s, c) for s, c, _ in parts})


def test_purged_and_retained_tables(spark):
    chunks = spark.createDataFrame([(1, i) for i in range(12)], "stream long, chunk_idx long")
    ranges = spark.createDataFrame([(1, 2, 5)], "stream long, start long, end long")
    assert {r["chunk_idx"] for r in R.purged(R.retained(chunks, "stream", 8), ranges, "stream").collect()} == set(range(6, 12))
