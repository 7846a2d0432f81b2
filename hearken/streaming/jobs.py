"""Structured Streaming jobs. Each runs over what is there and ends, with its state in a checkpoint,
so the same job on a live source goes on where it stopped."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from hearken.functions import text as T
from hearken.streaming import store


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "hearken-streams")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _source(spark: SparkSession, path: str) -> DataFrame:
    # As a pattern, the path may name one file as well as a folder of them.
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """The job's output, as its sink holds it. Updates are appended; the caller takes the last."""
    spark = stream.sparkSession
    folder = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out/*")


def deduplicated(spark: SparkSession, path: str, within: str = "60 days") -> DataFrame:
    """Segments by (user, sequence), the first within the watermark: state is bounded and survives."""
    events = _source(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").alias("k"))
    return _finished(events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["user_id", "k"]), "append").select("user_id", "k", "ts")


def keyword_counts(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """(conv_id, n_turns, n_hits), updated with every batch."""
    turns = _source(spark, path)
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.array_contains(T.token_set(F.col("text")), keyword)).alias("n_hits"))
    found = _finished(counts, "update")
    return found.groupBy("conv_id").agg(F.max_by(F.struct("n_turns", "n_hits"), "batch").alias("l")).select("conv_id", "l.*")


def running_offsets(spark: SparkSession, path: str, default: float = 5.0) -> DataFrame:
    """(stream, n_chunks, total): chunks and running time of each stream, in keyed state."""
    last = F.max_by(F.struct(F.col("chunk_idx").alias("i"), F.col("offset").alias("o"), F.col("duration").alias("d")), "chunk_idx")
    ends = chunk_offsets(spark, path, default).groupBy("stream").agg(last.alias("l"))
    return ends.select("stream", (F.col("l.i") + 1).cast("long").alias("n_chunks"), (F.col("l.o") + F.col("l.d")).alias("total"))


def chunk_offsets(spark: SparkSession, path: str, default: float = 5.0) -> DataFrame:
    """(stream, chunk_idx, offset, duration): every chunk's number and start, from the count and the time
    that its stream's state holds. Chunks of a batch are taken in the order of their time."""
    number = F.col("user_id").alias("stream")
    events = _source(spark, path).select(number, "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("value") <= 300, F.col("value")).otherwise(F.lit(default)).alias("duration"))

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        duration = rows["duration"].to_numpy()
        before = total + duration.cumsum() - duration
        state.update((n + len(rows), total + float(duration.sum())))
        yield pd.DataFrame({"stream": key[0], "chunk_idx": range(n, n + len(rows)), "offset": before, "duration": duration})

    schema = "stream long, chunk_idx int, offset double, duration double"
    stateful = events.groupBy("stream").applyInPandasWithState(advance, schema, "n long, total double", "append", "NoTimeout")
    return _finished(stateful, "append").drop("batch")


def context(spark: SparkSession, path: str, least: float, reach: str, late: str = "1 hour") -> DataFrame:
    """(user_id, hit, near): events over ``least`` and all of their stream within ``reach`` before and after.
    A join of two streams, so a hit waits for what follows it. Either side is kept for ``reach`` and as long as
    events may come ``late``."""
    events = _source(spark, path).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    hits = events.filter(F.col("value") > least).select(F.col("user_id").alias("stream"), F.col("event_id").alias("hit"), F.col("ts").alias("at")).withWatermark("at", late)
    chunks = events.select("user_id", F.col("event_id").alias("near"), "ts").withWatermark("ts", late)
    band = F.expr(f"user_id = stream AND ts >= at - INTERVAL {reach} AND ts <= at + INTERVAL {reach}")
    return _finished(hits.join(chunks, band), "append").select("user_id", "hit", "near")


def detection_log(spark: SparkSession, path: str, least: float) -> DataFrame:
    """(line): a line of log for each detection. Every batch writes its own folder, so a batch that is
    run again after a failure replaces its lines and does not repeat them."""
    found = _source(spark, path).filter(F.col("value") > least)
    lines = found.select(F.format_string("[stream %d] %s at chunk %d", "user_id", "event_type", "event_id").alias("value"))
    folder = _folder(spark)

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").text(f"{folder}/log/batch={number}")

    lines.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(append).trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(f"{folder}/log").select(F.col("value").alias("line"))


def first_hits(spark: SparkSession, path: str, least: float) -> DataFrame:
    """(user_id, first_hit): each stream's first event over ``least`` by its number, whichever arrives first."""
    hits = _source(spark, path).filter(F.col("value") > least).groupBy("user_id").agg(F.min("event_id").alias("first_hit"))
    return _finished(hits, "update").groupBy("user_id").agg(F.min("first_hit").alias("first_hit"))


def supervised(start: Callable[[], StreamingQuery], tries: int = 5, wait: float = 5.0, longest: float = 30.0) -> int:
    """Run a query to its end, starting it again from its checkpoint when it fails: after ``wait`` seconds
    more each time, ``longest`` at most. Returns how often it was started; the last failure is raised."""
    for attempt in range(1, tries + 1):
        try:
            start().awaitTermination()
            return attempt
        except StreamingQueryException:
            if attempt == tries:
                raise
            time.sleep(min(wait * attempt, longest))
    raise ValueError("tries must be positive")


def chunk_store(spark: SparkSession, path: str, least: float, reach: int, keep: int, after_ms: int, delay: str) -> DataFrame:
    """(stream, chunk_idx, reason): the chunks that go from a store of events, of which those over ``least``
    consume the ``reach`` before them; retention, consumption and expiry as in ``streaming.store``."""
    events = _source(spark, path).select(F.col("user_id").alias("stream"), F.col("event_id").alias("chunk_idx"), F.col("ts").cast("timestamp").alias("at"), "value")
    consumed = events.filter(F.col("value") > least).select("stream", F.greatest(F.col("chunk_idx") - reach, F.lit(0)).alias("first"), F.col("chunk_idx").alias("last"), "at")
    with store.rocks(spark):
        return _finished(store.gone_chunks(store.events_of(events, consumed), keep, after_ms, delay), "append").drop("batch")
