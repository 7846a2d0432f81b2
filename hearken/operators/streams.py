"""Chunks of a stream: dedupe, order, running time, context bands, windows over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.operators import scans
from hearken.operators.sizes import small


def sequence_key(uri: Column) -> Column:
    """The segment's sequence number where the address has one, else the address."""
    return F.coalesce(F.nullif(F.regexp_extract(uri, r"sq=(\d+)", 1), F.lit("")), uri)


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of every key. One aggregation, which combines before the shuffle."""
    others = [c for c in rows.columns if c not in by]
    first = F.min_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*by).agg(first.alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in others])


def indexed(rows: DataFrame, stream: str, order: list[str]) -> DataFrame:
    """+ chunk_idx from 0, in order, within the stream."""
    return rows.withColumn("chunk_idx", F.row_number().over(W.partitionBy(stream).orderBy(*order)) - 1)


def stream_offsets(chunks: DataFrame, durations: DataFrame, stream: str, default: float = 5.0) -> DataFrame:
    """stream, chunk_idx, offset: time before each chunk over every index from 0, missing ones included.
    A sum over the durations that are known, in blocks of the index, and the default for all others."""
    known = durations.filter((F.col("chunk_idx") >= 0) & F.col("duration").isNotNull()).groupBy(stream, "chunk_idx").agg(F.first("duration").alias("d"))
    marks = known.withColumn("k", F.lit(1)).join(chunks.select(stream, "chunk_idx").distinct().withColumn("_wanted", F.lit(True)), [stream, "chunk_idx"], "full")
    summed = scans.running_sums(marks, [stream], "chunk_idx", scans.stretches("chunk_idx"), {"_seconds": "d", "_known": "k"})
    return summed.filter("_wanted").select(stream, "chunk_idx", (F.col("_seconds") + default * (F.col("chunk_idx") - F.col("_known"))).alias("offset"))


def context(hits: DataFrame, chunks: DataFrame, stream: str, reach: int = 5) -> DataFrame:
    """hits x the chunks from ``reach`` before to ``reach`` after that exist. The band is exploded, so
    the join is on equal keys."""
    wanted = hits.withColumn("near", F.explode(F.sequence(F.greatest(F.col("chunk_idx") - reach, F.lit(0)), F.col("chunk_idx") + reach)))
    there = chunks.select(F.col(stream), F.col("chunk_idx").alias("near"), *[c for c in chunks.columns if c not in (stream, "chunk_idx")])
    return wanted.join(there, [stream, "near"])


def manifest(found: DataFrame, by: list[str], path: str, order: str) -> DataFrame:
    """by + manifest: the paths in order, comma-joined."""
    listed = F.array_sort(F.collect_list(F.struct(order, path)))
    return found.groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s[path]), ",").alias("manifest"))


def concat_list(found: DataFrame, by: list[str], path: str, order: str) -> DataFrame:
    """by + value: the list file of a clip, a line for each path in order, as a concatenating program reads it;
    back strokes become strokes, and a quote in a path is closed, escaped and opened again."""
    quoted = F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("'"), F.lit("'\\''"))
    lines = found.withColumn("_line", F.concat(F.lit("file '"), quoted, F.lit("'\n")))
    listed = F.array_sort(F.collect_list(F.struct(order, "_line")))
    return lines.groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s["_line"]), "").alias("value"))


def named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``names``; a name that stands there twice counts once."""
    return rows.join(small(names.select(key)), key, "left_semi")


def retained(chunks: DataFrame, stream: str, keep: int = 7) -> DataFrame:
    """The chunks not older than ``keep`` before the stream's newest."""
    newest = chunks.groupBy(stream).agg(F.max("chunk_idx").alias("newest"))
    return chunks.join(newest, stream).filter(F.col("chunk_idx") >= F.col("newest") - keep).drop("newest")


def purged(chunks: DataFrame, consumed: DataFrame, stream: str) -> DataFrame:
    """Chunks outside (stream, start, end) ranges consumed; before a start all but chunk 0 go too."""
    gone = chunks.join(consumed, stream).filter(((F.col("chunk_idx") > 0) | (F.col("start") == 0)) & (F.col("chunk_idx") <= F.col("end")))
    return chunks.join(gone.select(stream, "chunk_idx").distinct(), [stream, "chunk_idx"], "left_anti")


def hop_starts(length: Column, window: int = 24000, hop: int = 8000) -> Column:
    """Starts of windows; a short input has one, which is padded."""
    return F.sequence(F.lit(0), F.greatest(length - window, F.lit(0)), F.lit(hop))


def scaled_windows(rows: DataFrame, length: str, window: float, rate: int = 16000, scales: tuple[float, ...] = (0.6, 0.8, 1.0), hop: float = 0.05, least: float = 0.15) -> DataFrame:
    """rows x (scale, size, start) of windows at several scales, without padding."""
    step = max(1, int(hop * rate))
    sizes = F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(max(int(window * rate * s), int(least * rate))).alias("size")) for s in scales])
    fits = rows.withColumn("w", F.explode(sizes)).filter(F.col(length) >= F.col("w.size"))
    return fits.withColumn("start", F.explode(F.sequence(F.lit(0), (F.col(length) - F.col("w.size")).cast("int"), F.lit(step)))).select(*rows.columns, "w.scale", "w.size", "start")


def forward_filled(lines: DataFrame, by: list[str], order: str, header: Column) -> DataFrame:
    """+ header: the last one at or before each line. ``order`` is an index of lines."""
    return scans.running_last(lines, by, order, scans.stretches(order), header, "header")


def rescued(detections: DataFrame, candidates: DataFrame, by: list[str], tolerance: float = 1e-6) -> DataFrame:
    """detections and, marked rescued, the candidates without a detection of equal scale at their time.
    Times meet in cells twice the tolerance wide; a candidate looks into its own and both next."""
    cell = lambda c: F.floor(F.col(c) / (2 * tolerance))
    keyed = candidates.withColumn("cells", F.array(cell("time") - 1, cell("time"), cell("time") + 1)).withColumn("_id", F.monotonically_increasing_id())
    d = detections.select(*by, "scale", F.col("time").alias("t"), cell("time").alias("cell"))
    met = keyed.withColumn("cell", F.explode("cells")).join(d, [*by, "scale", "cell"]).filter(F.abs(F.col("time") - F.col("t")) < tolerance).select("_id").distinct()
    fresh = keyed.join(met, "_id", "left_anti").drop("_id", "cells")
    return detections.withColumn("rescued", F.lit(False)).unionByName(fresh.withColumn("rescued", F.lit(True)))


def pieces(videos: DataFrame, seconds: str, piece: int = 5) -> DataFrame:
    """videos + (chunk_idx, start, end): pieces of whole seconds, the last one as long as is left."""
    length = F.floor(seconds).cast("int")
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(piece)))
    cut = videos.withColumn("start", F.explode(starts))
    return cut.select(*videos.columns, (F.col("start") / piece).cast("int").alias("chunk_idx"), "start", F.least(F.col("start") + piece, length).alias("end"))


def window_records(rows: DataFrame, length: str, size: int, step: int) -> DataFrame:
    """rows + (skipped, n_windows): a chunk shorter than the window keeps its record, marked as skipped."""
    short = F.col(length) < size
    return rows.withColumn("skipped", short).withColumn("n_windows", F.when(short, F.lit(0)).otherwise(F.floor((F.col(length) - size) / step) + 1).cast("long"))


def deduplicated_twice(segments: DataFrame, stream: str, address: str, content: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Segments of new address and, among those, of new content; and (stream, n_skipped), how many of a
    new address repeat a content, which is compared by its md5."""
    fresh = first_of(segments, [stream, address], order).withColumn("_digest", F.md5(content))
    kept = first_of(fresh, [stream, "_digest"], order).drop("_digest")
    skipped = fresh.groupBy(stream).agg((F.count("*") - F.count_distinct("_digest")).alias("n_skipped"))
    return kept, skipped


def first_hits(hits: DataFrame, stream: str, reach: int = 5) -> DataFrame:
    """stream + (chunk_idx, first, last): each stream's first hit and the chunks to cut out around it. The
    first by index, whichever task found it earliest."""
    found = hits.groupBy(stream).agg(F.min("chunk_idx").alias("chunk_idx"))
    return found.select(stream, "chunk_idx", F.greatest(F.col("chunk_idx") - reach, F.lit(0)).alias("first"), (F.col("chunk_idx") + reach).alias("last"))


def padded_span(time: Column, seconds: Column, length: Column, pad: float = 0.08, rate: int = 16000) -> list[Column]:
    """first, last: samples of a detection with ``pad`` seconds on both sides, within the chunk."""
    first = F.greatest(F.lit(0), ((time - pad) * rate).cast("int"))
    return [first.alias("first"), F.least(length, ((time + seconds + pad) * rate).cast("int")).alias("last")]


def stamped(time: Column, pattern: str = "yyyyMMdd-HHmmss") -> Column:
    """A segment's own time as text; not the time of processing."""
    return F.date_format(time, pattern)


def speech_frames(samples: Column, window: int = 12400, shift: int = 1280) -> Column:
    """Frames of a speech embedding that is padded in front by window less shift. A length that is a
    multiple of the shift keeps its frames."""
    return F.greatest(F.floor((samples + (window - shift) - window) / shift) + 1, F.lit(0)).cast("int")
