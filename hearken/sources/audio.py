"""Chunk files: a directory scan in numeric order, decoding, and transcripts."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from hearken.functions import text as T
from hearken.operators import streams as R


def chunk_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, chunk_idx, content); order by chunk_idx for the numeric order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", T.chunk_index(F.col("path")).alias("chunk_idx"), "content")


def decode_wav(content: bytes, rate: int = 16000) -> np.ndarray:
    """Mono samples in -1..1 at ``rate``, by linear interpolation where the file has another."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, has = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    x = x.reshape(-1, channels).mean(axis=1)
    if has != rate and len(x):
        x = np.interp(np.arange(0, len(x), has / rate), np.arange(len(x)), x)
    return x.astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def samples(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for files in parts:
        yield files.map(lambda c: decode_wav(bytes(c)))


def encode_wav(samples: np.ndarray, rate: int = 16000) -> bytes:
    """A mono file of 16 bits; what is over full scale is cut."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(BinaryType())
def wav_files(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Samples as files, for a table of clips."""
    for sounds in parts:
        yield sounds.map(lambda s: None if s is None else encode_wav(s))


def selected_keyword(spark: SparkSession, path: str, default: str | None = None) -> str | None:
    """The first line that is not blank, or the default."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return first[0]["value"].strip() if first else default


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of a transcript document: a header line in brackets, then lines of text."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc"), F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    header = F.nullif(F.regexp_extract("line", r"^\[([^\]]+)\]\s*$", 1), F.lit(""))
    filled = R.forward_filled(lines, ["doc"], "i", header)
    said = filled.filter(F.col("header").isNotNull() & ~F.col("line").rlike(r"^\[[^\]]+\]\s*$") & (F.trim("line") != ""))
    return said.groupBy("doc", "header").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda s: s["line"]), " ").alias("text")).select(F.col("header").alias("file"), "text")


def transcript_lines(rows: DataFrame) -> DataFrame:
    """(file, text) to one block of lines each; an empty text says that there was no speech."""
    said = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("(no speech detected)"))
    return rows.select(F.concat(F.lit("["), "file", F.lit("]\n"), said, F.lit("\n")).alias("value"))
