"""Slots for models: what a recognizer, detector, embedder or synthesizer must be to take part.

A slot is a factory named ``module:name``; each worker calls it once and the result maps the values of
a row: one for most kinds, text and voice for a synthesizer, sound and reference for a conversion,
sound and keyword for a matcher.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hearken.functions import text as T

WORDS = "array<struct<word:string,start:double,end:double,score:double>>"
SLOTS = {"asr": WORDS, "asr_text": "string", "vad": "boolean", "tts": "binary", "voice": "binary", "embedder": "array<float>", "phones": "array<string>", "g2p": "array<string>", "demux": "struct<content:binary,duration:double>", "denoise": "binary", "matcher": "double"}


def slot(kind: str, factory: str, failed=None) -> Callable[..., Column]:
    """A vectorized function of the slot's kind. A row that the model fails on gets ``failed``, as a
    chunk whose speech gate fails must be kept; one that lacks an input does not go to the model."""

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        module, name = factory.split(":")
        model = getattr(importlib.import_module(module), name)()
        for inputs in parts:
            out = []
            # A single column comes as itself and not as a tuple of one.
            for row in zip(*(inputs if isinstance(inputs, tuple) else (inputs,)), strict=True):
                try:
                    out.append(failed if any(v is None for v in row) else model(*row))
                except (ValueError, OSError, RuntimeError):
                    out.append(failed)
            yield pd.Series(out, dtype=object)

    # A batch of structs, as some kinds return, goes as a table.
    def tables(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        names = [f.split(":")[0] for f in SLOTS[kind][len("struct<") : -1].split(",")]
        for out in run(parts):
            yield pd.DataFrame([x if x is not None else (None,) * len(names) for x in out], columns=names)

    return F.pandas_udf(tables if SLOTS[kind].startswith("struct<") else run, SLOTS[kind])


def by_length(chunks, length: str, step: int = 1600, parts: int | None = None):
    """Chunks dealt by their length in steps, so that a model's batches hold sounds of about one length
    and none is padded far. Parts are ranges of lengths; chunks of one step, which may be nearly all, are
    dealt to many parts by a hash of the row. ``parts`` are as many as the session's shuffles have by default:
    a model's time is in its rows, so small parts stay apart."""
    spread = chunks.withColumn("_step", F.floor(F.col(length) / step)).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in chunks.columns]), F.lit(1024)))
    return spread.repartitionByRange(parts or int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_step", "_salt").sortWithinPartitions("_step").drop("_step", "_salt")


def durations_known(chunks, demuxed: str, default: float = 5.0):
    """chunks + duration of the ``demux`` slot's result; the default where it failed."""
    return chunks.withColumn("duration", F.coalesce(F.col(f"{demuxed}.duration"), F.lit(default)))


def speech_gate(chunks, content: str, vad: Callable[..., Column]):
    """Chunks with speech; where the detector fails, the chunk stays. Put it before the recognizer."""
    return chunks.filter(F.coalesce(vad(content), F.lit(True)))


def complete_words(words: Column) -> Column:
    """Without words that lack a field."""
    return F.filter(words, lambda w: w["word"].isNotNull() & w["start"].isNotNull() & w["end"].isNotNull() & w["score"].isNotNull())


def recognized_phones(chunks, content: str, seconds: str, recognizer: Callable[..., Column], least: float = 0.05):
    """chunks + phones of the ``phones`` slot's frames: without repeats of a frame and special tokens. A sound
    shorter than ``least`` seconds, or of unknown length, has none and does not go to the model; nor has one
    that the model fails on."""
    none = F.array().cast("array<string>")
    asked = F.when(F.col(seconds) >= least, F.col(content))
    frames = F.when(asked.isNotNull(), recognizer(asked))
    return chunks.withColumn("phones", F.coalesce(T.ctc_collapse(frames), none))


def matched(chunks, content: str, keyword: str, matcher: Callable[..., Column]):
    """chunks + score of the ``matcher`` slot for a sound and a keyword; null where it failed, and a score that
    is not a number is null too, as it would stand above all others."""
    score = matcher(content, keyword)
    return chunks.withColumn("score", F.when(~F.isnan(score), score))
