"""Sinks: keyed upsert, backup once, append logs, resumed materialization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of equal keys."""
    return existing.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def write_version(df: DataFrame, folder: str, version: str) -> str:
    """A new output beside the old ones, never in place."""
    df.write.mode("errorifexists").json(f"{folder}/version={version}")
    return f"{folder}/version={version}"


def backup_once(df: DataFrame, folder: str) -> None:
    df.write.mode("ignore").json(folder)


def append_log(detections: DataFrame, folder: str, line: Column | None = None) -> None:
    text = line if line is not None else F.format_string("[%s] '%s' at %.2fs (%.3f)", "stream", "keyword", "start", "confidence")
    detections.select(text.alias("value")).write.mode("append").text(folder)


def missing(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed job has left to do."""
    return wanted.join(done.select(*key), key, "left_anti")


def durations(spark: SparkSession, path: str) -> DataFrame:
    """(stream, chunk_idx, duration) of a JSON object '{prefix}_{index}' -> seconds."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("k", "duration"))
    return read.select(F.regexp_extract("k", r"^(.*)_\d+$", 1).alias("stream"), F.regexp_extract("k", r"_(\d+)$", 1).cast("int").alias("chunk_idx"), "duration")
