"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

A stage takes what its predecessor kept. Rejected documents go at quality; of every group of near
duplicates the one with the smallest id stays; documents that hold a benchmark passage go; secrets
become a mark in their texts, and every document stays; the last stage encodes the texts and
checks that decoding gives the texts. All but the last return the columns of ``documents``.

Null and empty texts, and all of under fifty words, go at quality, as the base rule rejects them. Of
rows that repeat both id and text one stays at the near duplicates; a null id takes part in all stages.
Of two documents of one group and id, the one of the smaller text hash stays. Stages match rows by id
and text and keep every further column, whatever its name; an empty table gives an empty result.
The operators are in ``hearken.llm``, without which this module cannot be imported.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import decontamination, jaccard_join, quality, secret_scan, sentencepiece_codec
from hearken.llm.shared import settled, stored, table, watched

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """A stage that deletes the tables it has stored on the way, but for the few that its result reads. Results
    of other stages and of other runs stay as they are, so stages may follow each other unwritten."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with watched() as paths:
            return settled(work(spark, docs, sf_dir), paths)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: whether decoding the ids gives the text."""
    encoded = sentencepiece_codec.encode(docs, ["doc_id"], checked=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: SQL has no perplexity model, no test battery and no piece model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
