"""What several operators need: tables in the shared folder, and checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import inspect
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent a local master gets a temporary folder; on a cluster that would
    lose data with its machine, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "hearken-shared")


#: Shuffle files of a finished query are of no more use once its result is stored.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that a Python worker gets at once, and rows of Parquet that are unfolded at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ = "spark.sql.parquet.columnarReaderBatchSize"


def stored(df: DataFrame, name: str, batch: int = 2000) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a cut of the lineage that
    survives lost executors and that later passes read by column. Removed with the application.
    Python workers get ``batch`` rows at once on the way, which should be few where rows are wide; such rows are
    read few at once as well, as a column of thousands is one array of the heap."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    was = {k: spark.conf.get(k, v) for k, v in ((CLEANUP, "false"), (BATCH, "10000"), (READ, "4096"))}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(batch))
    spark.conf.set(READ, str(min(4096, max(256, batch))))
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    deleted_on_exit(spark, path)
    for paths in _watched:
        paths.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def deleted_on_exit(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


_watched: list[list[str]] = []


@contextmanager
def watched() -> Iterator[list[str]]:
    """The paths of the tables stored meanwhile, for ``removed`` once what was made of them is written."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched[:] = [p for p in _watched if p is not paths]


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more. Broadcasts of the queries that wrote them stay on all
    executors until the driver collects its garbage, so it does."""
    for path in paths:
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    if paths:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    paths.clear()


def settled(out: DataFrame, paths: list[str]) -> DataFrame:
    """``out``, after deleting those of the stored tables that it does not read."""
    read = {part for file in out.inputFiles() for part in file.split("/")}
    removed(out.sparkSession, [p for p in paths if p.rpartition("/")[2] not in read])
    return out


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_kept: list[tuple[str, Callable]] = []


def kept(most: int) -> Callable:
    """As ``lru_cache``: a worker's next tasks find what this one has made, but only tasks of the same module;
    the first ``lean`` task of another one lets it go."""

    def with_cache(make: Callable) -> Callable:
        found = lru_cache(maxsize=most)(make)
        _kept.append((make.__module__, found))
        return found

    return with_cache


def _let_go(module: str) -> None:
    others = [found for of, found in _kept if of != module and found.cache_info().currsize]
    for found in others:
        found.cache_clear()
    if others:
        _give_back()


def lean(work: Callable) -> Callable:
    """The same work of a task, over batches or on one group. Before it the Python worker, which stays for other
    tasks, lets go what other modules have ``kept`` in it; after it, it gives memory back that is free in it."""
    if inspect.isgeneratorfunction(work):

        def over_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _let_go(work.__module__)
            try:
                yield from work(batches)
            finally:
                _give_back()

        return over_batches

    def on_group(table: pa.Table) -> pa.Table:
        _let_go(work.__module__)
        try:
            return work(table)
        finally:
            _give_back()

    return on_group


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row."""
    total = F.lit(16)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(f"`{field.name}`"), F.lit(0)) + 8
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0))
        else:
            total = total + 8
    return total


#: Bytes of one broadcast at most.
MOST_BYTES = 128 << 20


def small(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows and ``most_bytes`` bytes, else as
    it is, so that the join shuffles. ``df`` should be cheap to read: a stored or tiny table."""
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= most_rows and found["bytes"] <= most_bytes else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that ``taken`` has in any case."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
        have.add(name.lower())
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else: ``lower`` alone would also change accented letters."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
