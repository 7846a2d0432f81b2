"""Checked sizes: what may be broadcast, and inputs of too few parts for the cores. Written tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a broadcast table at most.
MOST_ROWS, MOST_BYTES = 100_000, 64 << 20


def _wide(df: DataFrame) -> Column:
    """About the bytes of a row. Strings and arrays of numbers are measured by length, only nested columns as text."""
    total = F.lit(8 * len(df.columns))
    for field in df.schema.fields:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if kind.typeName() in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.typeName() == "array" and kind.elementType.typeName() in ("double", "float", "long", "integer", "boolean"):
            total = total + 8 * F.greatest(F.size(c), F.lit(0))
        elif kind.typeName() in ("array", "map", "struct"):
            total = total + F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
    return total


def small(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes are within the bounds, else as it is, and the
    join shuffles. For configuration and other tables that are cheap to compute twice."""
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(_wide(df).cast("long")), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if found["n"] <= most_rows and found["b"] <= most_bytes else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, by ``spark.checkpoint.dir``; a local master may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "hearken-tables")
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that goes with the application."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, read back: computed once for several passes, and there also
    when an executor is lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is read from fewer files than there are cores; a table of many
    files stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
