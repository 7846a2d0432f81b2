"""Exact percentiles by radix selection: four passes of histograms, sixteen bits at a time.

A number's bits, turned so that their order is that of the numbers, are looked at from the top. Each pass
counts the next sixteen bits of the numbers that begin like a wanted one, which combines before the
shuffle, and the count says which of them the wanted one has. No task holds a key's values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, LongType

from hearken.operators.sizes import MOST_ROWS, written


@F.pandas_udf(LongType())
def _bits(x: pd.Series) -> pd.Series:
    """Signed integers in the order of the numbers; what is not a number stands last, as zero and its
    negative are one."""
    raw = np.where(np.isnan(x), np.nan, x.to_numpy() + 0.0).view(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw))


@F.pandas_udf(DoubleType())
def _numbers(bits: pd.Series) -> pd.Series:
    raw = bits.to_numpy(np.int64)
    return pd.Series(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw).view(np.float64))


def percentiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """by + each name's percentile (a share of 0 to 1), linear between neighbours. Nulls do not count; a key
    without numbers has no row. The (key, number) pairs are written once for the passes, and after each of them
    a row for each key and rank."""
    numbers = rows.select(*by, value.cast("double").alias("_x")).filter(F.col("_x").isNotNull()).withColumn("_bits", _bits("_x")).drop("_x")
    numbers = written(numbers.withColumn("_all", F.lit(0)), "percentiles")
    by = [*by, "_all"]
    counts = numbers.groupBy(*by).agg(F.count("*").alias("_n"))
    few = counts.count() * 2 * len(wanted) <= MOST_ROWS
    place = lambda q: F.lit(q) * (F.col("_n") - 1)
    sides = [F.struct(F.lit(name).alias("_name"), F.lit(up).alias("_up"), (F.ceil(place(q)) if up else F.floor(place(q))).alias("_rank"), (place(q) - F.floor(place(q))).alias("_part")) for name, q in wanted.items() for up in (False, True)]
    state = counts.select(*by, F.explode(F.array(*sides)).alias("s")).select(*by, "s.*", F.lit(None).cast("long").alias("_head"))
    for shift in (48, 32, 16, 0):
        heads = state.select(*by, "_head").distinct()
        head = F.lit(None).cast("long") if shift == 48 else F.shiftright("_bits", shift + 16)
        begun = numbers.withColumn("_head", head).alias("n")
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*by, "_head"]]
        looked = begun if shift == 48 else begun.join((F.broadcast(heads) if few else heads).alias("h"), same, "left_semi")
        digits = looked.groupBy(*by, F.shiftright("_bits", shift).alias("_digit")).agg(F.count("*").alias("_times"))
        digits = digits.withColumn("_head", head if shift == 48 else F.shiftright("_digit", 16))
        before = W.partitionBy(*by, "_head").orderBy("_digit").rowsBetween(W.unboundedPreceding, -1)
        digits = digits.withColumn("_before", F.coalesce(F.sum("_times").over(before), F.lit(0)))
        found = state.alias("s").join(digits.alias("d"), [F.col(f"s.{c}").eqNullSafe(F.col(f"d.{c}")) for c in [*by, "_head"]] + [F.col("_rank") >= F.col("_before"), F.col("_rank") < F.col("_before") + F.col("_times")])
        state = written(found.select(*[F.col(f"s.{c}").alias(c) for c in by], "_name", "_up", (F.col("_rank") - F.col("_before")).alias("_rank"), "_part", F.col("_digit").alias("_head")), "percentiles")
    ends = state.withColumn("_v", _numbers("_head")).groupBy(*by, "_name").agg(F.max(F.when(~F.col("_up"), F.col("_v"))).alias("_low"), F.max(F.when(F.col("_up"), F.col("_v"))).alias("_high"), F.max("_part").alias("_part"))
    between = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low")))
    values = ends.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, between)).alias(name) for name in wanted])
    return values.drop("_all")
