"""Running sums and fills in two levels, so that one large key is the work of many tasks.

Rows of a key are cut into blocks along their order. Each block's sum is one row, combined before the
shuffle; what stands before a block is a window over a key's blocks, which are few; inside, the window is
over one block. A block is named by the caller: stretches of an index, or ranges between quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.operators.sizes import written

#: Places of an index in one block, and blocks of an order without an index.
STRETCH, RANGES = 1 << 16, 64


def stretches(index: str, size: int = STRETCH) -> Column:
    """Blocks of an order that is an index: so many places each."""
    return F.floor(F.col(index) / size)


def ranges(rows: DataFrame, order: str, n: int = RANGES) -> Column:
    """Blocks of about as many rows each, between quantiles of all keys' rows together. Equal values are of
    one block, so they should have been counted together before. One pass; the driver gets ``n`` numbers."""
    bounds = rows.agg(F.percentile_approx(F.col(order).cast("double"), [k / n for k in range(1, n)], 1000)).first()[0]
    at = F.lit(0)
    for b in sorted(set(bounds or [])):
        at = at + (F.col(order) > F.lit(b)).cast("int")
    return at


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, of which null is one."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(rows: DataFrame, by: list[str], order: str, block: Column, sums: dict[str, str]) -> DataFrame:
    """rows + for each (new, column) of ``sums`` what the column sums to in the rows of the key before this
    one; rows of a key have different places in the order."""
    cut = rows.withColumn("_block", block)
    totals = cut.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_sum_{new}") for new, c in sums.items()])
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select(*by, "_block", *[F.sum(f"_sum_{new}").over(before).alias(f"_before_{new}") for new in sums])
    inside = W.partitionBy(*by, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    part = cut.withColumns({f"_inside_{new}": F.sum(c).over(inside) for new, c in sums.items()})
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined(part, ahead, [*by, "_block"]).select(*rows.columns, *[(zero(f"_before_{new}") + zero(f"_inside_{new}")).alias(new) for new in sums])


def running_last(rows: DataFrame, by: list[str], order: str, block: Column, value: Column, name: str) -> DataFrame:
    """rows + the last value that is not null in the rows of the key up to this one."""
    cut = rows.withColumn("_block", block).withColumn("_value", value)
    lasts = cut.filter(F.col("_value").isNotNull()).groupBy(*by, "_block").agg(F.max_by("_value", order).alias("_last"))
    blocks = joined(cut.select(*by, "_block").distinct(), lasts, [*by, "_block"], "left")
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ahead = blocks.select(*by, "_block", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = W.partitionBy(*by, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    part = cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    return joined(part, ahead, [*by, "_block"]).select(*rows.columns, F.coalesce("_inside", "_before").alias(name))


def segments(rows: DataFrame, by: list[str], place: Column, reach: float, name: str = "_segment") -> DataFrame:
    """rows + a number of the segment: places of a key that lie ``reach`` or less apart are of one, and so are
    those that such steps join; others may be. Places fall into cells ``reach`` wide, and a segment is a
    stretch of cells that are all there: its first cell names it. The cells are written once; ``rows`` are read
    twice and should be cheap to read."""
    placed = rows.withColumn("_cell", F.floor(place / reach))
    cells = written(placed.select(*by, "_cell").distinct(), "cells")
    after = cells.select(*by, (F.col("_cell") + 1).alias("_cell"), F.lit(True).alias("_goes_on"))
    marked = joined(cells, after, [*by, "_cell"], "left")
    numbered = running_last(marked, by, "_cell", stretches("_cell", 1 << 12), F.when(F.col("_goes_on").isNull(), F.col("_cell")), name).drop("_goes_on")
    return joined(placed, numbered, [*by, "_cell"]).drop("_cell")


def numbered(rows: DataFrame, order: str, name: str = "_place", n: int = RANGES) -> DataFrame:
    """rows + their place in an order of different numbers, from 0: each block counts alone."""
    one = rows.withColumns({"_one": F.lit(1), "_all": F.lit(0)})
    return running_sums(one, ["_all"], order, ranges(rows, order, n), {name: "_one"}).drop("_one", "_all")
