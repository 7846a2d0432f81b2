"""Vectors as arrays of doubles, inside generated code or array folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalized(v: Column) -> Column:
    """v / max(norm, 1e-12)."""
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def rms(v: Column) -> Column:
    return F.sqrt(dot(v, v) / F.size(v))


def rms_change(before: Column, after: Column) -> list[Column]:
    """RMS before and after, and the change in percent of the first, taken as 1e-9 at least."""
    first, last = rms(before), rms(after)
    return [first, last, 100 * (last - first) / F.greatest(first, F.lit(1e-9))]


def blend(a: Column, b: Column, alpha: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: alpha * x + (1 - alpha) * y)


def fixed_length(v: Column, n: int) -> Column:
    """Cut or zero-padded to n."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def fit_rows(matrix: Column, rows: Column | int, width: int) -> Column:
    """A matrix cut or padded with zero rows to ``rows``."""
    rows = F.lit(rows) if isinstance(rows, int) else rows
    empty = F.array_repeat(F.array_repeat(F.lit(0.0), width), rows)
    return F.slice(F.concat(matrix, empty), 1, rows)


def embedding_frames(samples: Column) -> Column:
    """Frames of a text-embedding grid for so many samples: 24000 -> 18, 32000 -> 24."""
    return F.floor(F.floor((samples - 400) / 160 + 1) / 8).cast("int")


def prefix_mask(length: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i < length)
