"""Verification of detections by phoneme sequences, sampling and reference sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.functions import text as T
from hearken.operators import selection


def best_similarity(references: Column, phones: Column) -> Column:
    """The best similarity of several references to a sequence of phones."""
    return T.best_infix_similarity(references, phones)


def distinct_references(refs: DataFrame, key: str, order: str, most: int, least_phones: int = 3) -> DataFrame:
    """The first ``most`` different references of a key that have enough phones."""
    long_enough = refs.filter(F.size("phones") >= least_phones)
    first = long_enough.groupBy(key, "phones").agg(F.min(order).alias(order))
    ranked = first.withColumn("k", F.row_number().over(W.partitionBy(key).orderBy(order)))
    return ranked.filter(F.col("k") <= most).drop("k")


def leave_one_out(refs: DataFrame, key: str, id_: str) -> DataFrame:
    """key + loo_mean: each reference's best similarity to the others, on average; 1 for a lone one."""
    other = refs.select(F.col(key), F.col(id_).alias("_o"), F.col("phones").alias("_p"))
    best = refs.join(other, key).filter(F.col(id_) != F.col("_o")).groupBy(key, id_).agg(F.max(T.infix_similarity(F.col("phones"), F.col("_p"))).alias("s"))
    return refs.select(key).distinct().join(best.groupBy(key).agg(F.avg("s").alias("m")), key, "left").select(key, F.coalesce("m", F.lit(1.0)).alias("loo_mean"))


def threshold(negatives: DataFrame, loo: DataFrame, key: str, percent: float = 0.99, least: float = 0.5) -> DataFrame:
    """key + tau: midway between the negatives' percentile and the leave-one-out mean, ``least`` at least."""
    high = selection.percentiles(negatives, [key], F.col("similarity"), {"p": percent})
    return high.join(loo, key).select(key, F.greatest(F.lit(least), 0.5 * (F.col("p") + F.col("loo_mean"))).alias("tau"))


def verified(detections: DataFrame, tau: DataFrame, key: str) -> DataFrame:
    """detections + phone_verified, by the unrounded similarity; a new table, so a second run finds the same."""
    return detections.join(tau, key).withColumn("phone_verified", F.col("phone_sim") >= F.col("tau")).withColumn("phone_sim", F.round("phone_sim", 3))


def lengths_guarded(clips: DataFrame, key: str, seconds: str, least: float = 0.15, times: float = 1.8, most: float | None = None) -> DataFrame:
    """Clips neither shorter than ``least`` nor longer than ``times`` their key's median, nor than
    ``most`` seconds where that is given."""
    whole = clips.filter((F.col(seconds) >= least) & (F.lit(True) if most is None else F.col(seconds) <= most))
    median = selection.percentiles(whole, [key], F.col(seconds), {"_median": 0.5})
    return whole.join(median, key).filter(F.col(seconds) <= times * F.col("_median")).drop("_median")


def hash_sampled(rows: DataFrame, by: list[str], id_: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each key in an order fixed by a hash: the same on every run."""
    order = W.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", F.col(id_).cast("string"), F.lit(str(seed)))), id_)
    return rows.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_k")


def triplets(clips: DataFrame, label: str, id_: str, seed: int = 0) -> DataFrame:
    """(anchor, positive, negative) ids: a clip, the next of its class and the first of the next class
    in hash order; classes of one clip make none."""
    h = F.md5(F.concat_ws("|", F.col(id_).cast("string"), F.lit(str(seed))))
    ring = clips.select(label, id_, h.alias("h"))
    w = W.partitionBy(label).orderBy("h", id_)
    pairs = ring.withColumn("positive", F.lead(id_).over(w)).filter("positive IS NOT NULL")
    heads = ring.groupBy(label).agg(F.min_by(id_, F.struct("h", id_)).alias("negative"))
    # The next class round the ring is the smallest label above, or the smallest of all: both are
    # minima, which combine before the exchange; no task orders all classes.
    above = heads.select(F.col(label).alias("_next"))
    following = heads.select(label).join(above, F.col("_next") > F.col(label)).groupBy(label).agg(F.min("_next").alias("_next"))
    least = above.agg(F.min("_next").alias("_least"))
    rounded = heads.select(label).join(following, label, "left").crossJoin(least).select(label, F.coalesce("_next", "_least").alias("_next")).filter(F.col(label) != F.col("_next"))
    negatives = rounded.join(heads.select(F.col(label).alias("_next"), "negative"), "_next").select(label, "negative")
    return pairs.join(negatives, label).select(F.col(id_).alias("anchor"), "positive", "negative")
