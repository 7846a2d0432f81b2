"""Evaluation: confusion counts, rates, threshold sweep, rank AUC and interval matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.operators import scans


def confusion(rows: DataFrame, by: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    return rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))


def rates(tp: Column, fp: Column, fn: Column, empty_precision: float = 0.0) -> list[Column]:
    """precision, recall, f1; zero where undefined, but ``empty_precision`` where nothing is predicted."""
    precision = F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(empty_precision))
    recall = F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))
    return [precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1")]


def by_class_and_total(rows: DataFrame, by: str, empty_precision: float = 0.0) -> DataFrame:
    """Counts and rates of every class and of all together (class null), by grouping sets."""
    t, p = F.col("truth"), F.col("predicted")
    counts = rows.rollup(by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return counts.select(by, "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn"), empty_precision))


def micro_macro(counts: DataFrame, empty_precision: float = 0.0) -> DataFrame:
    """One row: rates of the summed counts, and means of the classes' rates."""
    each = counts.select("tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn"), empty_precision))
    sums = each.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    micro = [c.alias(f"micro_{n}") for c, n in zip(rates(F.col("tp"), F.col("fp"), F.col("fn"), empty_precision), ("precision", "recall", "f1"), strict=True)]
    return sums.select(*micro, "macro_precision", "macro_recall", "macro_f1")


def predictions_on_chunks(chunks: DataFrame, predictions: DataFrame, by: list[str]) -> DataFrame:
    """chunks + (predicted, best_score): a chunk without a prediction is predicted false. ``predictions``
    has ``by``, predicted and best_score, one row a chunk at most."""
    found = predictions.select(*by, F.col("predicted").alias("_p"), F.col("best_score").alias("_s"))
    return chunks.join(found, by, "left").withColumn("predicted", F.coalesce("_p", F.lit(False))).withColumn("best_score", F.col("_s")).drop("_p", "_s")


def repeated_confusion(detections: DataFrame, truth: DataFrame, durations: DataFrame, by: str, piece: int = 5) -> DataFrame:
    """by + (tp, fp, tn, fn) where detections of one chunk count as often as they were logged. True
    negatives are of whole pieces only: a short last chunk is none. Tables have (by, chunk_idx),
    (by, chunk_idx) and (by, duration)."""
    marked = detections.join(truth.select(by, "chunk_idx", F.lit(True).alias("_t")).distinct(), [by, "chunk_idx"], "left")
    hits = marked.groupBy(by).agg(F.count_if(F.col("_t")).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"))
    seen = detections.select(by, "chunk_idx").distinct()
    missed = truth.select(by, "chunk_idx").distinct().join(seen, [by, "chunk_idx"], "left_anti").groupBy(by).agg(F.count("*").alias("fn"))
    whole = F.floor(F.col("duration") / piece)
    taken = seen.unionByName(truth.select(by, "chunk_idx")).distinct().join(durations, by).filter((F.col("chunk_idx") >= 0) & (F.col("chunk_idx") < whole)).groupBy(by).agg(F.count("*").alias("_taken"))
    out = durations.join(hits, by, "left").join(missed, by, "left").join(taken, by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return out.select(by, zero("tp").alias("tp"), zero("fp").alias("fp"), (whole.cast("long") - zero("_taken")).alias("tn"), zero("fn").alias("fn"))


def _by_score(scored: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """by + (score, t, f, t_below, f_below): how many of each truth have a score and a lower one, by ranges of
    the scores; and by + (pos, neg), all of them."""
    steps = scored.groupBy(*by, "score").agg(F.count_if("truth").alias("t"), F.count_if(~F.col("truth")).alias("f"))
    summed = scans.running_sums(steps, by, "score", scans.ranges(scored, "score"), {"t_below": "t", "f_below": "f"})
    return summed, scored.groupBy(*by).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))


def best_f1(scored: DataFrame, by: list[str]) -> DataFrame:
    """by + threshold, f1, tp, fp: over each distinct score as threshold; of equal F1 the lowest."""
    steps, totals = _by_score(scored, by)
    swept = scans.joined(steps, totals, by).select(*by, "score", (F.col("pos") - F.col("t_below")).alias("tp"), (F.col("neg") - F.col("f_below")).alias("fp"), "pos")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")), F.lit(0.0))
    best = swept.withColumn("f1", f1).filter("f1 > 0").groupBy(*by).agg(F.max_by(F.struct("score", "f1", "tp", "fp"), F.struct("f1", (-F.col("score")).alias("low"))).alias("b"))
    return best.select(*by, F.col("b.score").alias("threshold"), "b.f1", "b.tp", "b.fp")


def rank_auc(scored: DataFrame, by: list[str]) -> DataFrame:
    """by + auc: Mann-Whitney with average ranks of ties. Distinct scores are counted first, so the
    running sum is over scores and not rows."""
    steps, totals = _by_score(scored, by)
    wins = steps.groupBy(*by).agg(F.sum(F.col("t") * (F.col("f_below") + F.col("f") / 2.0)).alias("u"))
    return scans.joined(wins, totals, by).select(*by, F.try_divide(F.col("u"), F.col("pos") * F.col("neg")).alias("auc"))


def interval_matches(predictions: DataFrame, truth: DataFrame, by: list[str], tolerance: float = 0.5) -> DataFrame:
    """by + tp, fp, fn: each prediction, in order of start, takes the first unused interval that holds
    its start, ``tolerance`` wide on both sides. A fold over the group's sorted arrays."""
    p = predictions.groupBy(*by).agg(F.array_sort(F.collect_list("start")).alias("ps"))
    t = truth.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ts"))
    both = p.join(t, by, "full").select(*by, F.coalesce("ps", F.array().cast("array<double>")).alias("ps"), F.coalesce("ts", F.array().cast("array<struct<start:double,end:double>>")).alias("ts"))

    def take(free: Column, s: Column) -> Column:
        fits = lambda x: (s >= x["start"] - tolerance) & (s <= x["end"] + tolerance)
        hit = F.array_position(F.transform(free, lambda x: fits(x)), True)
        return F.when(hit == 0, free).otherwise(F.filter(free, lambda x, i: i != hit - 1))

    left = F.size(F.aggregate("ps", F.col("ts"), take))
    tp = F.size("ts") - left
    return both.select(*by, tp.alias("tp"), (F.size("ps") - tp).alias("fp"), left.alias("fn"))
