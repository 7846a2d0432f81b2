"""Cohorts, samples and splits: deterministic by a hash, the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.functions import vectors as V
from hearken.operators import evaluation, scans, scoring
from hearken.operators.sizes import small
from hearken.operators.verification import hash_sampled


def digest(*parts: Column | str | int) -> Column:
    """md5 of the parts, bar-separated."""
    return F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts]))


def uniform(*parts: Column | str | int) -> Column:
    """A number from 0 to 1, exclusive, that the parts determine."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def random_windows(files: DataFrame, id_: str, length: str, window: int, draws: int, seed: int = 0) -> DataFrame:
    """(draw, id, start): windows at random places of random files that are longer than the window. Every
    file has the same chance in each draw, which takes the one of the least hash: a minimum, which
    combines before the exchange. The draws are a stated, bounded number."""
    long_enough = files.filter(F.col(length) > window).select(F.col(id_).alias("id"), F.col(length).alias("_len"))
    each = files.sparkSession.range(draws).select(F.col("id").alias("draw"))
    least = long_enough.crossJoin(small(each)).groupBy("draw").agg(F.min_by(F.struct("id", "_len"), F.struct(digest(F.col("draw"), F.col("id"), seed), F.col("id"))).alias("f"))
    start = F.floor(uniform(F.col("draw"), F.col("f.id"), "start", seed) * (F.col("f._len") - window)).cast("long")
    return least.select("draw", "f.id", start.alias("start"))


def cohort(windows: DataFrame, distractors: DataFrame, keyword: str) -> DataFrame:
    """Rows of stream windows and of distractor words other than the keyword, with their source. Both have
    (keyword, embedding), distractors also word."""
    others = distractors.filter(F.col("word") != F.col(keyword))
    return windows.select(keyword, "embedding", F.lit("stream").alias("source")).unionByName(others.select(keyword, "embedding", F.lit("tts").alias("source")))


def split(rows: DataFrame, by: str, id_: str, holdout: int, seed: int = 0) -> DataFrame:
    """rows + held_out: ``holdout`` rows of each key in an order by hash."""
    order = W.partitionBy(by).orderBy(digest(F.col(id_), seed), id_)
    return rows.withColumn("held_out", F.row_number().over(order) <= holdout)


def other_word_negatives(rows: DataFrame, word: str, id_: str, most: int = 6, seed: int = 0) -> DataFrame:
    """(word, id): at most ``most`` rows of other words for each, from ``most`` of each word, in an order
    by hash of both. So pairs are of words, which are few, and not of rows."""
    drawn = hash_sampled(rows.select(word, id_), [word], id_, most, seed).select(F.col(word).alias("_other"), id_)
    words = rows.select(word).distinct()
    met = words.join(drawn, F.col(word) != F.col("_other"))
    order = W.partitionBy(word).orderBy(digest(F.col(word), F.col(id_), seed), id_)
    return met.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).select(word, id_)


def cross_domain_auc(anchors: DataFrame, clips: DataFrame, word: str, id_: str, most_words: int = 150, per_anchor: int = 3, positives: int = 2, negatives: int = 6, seed: int = 0) -> DataFrame:
    """(n_pos, n_neg, auc): clips against the centroid of their word's anchors, and clips of other words
    against it. Both tables have (word, id, embedding); words need ``positives`` clips."""
    enough = clips.groupBy(word).agg(F.count("*").alias("_n")).filter(F.col("_n") >= positives).join(anchors.select(word).distinct(), word, "left_semi")
    words = enough.orderBy(digest(F.col(word), seed), word).limit(most_words).select(word)
    centroid = scoring.centroids(hash_sampled(anchors.join(words, word), [word], id_, per_anchor, seed), word)
    pos = hash_sampled(clips.join(words, word), [word], id_, positives, seed)
    neg = other_word_negatives(pos, word, id_, negatives, seed).join(pos.select(id_, "embedding"), id_)
    scored = pos.select(word, "embedding", F.lit(True).alias("truth")).unionByName(neg.select(word, "embedding", F.lit(False).alias("truth"))).join(centroid, word)
    cosine = scored.select(F.lit(0).alias("all"), "truth", F.round(V.dot(V.as_doubles(F.col("embedding")), F.col("centroid")), 9).alias("score"))
    counts = cosine.groupBy("all").agg(F.count_if("truth").alias("n_pos"), F.count_if(~F.col("truth")).alias("n_neg"))
    return counts.join(evaluation.rank_auc(cosine, ["all"]), "all").select("n_pos", "n_neg", "auc")


def voice_mixture(rows: DataFrame, id_: str, voices: int, canonical: list[int], seed: int = 0) -> DataFrame:
    """rows + (kind, first, second, alpha): the voice of each clip. Three tenths get a canonical voice, four
    tenths any, and the others a blend ``alpha`` first + (1 - alpha) second, alpha from 0.3 to 0.7."""
    u = lambda part: uniform(F.col(id_), part, seed)
    pick = lambda part, n: F.floor(u(part) * n).cast("int")
    kind = F.when(u("kind") < 0.3, "canonical").when(u("kind") < 0.7, "random").otherwise("blend")
    of_canonical = F.element_at(F.array(*[F.lit(v) for v in canonical]), pick("canonical", len(canonical)) + 1)
    mixed = rows.withColumn("kind", kind)
    blended = F.col("kind") == "blend"
    return mixed.select("*", F.when(F.col("kind") == "canonical", of_canonical).otherwise(pick("first", voices)).alias("first"), F.when(blended, pick("second", voices)).alias("second"), F.when(blended, 0.3 + 0.4 * u("alpha")).alias("alpha"))


def voice_set(spark, voices: int, canonical: list[int], n_random: int = 13, n_blend: int = 10, seed: int = 0) -> DataFrame:
    """(name, first, second, alpha): the canonical voices, ``n_random`` others and ``n_blend`` blends."""
    i = F.col("id")
    pick = lambda part: F.floor(uniform(i, part, seed) * voices).cast("int")
    none = F.lit(None)
    listed = spark.createDataFrame([(k, v) for k, v in enumerate(canonical)], "id long, first int")
    fixed = listed.select(F.concat(F.lit("canonical"), i).alias("name"), "first", none.cast("int").alias("second"), none.cast("double").alias("alpha"))
    others = spark.range(n_random).select(F.concat(F.lit("random"), i).alias("name"), pick("random").alias("first"), none.cast("int").alias("second"), none.cast("double").alias("alpha"))
    blends = spark.range(n_blend).select(F.concat(F.lit("blend"), i).alias("name"), pick("first").alias("first"), pick("second").alias("second"), (0.3 + 0.4 * uniform(i, "alpha", seed)).alias("alpha"))
    return fixed.unionByName(others).unionByName(blends)


def voices_for(rows: DataFrame, key: str, speakers: DataFrame, speaker: str, n_random: int = 13, n_blend: int = 10, seed: int = 0) -> DataFrame:
    """(key, name, first, second, alpha): for each row ``n_random`` voices of the speakers of a table and
    ``n_blend`` blends of two, drawn by hashes. A speaker's number is its place in order; the drawn numbers are
    joined to the numbered speakers."""
    count = speakers.select(speaker).distinct().count()
    numbered = scans.numbered(speakers.select(speaker).distinct(), speaker)
    pick = lambda part: F.floor(uniform(F.concat_ws("|", key, "name"), part, seed) * count).cast("long")
    names = F.array(*[F.lit(f"{kind}{i}") for kind, n in (("random", n_random), ("blend", n_blend)) for i in range(n)])
    drawn = rows.select(key).distinct().withColumn("name", F.explode(names))
    blend = F.col("name").startswith("blend")
    drawn = drawn.withColumns({"_1": pick("first"), "_2": F.when(blend, pick("second")), "alpha": F.when(blend, 0.3 + 0.4 * uniform(F.concat_ws("|", key, "name"), "alpha", seed))})
    for place, new in (("_1", "first"), ("_2", "second")):
        drawn = drawn.join(numbered.select(F.col("_place").alias(place), F.col(speaker).alias(new)), place, "left")
    return drawn.select(key, "name", "first", "second", "alpha")


def class_index(rows: DataFrame, label: str, id_: str) -> DataFrame:
    """(label, id, place): every row's place among its class, as rows and not as one list a class."""
    return rows.select(label, id_, (F.row_number().over(W.partitionBy(label).orderBy(id_)) - 1).alias("place"))
