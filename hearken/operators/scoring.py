"""Vector scores: centroids, adaptive normalization, calibration and threshold resolution."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearken.functions import vectors as V
from hearken.operators import selection
from hearken.operators.sizes import small


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """(by, centroid): the renormalized mean. Sums by (key, place) combine before the shuffle."""
    placed = vectors.select(by, F.posexplode(V.as_doubles(F.col("embedding"))).alias("i", "x"))
    means = placed.groupBy(by, "i").agg(F.avg("x").alias("x"))
    joined = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return joined.select(by, V.l2_normalized(F.col("mean")).alias("centroid"))


def outliers_trimmed(vectors: DataFrame, by: str, least: float = 0.5, most_share: float = 0.3) -> DataFrame:
    """(by, n, n_out, trimmed): vectors below ``least`` cosine to their centroid go, if there are any
    and they are under ``most_share`` of the key's."""
    cosine = V.dot(V.as_doubles(F.col("embedding")), F.col("centroid"))
    per_key = vectors.join(centroids(vectors, by), by).withColumn("out", cosine < least)
    counts = per_key.groupBy(by).agg(F.count("*").alias("n"), F.count_if("out").alias("n_out"))
    return counts.select(by, "n", "n_out", ((F.col("n_out") > 0) & (F.col("n_out") < most_share * F.col("n"))).alias("trimmed"))


def trimmed_centroids(vectors: DataFrame, by: str, least: float = 0.5, most_share: float = 0.3) -> DataFrame:
    """(by, n, trimmed, centroid): where some vectors lie below ``least`` cosine and these are under
    ``most_share`` of the key's, they go and the centroid is made of the others."""
    first = centroids(vectors, by)
    counts = outliers_trimmed(vectors, by, least, most_share)
    cosine = V.dot(V.as_doubles(F.col("embedding")), F.col("centroid"))
    kept = vectors.join(first, by).join(counts.filter("trimmed").select(by), by).filter(cosine >= least).select(by, "embedding")
    again = centroids(kept, by).withColumnRenamed("centroid", "_again")
    return first.join(counts, by).join(again, by, "left").select(by, "n", "trimmed", F.coalesce("_again", "centroid").alias("centroid"))


def passes(score: Column, threshold: Column | float, strict: bool = False) -> Column:
    """Whether a score reaches its threshold, or exceeds it where ``strict``. An undefined score does
    neither, though Spark orders it above all numbers."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    reached = score > threshold if strict else score >= threshold
    return F.coalesce(reached & ~F.isnan(score), F.lit(False))


def top_stats(scores: DataFrame, by: list[str], k: int = 50) -> DataFrame:
    """by + mu, sigma: mean and population deviation of the k largest scores, deviations 1e-3 at least."""
    best = W.partitionBy(*by).orderBy(F.desc("score"))
    top = scores.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k)
    return top.groupBy(*by).agg(F.avg("score").alias("mu"), F.greatest(F.stddev_pop("score"), F.lit(1e-3)).alias("sigma"))


def cohort_stats(windows: DataFrame, cohort: DataFrame, by: list[str], k: int = 50, together: int = 20_000) -> DataFrame:
    """(key, by, mu, sigma): mean and population deviation, 1e-3 at least, of each window's ``k`` best products
    with its key's cohort. The cohort is a matrix, a batch of windows one product, and the best are taken in
    place: there is no row a pair. A key's windows are dealt to parts of about ``together``, and its cohort,
    a bounded number of vectors, goes to each of them."""
    parts = windows.groupBy("key").agg(F.ceil(F.count("*") / together).alias("_parts"))
    dealt = windows.join(parts, "key").withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int")).drop("_parts")
    copies = cohort.select("key", "cohort").join(parts, "key").withColumn("_part", F.explode(F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int")))).drop("_parts")

    def product(own: pa.Table, others: pa.Table) -> pa.Table:
        mu, sigma = np.full(len(own), np.nan), np.full(len(own), np.nan)
        if len(own) and len(others):
            matrix = np.array(others["cohort"].to_pylist(), float).T
            most = min(k, matrix.shape[1])
            for at in range(0, len(own), 2048):
                scores = np.array(own["embedding"].slice(at, 2048).to_pylist(), float) @ matrix
                best = np.partition(scores, matrix.shape[1] - most, axis=1)[:, matrix.shape[1] - most :]
                mu[at : at + 2048], sigma[at : at + 2048] = best.mean(axis=1), np.maximum(best.std(axis=1), 1e-3)
        there = pa.array(~np.isnan(mu))
        return pa.table([*[own[c] for c in ("key", *by)], pa.array(mu), pa.array(sigma)], names=["key", *by, "mu", "sigma"]).filter(there)

    kinds = ", ".join(f"`{c}` {windows.schema[c].dataType.simpleString()}" for c in ("key", *by))
    pairs = dealt.select("key", "_part", *by, "embedding").groupBy("key", "_part").cogroup(copies.groupBy("key", "_part"))
    return pairs.applyInArrow(product, f"{kinds}, mu double, sigma double")


def adaptive_scores(windows: DataFrame, anchor: DataFrame, cohort: DataFrame, k: int = 50) -> DataFrame:
    """(key, window_id, raw, score): 0.5 ((s - mu_a) / sigma_a + (s - mu_w) / sigma_w).

    ``anchor`` has (key, anchor), ``cohort`` (key, cohort): a bounded number a key, as configured."""
    raw = windows.join(anchor, "key").select("key", "window_id", V.dot(F.col("embedding"), F.col("anchor")).alias("raw"))
    of_anchor = cohort_stats(anchor.select("key", F.lit(0).alias("window_id"), F.col("anchor").alias("embedding")), cohort, ["window_id"], k).select("key", F.col("mu").alias("ma"), F.col("sigma").alias("sa"))
    of_window = cohort_stats(windows, cohort, ["window_id"], k)
    both = raw.join(of_anchor, "key").join(of_window, ["key", "window_id"])
    score = 0.5 * ((F.col("raw") - F.col("ma")) / F.col("sa") + (F.col("raw") - F.col("mu")) / F.col("sigma"))
    return both.select("key", "window_id", "raw", score.alias("score"))


def calibration(scores: DataFrame, by: str, percent: float = 0.99) -> DataFrame:
    """Per key: the negatives' exact percentile as threshold, summaries, recall and margin."""
    neg, pos = F.when(~F.col("positive"), F.col("score")), F.when(F.col("positive"), F.col("score"))
    base = scores.groupBy(by).agg(
        F.avg(neg).alias("neg_mean"),
        F.stddev_pop(neg).alias("neg_std"),
        F.max(neg).alias("neg_max"),
        F.avg(pos).alias("pos_mean"),
        F.min(pos).alias("pos_min"),
        F.count(pos).alias("n_pos"),
        F.count(neg).alias("n_neg"),
    )
    high = selection.percentiles(scores, [by], neg, {"threshold": percent}).withColumnRenamed(by, "_key")
    base = base.join(high, F.col(by).eqNullSafe(F.col("_key")), "left").drop("_key")
    reached = scores.join(base.select(by, "threshold"), by).filter("positive").groupBy(by).agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("recall"))
    margin = F.col("pos_mean") - F.col("threshold")
    return base.join(reached, by, "left").select("*", margin.alias("margin"), F.when(margin > 0, "OK").otherwise("overlap").alias("verdict"))


def resolved_thresholds(keys: DataFrame, explicit: DataFrame, calibrated: DataFrame, by: str, default: float) -> DataFrame:
    """by + threshold, provenance: explicit, else calibrated, else the default."""
    joined = keys.join(explicit.select(by, F.col("threshold").alias("e")), by, "left").join(calibrated.select(by, F.col("threshold").alias("c")), by, "left")
    return joined.select(by, F.coalesce("e", "c", F.lit(default)).alias("threshold"), F.when(F.col("e").isNotNull(), "explicit").when(F.col("c").isNotNull(), "calibrated").otherwise("default").alias("provenance"))


#: Queries and frames that one task multiplies, the queries of one product, and frames of which it looks at the best.
QUERIES, FRAMES, ROWS, GROUP = 16384, 16384, 512, 64


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one size without gaps as rows."""
    flat = np.concatenate([np.zeros(0), *[c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]])
    return flat.astype(float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def _first_copies(matrix: np.ndarray, least: int) -> np.ndarray:
    """Places, in order, of the first ``least`` rows of each vector: more of one are never among the nearest."""
    kinds = np.unique(np.ascontiguousarray(matrix).view(f"V{matrix.shape[1] * 8}").ravel(), return_inverse=True)[1]
    order = np.argsort(kinds, kind="stable")
    kinds = kinds[order]
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    within = np.arange(len(kinds)) - np.repeat(starts, np.diff(np.append(starts, len(kinds))))
    return np.sort(order[within < least])


def _nearest_of_block(k: int):
    """(query_id, frame_id, cosine) of the ``k`` nearest of a block of frames for each of a block of queries.
    A matrix product finds those that may be among them, with room for its rounding; the product that counts
    is summed from the first place to the last, as the expression does."""

    def product(queries: pa.Table, frames: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        frames = frames.sort_by("frame_id")
        f = _matrix(frames["f"])
        if len(queries) and f.shape[1]:
            q = _matrix(queries["q"])
            ids = frames["frame_id"].to_pylist()
            most = max(Counter(ids).values())
            kept = _first_copies(f, k + most)
            f, columns = f[kept], np.ascontiguousarray(f[kept].T)
            at: dict = {}
            for place, there in enumerate(kept.tolist()):
                at.setdefault(ids[there], []).append(place)
            longest = np.sqrt((f * f).sum(axis=1).max())
            whole = len(f) // GROUP * GROUP
            for start in range(0, len(q), ROWS):
                some = q[start : start + ROWS]
                scores = some @ columns
                for i, name in enumerate(queries["query_id"].slice(start, ROWS).to_pylist()):
                    scores[i, at.get(name, [])] = -np.inf
                least = np.full(len(some), -np.inf)
                if whole >= k * GROUP:
                    tops = scores[:, :whole].reshape(len(some), -1, GROUP).max(axis=2)
                    least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
                room = 1e-12 * longest * np.sqrt((some * some).sum(axis=1)) + 1e-300
                of, place = np.nonzero((scores >= (least - room)[:, None]) & (scores > -np.inf))
                exact = np.zeros(len(of))
                for j in range(f.shape[1]):
                    exact += some[of, j] * columns[j, place]
                order = np.lexsort((place, -exact, of))
                of, place, exact = of[order], place[order], exact[order]
                first = np.searchsorted(of, of)
                best = np.arange(len(of)) - first < k
                found.append((of[best] + start, kept[place[best]], exact[best]))
        of, place, cosine = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"query_id": queries["query_id"].take(pa.array(of)), "frame_id": frames["frame_id"].take(pa.array(place)), "cosine": cosine})

    return product


def _nearest_by_blocks(queries: DataFrame, frames: DataFrame, k: int, n_queries: int, n_frames: int) -> DataFrame:
    """Candidates (query_id, frame_id, cosine): the ``k`` best of each block of frames."""
    qs, fs = -(-n_queries // QUERIES), -(-n_frames // FRAMES)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "q", block("query_id", qs).alias("_q"), each(fs).alias("_f"))
    right = frames.select("frame_id", "f", block("frame_id", fs).alias("_f"), each(qs).alias("_q"))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (frames, "frame_id")))
    return left.groupBy("_q", "_f").cogroup(right.groupBy("_q", "_f")).applyInArrow(_nearest_of_block(k), f"{kinds}, cosine double")


def nearest(queries: DataFrame, frames: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, frame_id, rank, cosine): the k nearest frames, exact: all queries against all frames, by
    blocks whose products are matrices, of which only the k best of each query become rows. Vectors of
    another size than most, with gaps or not finite, are held against all others one by one."""
    fq = queries.filter("query_id IS NOT NULL").select("query_id", V.as_doubles(F.col("embedding")).alias("q"))
    ff = frames.filter("frame_id IS NOT NULL").select("frame_id", V.as_doubles(F.col("embedding")).alias("f"))
    size = ff.groupBy(F.size("f").alias("n")).agg(F.count("*").alias("rows")).filter("n > 0").orderBy(F.desc("rows"), "n").limit(1).collect()
    usual = lambda v: F.coalesce((F.size(v) == (size[0]["n"] if size else 0)) & F.forall(v, lambda x: F.abs(x) < 1e150), F.lit(False))

    def counts(rows: DataFrame, v: str) -> tuple[int, int]:
        return tuple(rows.agg(F.count_if(usual(v)), F.count_if(~usual(v))).first())

    (n_queries, odd_queries), (n_frames, odd_frames) = counts(fq, "q"), counts(ff, "f")
    single = lambda f, q: f.join(small(q), F.col("query_id") != F.col("frame_id")).select("query_id", "frame_id", V.dot(F.col("q"), F.col("f")).alias("cosine"))
    scored = single(ff.limit(0), fq.limit(0))
    if n_queries and n_frames:
        scored = scored.unionByName(_nearest_by_blocks(fq.filter(usual("q")), ff.filter(usual("f")), k, n_queries, n_frames))
    if odd_queries:
        scored = scored.unionByName(single(ff, fq.filter(~usual("q"))))
    if odd_frames:
        scored = scored.unionByName(single(ff.filter(~usual("f")), fq.filter(usual("q"))))
    best = W.partitionBy("query_id").orderBy(F.desc("cosine"), "frame_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def matched_frames(queries: DataFrame, frames: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, embedding): the mean of each query's k nearest frames, as a voice conversion takes it."""
    near = nearest(queries, frames, k).join(frames, "frame_id")
    placed = near.select("query_id", F.posexplode(V.as_doubles(F.col("embedding"))).alias("i", "x"))
    means = placed.groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def ranked(scored: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """scored + rank within ``by``, from the highest score; equals in the order of ``ties``."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), *ties)))
