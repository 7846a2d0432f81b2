"""More registered queries: chunks and their records, samples and cohorts, evaluation variants, and
streaming jobs with look-ahead, offsets and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearken.functions import g2p
from hearken.functions import signal as G
from hearken.functions import text as T
from hearken.functions import vectors as V
from hearken.operators import cohorts as C
from hearken.operators import evaluation as E
from hearken.operators import lookup
from hearken.operators import scoring as S
from hearken.operators import streams as R
from hearken.operators import verification as VF
from hearken.operators.sizes import new_folder, spread
from hearken.plans.catalog import CENTROIDS, CHUNKS, SCORED, _chunks, _scored, r6, read, register
from hearken.sources import audio, files
from hearken.streaming import jobs

#: SQL for ``cohorts.uniform``.
def _u(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5({' || chr(124) || '.join(parts)}), 1, 8) AS BIGINT) / 4294967296.0)"


def _md5(*parts: str) -> str:
    return f"md5({' || chr(124) || '.join(parts)})"


@register("prediction_report", "WITH p AS (SELECT conv_id, turn, length(text) > 300 AS predicted, length(text) AS best_score FROM conversations WHERE turn % 2 = 0) SELECT c.conv_id, c.turn, list_contains(regexp_extract_all(lower(text), '[a-z'']+'), 'the') AS truth, coalesce(predicted, false) AS predicted, best_score, CASE WHEN length(text) > 48 THEN left(text, 45) || '...' ELSE text END AS snippet FROM conversations c LEFT JOIN p USING (conv_id, turn)")
def prediction_report(spark, sf_dir):
    """Turns as chunks; every other one has a prediction, by its length."""
    turns = read(spark, sf_dir, "conversations")
    predictions = turns.filter("turn % 2 = 0").select("conv_id", "turn", (F.length("text") > 300).alias("predicted"), F.length("text").cast("long").alias("best_score"))
    chunks = turns.select("conv_id", "turn", F.array_contains(T.token_set(F.col("text")), "the").alias("truth"), T.snippet(F.col("text")).alias("snippet"))
    return E.predictions_on_chunks(chunks, predictions, ["conv_id", "turn"]).select("conv_id", "turn", "truth", "predicted", "best_score", "snippet")


@register("threshold_strictness", "WITH m AS (SELECT event_type, max(value) AS t FROM events GROUP BY 1) SELECT event_type, count(*) FILTER (WHERE value >= t) AS reached, count(*) FILTER (WHERE value > t) AS exceeded, count(*) FILTER (WHERE value >= 100) AS over_100 FROM events JOIN m USING (event_type) GROUP BY 1")
def threshold_strictness(spark, sf_dir):
    """Each kind's largest value as its threshold, so that one event at least lies on it."""
    events = read(spark, sf_dir, "events")
    tops = events.groupBy("event_type").agg(F.max("value").alias("t"))
    met = events.join(tops, "event_type").groupBy("event_type")
    return met.agg(F.count_if(S.passes(F.col("value"), F.col("t"))).alias("reached"), F.count_if(S.passes(F.col("value"), F.col("t"), strict=True)).alias("exceeded"), F.count_if(S.passes(F.col("value"), 100.0)).alias("over_100"))


@register("skipped_chunks", "SELECT doc_id, n_chars * 20 < 24000 AS skipped, CAST(CASE WHEN n_chars * 20 < 24000 THEN 0 ELSE (n_chars * 20 - 24000) // 800 + 1 END AS BIGINT) AS n_windows FROM documents")
def skipped_chunks(spark, sf_dir):
    sounds = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 20).alias("n"))
    return R.window_records(sounds, "n", 24000, 800).select("doc_id", "skipped", "n_windows")


@register(
    "trimmed_centroids",
    f"""WITH {SCORED}, k AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE score < 0.8) AS n_out FROM s GROUP BY label),
kept AS (SELECT e.label, e.v FROM e JOIN s USING (vec_id) JOIN k ON k.label = e.label WHERE NOT (n_out > 0 AND n_out < 0.9 * n) OR score >= 0.8),
m2 AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM kept) GROUP BY ALL)
SELECT label, n, n_out > 0 AND n_out < 0.9 * n AS trimmed, i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12), 6) AS x FROM m2 JOIN k USING (label)""",
)
def trimmed_centroids(spark, sf_dir):
    found = S.trimmed_centroids(read(spark, sf_dir, "embeddings"), "label", least=0.8, most_share=0.9)
    return found.select("label", "n", "trimmed", F.posexplode("centroid").alias("i", "x")).withColumn("x", r6("x"))


@register(
    "dedupe_two_levels",
    """WITH s AS (SELECT user_id AS stream, event_id, ts, json_extract_string(props, '$.k') AS address, event_type AS content FROM events),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stream, address ORDER BY ts, event_id) = 1),
k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY stream, md5(content) ORDER BY ts, event_id) = 1)
SELECT stream, count(*) AS n_kept, (SELECT count(*) FROM a WHERE a.stream = k.stream) - count(*) AS n_skipped, min(event_id) AS first_event, max(event_id) AS last_event FROM k GROUP BY stream""",
)
def dedupe_two_levels(spark, sf_dir):
    """Events as segments: their number is the address, their kind the content."""
    segments = read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "event_id", "ts", F.get_json_object("props", "$.k").alias("address"), F.col("event_type").alias("content"))
    kept, skipped = R.deduplicated_twice(segments, "stream", "address", "content", ["ts", "event_id"])
    counts = kept.groupBy("stream").agg(F.count("*").alias("n_kept"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    return counts.join(skipped, "stream").select("stream", "n_kept", "n_skipped", "first_event", "last_event")


@register(
    "random_windows",
    f"""WITH f AS (SELECT doc_id, n_chars * 20 AS n FROM documents WHERE n_chars * 20 > 24000), d AS (SELECT unnest(range(0, 20)) AS draw),
k AS (SELECT draw, doc_id, n FROM f, d QUALIFY row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'doc_id', "'7'")}, doc_id) = 1)
SELECT draw, doc_id AS id, CAST(floor({_u('draw', 'doc_id', "'start'", "'7'")} * (n - 24000)) AS BIGINT) AS start FROM k""",
)
def random_windows(spark, sf_dir):
    sounds = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 20).alias("n"))
    return C.random_windows(sounds, "doc_id", "n", 24000, 20, seed=7)


@register("cohort_sources", "WITH w AS (SELECT DISTINCT label FROM embeddings) SELECT label, 'stream' AS source, count(*) AS n FROM embeddings WHERE vec_id % 5 = 0 GROUP BY ALL UNION ALL SELECT w.label, 'tts', count(*) FROM w JOIN w o ON w.label <> o.label GROUP BY ALL")
def cohort_sources(spark, sf_dir):
    """A fifth of each label's vectors as stream windows, the labels' centroids as distractor words."""
    vectors = read(spark, sf_dir, "embeddings")
    words = S.centroids(vectors, "label")
    labels = words.select("label")
    spoken = labels.join(words.select(F.col("label").alias("word"), F.col("centroid").alias("embedding")), F.lit(True))
    found = C.cohort(vectors.filter("vec_id % 5 = 0").select("label", V.as_doubles(F.col("embedding")).alias("embedding")), spoken, "label")
    return found.groupBy("label", "source").agg(F.count("*").alias("n"))


NEGATIVES = f"""dr AS (SELECT label AS other, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_md5('vec_id', "'3'")}, vec_id) <= 6),
ng AS (SELECT w.label, vec_id FROM (SELECT DISTINCT label FROM embeddings) w JOIN dr ON w.label <> dr.other QUALIFY row_number() OVER (PARTITION BY w.label ORDER BY {_md5('w.label', 'vec_id', "'3'")}, vec_id) <= 6)"""


@register("other_word_negatives", f"WITH {NEGATIVES} SELECT label, vec_id FROM ng")
def other_word_negatives(spark, sf_dir):
    return C.other_word_negatives(read(spark, sf_dir, "embeddings"), "label", "vec_id", 6, seed=3)


@register(
    "cross_domain_auc",
    f"""WITH a AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 2 = 1),
w AS (SELECT label FROM b GROUP BY label HAVING count(*) >= 2 AND label IN (SELECT label FROM a)),
a3 AS (SELECT * FROM a WHERE label IN (SELECT label FROM w) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_md5('vec_id', "'0'")}, vec_id) <= 3),
m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM a3) GROUP BY ALL),
c AS (SELECT label, list(x / n ORDER BY i) AS c FROM (SELECT *, greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12) AS n FROM m) GROUP BY label),
pos AS (SELECT * FROM b WHERE label IN (SELECT label FROM w) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_md5('vec_id', "'0'")}, vec_id) <= 2),
neg AS (SELECT w.label, pos.vec_id, pos.v FROM w JOIN pos ON w.label <> pos.label QUALIFY row_number() OVER (PARTITION BY w.label ORDER BY {_md5('w.label', 'pos.vec_id', "'0'")}, pos.vec_id) <= 6),
s AS (SELECT true AS truth, round(list_inner_product(v, c), 9) AS score FROM pos JOIN c USING (label) UNION ALL SELECT false, round(list_inner_product(v, c), 9) FROM neg JOIN c USING (label)),
r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s)
SELECT count(*) FILTER (WHERE truth) AS n_pos, count(*) FILTER (WHERE NOT truth) AS n_neg, round((sum(r) FILTER (WHERE truth) - count(*) FILTER (WHERE truth) * (count(*) FILTER (WHERE truth) + 1) / 2.0) / (count(*) FILTER (WHERE truth) * count(*) FILTER (WHERE NOT truth)), 6) AS auc FROM r""",
)
def cross_domain_auc(spark, sf_dir):
    """Even vectors as synthesized clips, odd ones as real clips of the labels."""
    vectors = read(spark, sf_dir, "embeddings")
    return C.cross_domain_auc(vectors.filter("vec_id % 2 = 0"), vectors.filter("vec_id % 2 = 1"), "label", "vec_id").withColumn("auc", F.round("auc", 6))


@register("seeded_split", f"SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_md5('vec_id', "'5'")}, vec_id) <= 6 AS held_out FROM embeddings")
def seeded_split(spark, sf_dir):
    return C.split(read(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id", 6, seed=5)


@register("class_index", "SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS place FROM embeddings")
def class_index(spark, sf_dir):
    return C.class_index(read(spark, sf_dir, "embeddings"), "label", "vec_id")


@register(
    "repeated_confusion",
    """WITH d AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INT) % 12 AS x FROM events WHERE value > 100), u AS (SELECT user_id, 53.7 AS duration FROM (SELECT DISTINCT user_id FROM events)),
g AS (SELECT unnest(range(0, 10)) AS x)
SELECT user_id, (SELECT count(*) FROM d WHERE d.user_id = u.user_id AND x IN (1, 2, 3)) AS tp, (SELECT count(*) FROM d WHERE d.user_id = u.user_id AND x NOT IN (1, 2, 3)) AS fp,
(SELECT count(*) FROM g WHERE x NOT IN (1, 2, 3) AND x NOT IN (SELECT d.x FROM d WHERE d.user_id = u.user_id)) AS tn, (SELECT count(*) FROM g WHERE x IN (1, 2, 3) AND x NOT IN (SELECT d.x FROM d WHERE d.user_id = u.user_id)) AS fn FROM u""",
)
def repeated_confusion(spark, sf_dir):
    """Events over 100 as logged detections of twelve chunks, the truth in chunks 1 to 3 of every user."""
    events = read(spark, sf_dir, "events")
    detections = events.filter("value > 100").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 12).alias("chunk_idx"))
    users = events.select("user_id").distinct()
    truth = users.withColumn("chunk_idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return E.repeated_confusion(detections, truth, users.withColumn("duration", F.lit(53.7)), "user_id")


@register("video_pieces", "SELECT doc_id, CAST(s // 5 AS INT) AS chunk_idx, CAST(s AS INT) AS start, CAST(least(s + 5, d) AS INT) AS \"end\" FROM (SELECT doc_id, n_chars // 100 AS d, unnest(range(0, n_chars // 100, 5)) AS s FROM documents)")
def video_pieces(spark, sf_dir):
    """A second of video for a hundred characters."""
    videos = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 100.0).alias("seconds"))
    return R.pieces(videos, "seconds").select("doc_id", "chunk_idx", "start", "end")


@register("clip_counts", "SELECT event_type AS keyword, count(*) FILTER (WHERE value > 250) AS n_clips FROM events GROUP BY 1")
def clip_counts(spark, sf_dir):
    """Clips under each keyword's folder at any depth; other files do not count."""
    kind = F.when(F.col("value") > 250, ".mp4").otherwise(".txt")
    files = read(spark, sf_dir, "events").select(F.concat(F.lit("clips/"), "event_type", F.lit("/"), F.col("user_id") % 3, F.lit("/live_"), "event_id", kind).alias("path"))
    return files.groupBy(F.element_at(F.split("path", "/"), 2).alias("keyword")).agg(F.count_if(F.col("path").endswith(".mp4")).alias("n_clips"))


@register("total_duration", f"WITH {CHUNKS} SELECT stream, round(sum(coalesce(duration, 5.0)), 3) AS seconds FROM ch GROUP BY stream")
def total_duration(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return chunks.groupBy("stream").agg(F.round(F.sum(F.coalesce("duration", F.lit(5.0))), 3).alias("seconds"))


@register("first_hit", f"WITH {CHUNKS} SELECT stream, min(chunk_idx) AS chunk_idx, greatest(min(chunk_idx) - 5, 0) AS first, min(chunk_idx) + 5 AS last FROM ch WHERE duration IS NULL GROUP BY stream")
def first_hit(spark, sf_dir):
    return R.first_hits(_chunks(spark, sf_dir).filter("duration IS NULL"), "stream")


@register("padded_spans", "SELECT event_id, greatest(0, CAST(trunc((value - 0.08) * 16000) AS INT)) AS first, least(4000000, CAST(trunc((value + 0.7 + 0.08) * 16000) AS INT)) AS last FROM events")
def padded_spans(spark, sf_dir):
    """Values as seconds in a chunk of 250 seconds."""
    return read(spark, sf_dir, "events").select("event_id", *R.padded_span(F.col("value"), F.lit(0.7), F.lit(4_000_000)))


@register("segment_stamps", "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def segment_stamps(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", R.stamped(F.col("ts")).alias("stamp"))


@register("speech_frame_counts", "SELECT doc_id, CAST(greatest(floor((n_chars - 1280) / 1280.0) + 1, 0) AS INT) AS frames FROM documents")
def speech_frame_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", R.speech_frames(F.col("n_chars")).alias("frames"))


@register("grapheme_ids", "SELECT conv_id, turn, CAST(list_sum(list_transform(string_split(lower(text), ''), lambda c: CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 94 ELSE 1 END)) AS BIGINT) AS id_sum, CAST(length(text) AS INT) AS n FROM conversations WHERE text <> ''")
def grapheme_ids(spark, sf_dir):
    ids = T.grapheme_ids(F.lower("text"))
    return read(spark, sf_dir, "conversations").filter("text <> ''").select("conv_id", "turn", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.size(ids).alias("n"))


@register("number_expansion")
def number_expansion(spark, sf_dir):
    """Digits of the turns as words; by rules that SQL does not have."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.numbers_as_words("text").alias("text"))


@register("filename_parts", "SELECT event_id, event_type AS keyword, event_id AS chunk_idx FROM events")
def filename_parts(spark, sf_dir):
    path = F.concat(F.lit("/a-b/tts-"), F.col("event_type"), F.lit("_"), F.col("event_id"), F.lit(".wav"))
    return read(spark, sf_dir, "events").select("event_id", T.keyword_of(path).alias("keyword"), T.chunk_index(path).cast("long").alias("chunk_idx"))


@register(
    "voice_mixture",
    f"""SELECT vec_id, kind, CAST(CASE WHEN kind = 'canonical' THEN [7, 11, 13][CAST(floor({_u('vec_id', "'canonical'", "'1'")} * 3) AS INT) + 1] ELSE floor({_u('vec_id', "'first'", "'1'")} * 40) END AS INT) AS first,
CAST(CASE WHEN kind = 'blend' THEN floor({_u('vec_id', "'second'", "'1'")} * 40) END AS INT) AS second, round(CASE WHEN kind = 'blend' THEN 0.3 + 0.4 * {_u('vec_id', "'alpha'", "'1'")} END, 6) AS alpha
FROM (SELECT vec_id, CASE WHEN {_u('vec_id', "'kind'", "'1'")} < 0.3 THEN 'canonical' WHEN {_u('vec_id', "'kind'", "'1'")} < 0.7 THEN 'random' ELSE 'blend' END AS kind FROM embeddings)""",
)
def voice_mixture(spark, sf_dir):
    return C.voice_mixture(read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 40, [7, 11, 13], seed=1).withColumn("alpha", r6("alpha"))


@register(
    "voice_set",
    f"""SELECT 'canonical' || i AS name, [7, 11, 13][i + 1] AS first, CAST(NULL AS INT) AS second, CAST(NULL AS DOUBLE) AS alpha FROM range(3) t(i)
UNION ALL SELECT 'random' || i, CAST(floor({_u('i', "'random'", "'2'")} * (SELECT count(*) FROM embeddings)) AS INT), NULL, NULL FROM range(13) t(i)
UNION ALL SELECT 'blend' || i, CAST(floor({_u('i', "'first'", "'2'")} * (SELECT count(*) FROM embeddings)) AS INT), CAST(floor({_u('i', "'second'", "'2'")} * (SELECT count(*) FROM embeddings)) AS INT), round(0.3 + 0.4 * {_u('i', "'alpha'", "'2'")}, 6) FROM range(10) t(i)""",
)
def voice_set(spark, sf_dir):
    """Vectors as voices: three of them as canonical ones, and others and blends drawn from all."""
    return C.voice_set(spark, read(spark, sf_dir, "embeddings").count(), [7, 11, 13], seed=2).withColumn("alpha", r6("alpha"))


@register("rms_change", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT vec_id, sqrt(list_inner_product(v, v) / len(v)) AS before, sqrt(list_sum(list_transform(v, lambda x: CASE WHEN abs(x) < 0.05 THEN 0.0 ELSE x * x END)) / len(v)) AS after FROM e) SELECT vec_id, round(before, 6) AS before, round(after, 6) AS after, round(100 * (after - before) / greatest(before, 1e-9), 4) AS percent FROM r")
def rms_change(spark, sf_dir):
    """Vectors as sounds, gated at 0.05."""
    sound = V.as_doubles(F.col("embedding"))
    gated = F.transform(sound, lambda x: F.when(F.abs(x) < 0.05, 0.0).otherwise(x))
    before, after, percent = V.rms_change(sound, gated)
    return read(spark, sf_dir, "embeddings").select("vec_id", r6(before, "before"), r6(after, "after"), F.round(percent, 4).alias("percent"))


@register(
    "matched_frames",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), k AS (SELECT q.vec_id AS query_id, f.v FROM e q JOIN e f ON q.vec_id % 50 = 0 AND q.vec_id <> f.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, f.v) DESC, f.vec_id) <= 4)
SELECT query_id, CAST(i AS INT) AS i, round(avg(x), 6) AS x FROM (SELECT query_id, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM k) GROUP BY ALL""",
)
def matched_frames(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = S.matched_frames(queries, vectors.select(F.col("vec_id").alias("frame_id"), "embedding"))
    return found.select("query_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", r6("x"))


@register("ranked_windows", f"WITH {SCORED} SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY round(score, 2) DESC, vec_id) AS INT) AS rank FROM s")
def ranked_windows(spark, sf_dir):
    """Scores of two digits, so that there are ties, which the id breaks."""
    return S.ranked(_scored(spark, sf_dir).withColumn("score", F.round("score", 2)), ["label"], ["vec_id"]).select("label", "vec_id", "rank")


@register("clip_lengths", "WITH c AS (SELECT doc_id, lang, n_chars / 1000.0 AS s FROM documents WHERE n_chars BETWEEN 150 AND 2500), m AS (SELECT lang, quantile_cont(s, 0.5) AS m FROM c GROUP BY 1) SELECT doc_id FROM c JOIN m ON c.lang IS NOT DISTINCT FROM m.lang WHERE c.lang IS NOT NULL AND s <= 1.8 * m")
def clip_lengths(spark, sf_dir):
    """A thousand characters as a second of clip."""
    clips = read(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") / 1000.0).alias("seconds"))
    return VF.lengths_guarded(clips, "lang", "seconds", most=2.5).select("doc_id")


@register("triplets", f"WITH h AS (SELECT label, vec_id, {_md5('vec_id', "'0'")} AS h FROM embeddings), p AS (SELECT label, vec_id AS anchor, lead(vec_id) OVER (PARTITION BY label ORDER BY h, vec_id) AS positive FROM h), f AS (SELECT label, vec_id AS negative FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY h, vec_id) = 1), n AS (SELECT label, coalesce(lead(label) OVER (ORDER BY label), min(label) OVER ()) AS next FROM f) SELECT anchor, positive, negative FROM p JOIN n USING (label) JOIN f ON f.label = n.next WHERE positive IS NOT NULL AND n.label <> n.next")
def triplets(spark, sf_dir):
    return VF.triplets(read(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", "vec_id")


@register("stream_chunk_offsets", f"WITH {CHUNKS} SELECT stream, chunk_idx, round(coalesce(sum(coalesce(duration, 5.0)) OVER (PARTITION BY stream ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS \"offset\" FROM ch")
def stream_chunk_offsets(spark, sf_dir):
    return jobs.chunk_offsets(spark, f"{sf_dir}/events.parquet").select("stream", "chunk_idx", F.round("offset", 3).alias("offset"))


@register("stream_context", "SELECT h.user_id, h.event_id AS hit, c.event_id AS near FROM events h JOIN events c ON c.user_id = h.user_id AND c.ts BETWEEN h.ts - INTERVAL 6 HOUR AND h.ts + INTERVAL 6 HOUR WHERE h.value > 350")
def stream_context(spark, sf_dir):
    return jobs.context(spark, f"{sf_dir}/events.parquet", least=350.0, reach="6 hours")


@register("stream_detection_log", "SELECT '[stream ' || user_id || '] ' || event_type || ' at chunk ' || event_id AS line FROM events WHERE value > 350")
def stream_detection_log(spark, sf_dir):
    return jobs.detection_log(spark, f"{sf_dir}/events.parquet", least=350.0)


@register("stream_first_hit", "SELECT user_id, min(event_id) AS first_hit FROM events WHERE value > 350 GROUP BY 1")
def stream_first_hit(spark, sf_dir):
    return jobs.first_hits(spark, f"{sf_dir}/events.parquet", least=350.0)


@register(
    "stream_chunk_store",
    """WITH c AS (SELECT user_id AS stream, event_id AS chunk_idx, epoch_ms(ts) AS ms, value FROM events),
b AS (SELECT stream, max(chunk_idx) AS newest, max(chunk_idx) FILTER (WHERE value > 250) AS upto, coalesce(bool_or(value > 250 AND chunk_idx <= 60), false) AS zero FROM c GROUP BY 1)
SELECT stream, chunk_idx FROM c JOIN b USING (stream) WHERE chunk_idx >= newest - 4000 AND NOT coalesce(chunk_idx <= upto AND (chunk_idx > 0 OR zero), false)
AND ms + 864000000 > (SELECT max(ms) FROM c) - 3600000""",
)
def stream_chunk_store(spark, sf_dir):
    """Events as chunks; one over 250 consumes the sixty numbers before it. What no batch removed is left."""
    path = f"{sf_dir}/events.parquet"
    gone = jobs.chunk_store(spark, path, least=250.0, reach=60, keep=4000, after_ms=10 * 86_400_000, delay="1 hour")
    chunks = read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("chunk_idx"))
    return chunks.join(gone, ["stream", "chunk_idx"], "left_anti")


SOUNDS = "sn AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x * 100)) AS y FROM embeddings), kw AS (SELECT 'k' || vec_id AS keyword, y[9:24] AS w FROM sn WHERE vec_id < 3)"


@register(
    "keyword_sounds",
    f"""WITH {SOUNDS}, c AS (SELECT vec_id, keyword, y, w, j, list_sum(list_transform(range(greatest(0, 8 - j), least(16, 72 - j)), lambda n: y[j - 8 + n + 1] * w[n + 1])) AS c FROM sn, kw, range(64) t(j)),
p AS (SELECT vec_id, keyword, y, w, j AS at_, c FROM c QUALIFY row_number() OVER (PARTITION BY vec_id, keyword ORDER BY c DESC, j) = 1),
q AS (SELECT vec_id, keyword, CAST(at_ AS INT) AS at_, c / nullif(sqrt(list_sum(list_transform(y[at_ + 1 : at_ + 16], lambda x: x * x)) * list_sum(list_transform(w, lambda x: x * x))), 0) * 100 AS percent FROM p)
SELECT vec_id, keyword, at_ AS "at", round(least(percent, 100), 6) AS percent FROM q WHERE percent > 70""",
)
def keyword_sounds(spark, sf_dir):
    """Vectors in hundredths as sounds of 64 samples; pieces of the first three as keywords."""
    sounds = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.as_doubles(F.col("embedding")), lambda x: F.round(x * 100)).alias("samples"))
    keywords = sounds.filter("vec_id < 3").select(F.concat(F.lit("k"), "vec_id").alias("keyword"), F.slice("samples", 9, 16).alias("word"))
    return G.keyword_in_chunks(spread(sounds), keywords, 70.0).withColumn("percent", F.round("percent", 6))


@register(
    "json_file_sink",
    "SELECT event_type AS keyword, count(*) AS n, round(max(value), 4) AS best, CAST(count(*) FILTER (WHERE value > 250) AS BIGINT) AS hits FROM events GROUP BY 1",
)
def json_file_sink(spark, sf_dir):
    """A JSON document for each event type, written as files that replace those before, and read again."""
    events = read(spark, sf_dir, "events")
    found = events.groupBy(F.col("event_type").alias("keyword")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("best"), F.count_if(F.col("value") > 250).alias("hits"))
    folder = new_folder(spark, "documents")
    for rows in (found.withColumn("best", F.lit(0.0)), found):
        files.write_json(rows, folder, F.concat("keyword", F.lit(".json")))
    return spark.read.schema("keyword string, n long, best double, hits long").option("pathGlobFilter", "*.json").json(folder)


@register(
    "wav_file_sink",
    "WITH m AS (SELECT label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(greatest(least(x, 1), -1) * 32767)) AS s FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) SELECT label, CAST(len(s) AS INT) AS n, CAST(list_sum(s) AS BIGINT) AS total FROM m",
)
def wav_file_sink(spark, sf_dir):
    """The first vector of each label as a sound file, decoded again."""
    first = R.first_of(read(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], ["vec_id"])
    folder = new_folder(spark, "sounds")
    files.write_wav(first, folder, F.format_string("sound_%d.wav", F.col("label").cast("long")), F.col("embedding"))
    sounds = audio.chunk_files(spark, folder).withColumn("s", audio.samples("content"))
    scaled = F.transform("s", lambda x: F.round(x.cast("double") * 32768).cast("long"))
    return sounds.select(F.col("chunk_idx").cast("long").alias("label"), F.size("s").alias("n"), F.aggregate(scaled, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@register("spoken_words")
def spoken_words(spark, sf_dir):
    """(word, phonemes) of the different words of the turns, by a network whose weights are a rule's: it says
    nothing sensible, but its work is that of one that does."""
    words = read(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").distinct()
    return words.withColumn("phonemes", F.array_join(g2p.phonemes(F.col("word"), "hearken.functions.g2p:weights_by_rule"), " "))


@register("similar_words")
def similar_words(spark, sf_dir):
    """(token, wanted, r): words of the turns against all words of the benchmark, four fifths alike or more."""
    words = lambda t, name: read(spark, sf_dir, t).select(F.explode(T.token_set(F.col("text"))).alias(name)).distinct()
    return lookup.alike(words("conversations", "token"), words("benchmark", "wanted"), 80.0).withColumn("r", F.round("r", 6))


@register(
    "voices_of_labels",
    f"""WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), c AS (SELECT count(*) AS n FROM s),
d AS (SELECT label, k || i AS name, k = 'blend' AS blend FROM (SELECT DISTINCT label FROM embeddings), (SELECT 'random' AS k, unnest(range(13)) AS i UNION ALL SELECT 'blend', unnest(range(10)))),
u AS (SELECT label, name, blend, CAST(floor({_u("label || '|' || name", "'first'", "'4'")} * n) AS BIGINT) AS a, CAST(floor({_u("label || '|' || name", "'second'", "'4'")} * n) AS BIGINT) AS b, 0.3 + 0.4 * {_u("label || '|' || name", "'alpha'", "'4'")} AS alpha FROM d, c)
SELECT u.label, u.name, s.vec_id AS first, t.vec_id AS second, round(CASE WHEN blend THEN alpha END, 6) AS alpha FROM u JOIN s ON s.place = a LEFT JOIN s t ON blend AND t.place = b""",
)
def voices_of_labels(spark, sf_dir):
    """Vectors as speakers; every label gets its own voices of them."""
    vectors = read(spark, sf_dir, "embeddings")
    return C.voices_for(vectors.select("label"), "label", vectors, "vec_id", seed=4).withColumn("alpha", r6("alpha"))


@register("named_events", "SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 250)")
def named_events(spark, sf_dir):
    """All events of the users who have one over 250."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return R.named(events, events.filter("value > 250").select("user_id"), "user_id").drop("value")


@register("clip_list_files", "SELECT event_type, string_agg('file ''clips/' || event_type || '/it''\\''''s_' || event_id || '.mp4''' || chr(10), '' ORDER BY event_id) AS value FROM events WHERE value > 200 GROUP BY 1")
def clip_list_files(spark, sf_dir):
    """A list file for each event type, of paths with strokes and quotes to be mended."""
    path = F.concat(F.lit("clips\\"), "event_type", F.lit("\\it's_"), "event_id", F.lit(".mp4"))
    found = read(spark, sf_dir, "events").filter("value > 200").select("event_type", "event_id", path.alias("path"))
    return R.concat_list(found, ["event_type"], "path", "event_id")
