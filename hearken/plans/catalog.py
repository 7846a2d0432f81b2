"""Every registered query with its SQL equivalent, over the driver's tables.

The tables have no audio, so texts serve as word streams, events as stream segments, embeddings as
scored windows and labels as truth; each query says which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.functions import text as T
from hearken.functions import vectors as V
from hearken.operators import evaluation as E
from hearken.operators import matching as M
from hearken.operators import scoring as S
from hearken.operators import selection
from hearken.operators import streams as R
from hearken.operators import verification as VF
from hearken.operators.sizes import small, spread
from hearken.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEYWORDS = ["the", "of the", "is in the", "der die", "que de", "les", "pathetic"]
SINGLE = ["the", "thing", "loser", "scum"]
STOP = ["the", "and", "for", "that", "with", "this", "der", "die", "und", "les", "des", "que"]


def register(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


WORDS = r"""
ts AS (SELECT doc_id, list_filter(list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''),
         lambda w: {'raw': w, 'token': regexp_replace(lower(w), '[^\p{L}\p{N}_\s]', '', 'g')}), lambda p: p.token <> '') AS ws FROM documents),
words AS (SELECT doc_id, pos, w.raw AS raw, w.token AS token, pos * 400 AS start_ms, pos * 400 + 350 AS end_ms, 50 + (doc_id * 31 + pos * 17) % 50 AS score_c
          FROM (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS w FROM ts))"""


def _hits_sql() -> str:
    parts = []
    for n in (1, 2, 3):
        wanted = ", ".join(f"('{k}')" for k in KEYWORDS if len(k.split()) == n)
        gram = " || ' ' || ".join(["token"] + [f"lead(token, {k}) OVER w" for k in range(1, n)])
        score = " + ".join(["score_c"] + [f"lead(score_c, {k}) OVER w" for k in range(1, n)])
        parts.append(f"SELECT doc_id, pos, gram AS keyword, start_ms, start_ms + {(n - 1) * 400 + 350} AS end_ms, sc / {n * 100}.0 AS confidence FROM (SELECT doc_id, pos, start_ms, {gram} AS gram, {score} AS sc FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) JOIN (VALUES {wanted}) t(k) ON gram = k")
    return " UNION ALL ".join(parts)


HITS = WORDS + ", hits AS (" + _hits_sql() + ")"


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ws): texts as word streams, with times and scores made up from the words' places."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    score = lambda i: (50 + (F.col("doc_id") * 31 + i * 17) % 50) / 100.0
    return docs.select("doc_id", F.transform(T.tokens(F.col("text")), lambda p, i: F.struct(p["raw"].alias("raw"), p["token"].alias("token"), (i * 400).alias("start_ms"), (i * 400 + 350).alias("end_ms"), score(i).alias("score"))).alias("ws"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token), one row a word."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.explode(T.raw_words(T.normalized(F.coalesce("text", F.lit(""))))).alias("token"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.exact_matches(streams(spark, sf_dir), M.targets(spark, KEYWORDS), [1, 2, 3])
    return found.withColumn("confidence", r6("confidence"))


@register("exact_keyword_match", f"WITH {HITS} SELECT doc_id, keyword, count(*) AS n_hits, min(pos) AS first_pos, round(avg(confidence), 6) AS confidence FROM hits GROUP BY ALL")
def exact_keyword_match(spark, sf_dir):
    found = hits(spark, sf_dir).groupBy("doc_id", "keyword")
    return found.agg(F.count("*").alias("n_hits"), F.min("pos").alias("first_pos"), r6(F.avg("confidence"), "confidence"))


@register(
    "temporal_nms",
    f"""WITH {HITS}, g AS (SELECT *, start_ms - lag(start_ms) OVER (PARTITION BY doc_id ORDER BY start_ms, keyword) > 1000 AS apart FROM hits),
r AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start_ms, keyword ROWS UNBOUNDED PRECEDING) AS run FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY confidence DESC, start_ms, keyword) AS k FROM r)
SELECT doc_id, keyword, start_ms, end_ms, round(confidence, 6) AS confidence FROM k WHERE k = 1""",
)
def temporal_nms(spark, sf_dir):
    return M.gap_suppressed(hits(spark, sf_dir), ["doc_id"]).select("doc_id", "keyword", "start_ms", "end_ms", r6("confidence", "confidence"))


@register("normalize_tokens", f"WITH {WORDS} SELECT doc_id, pos, token FROM words")
def normalize_tokens(spark, sf_dir):
    return M.word_rows(streams(spark, sf_dir)).select("doc_id", "pos", "token")


@register("ngram_windows", f"WITH {WORDS}, g AS (SELECT token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w AS gram, raw || ' ' || lead(raw) OVER w || ' ' || lead(raw, 2) OVER w AS context FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT gram, count(*) AS n, min(context) AS context FROM g WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) >= 3")
def ngram_windows(spark, sf_dir):
    grams = M.recurring_ngrams(streams(spark, sf_dir), 3, 3)
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("context")).filter("n >= 3")


@register(
    "word_frequency_topn",
    rf"""WITH w AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS ws FROM documents)),
c AS (SELECT word, count(*) AS n, min(doc_id) AS first_doc FROM w WHERE regexp_full_match(word, '[a-z]{{3,}}') AND word NOT IN ({', '.join(repr(s) for s in STOP)}) GROUP BY word)
SELECT word, n FROM c ORDER BY n DESC, first_doc, word LIMIT 20""",
)
def word_frequency_topn(spark, sf_dir):
    words = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    counts = words.filter(F.col("word").rlike("^[a-z]{3,}$") & ~F.col("word").isin(STOP)).groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return counts.orderBy(F.desc("n"), "first_doc", "word").limit(20).select("word", "n")


@register("vocabulary_eligibility", f"WITH {WORDS} SELECT token, count(*) AS n FROM words WHERE regexp_full_match(token, '[a-z]{{3,}}') GROUP BY token HAVING count(*) >= 8")
def vocabulary_eligibility(spark, sf_dir):
    words = token_rows(spark, sf_dir)
    return words.filter(F.col("token").rlike("^[a-z]{3,}$")).groupBy("token").agg(F.count("*").alias("n")).filter("n >= 8")


def _lcs_sql(a: str, b: str) -> str:
    """SQL for the longest common subsequence of two texts, the second of at most 60 characters: a row
    of the table in the bits of a number."""
    place = f"list_transform(range(1, length({b}) + 1), lambda i: CASE WHEN substr({b}, i, 1) = ch THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INT) ELSE 0 END)"
    every = f"((CAST(1 AS BIGINT) << CAST(length({b}) AS INT)) - 1)"
    masks = f"list_transform(string_split({a}, ''), lambda ch: CAST(list_sum({place}) AS BIGINT))"
    return f"(length({b}) - bit_count(list_reduce(list_prepend({every}, {masks}), lambda row, m: ((row + (row & m)) | (row - (row & m))) & {every})))"


def _ratio_sql(a: str, b: str) -> str:
    return f"200.0 * {_lcs_sql(a, b)} / (length({a}) + length({b}))"


def _infix_sql(ref: str, text: str) -> str:
    """SQL for the infix similarity of a reference of at most 60 characters in a text: a column of the
    edit table in two numbers. The folded list is [up, down, edits, least edits]; elements are [met]."""
    place = f"list_transform(range(1, length({ref}) + 1), lambda i: CASE WHEN substr({ref}, i, 1) = ch THEN CAST(1 AS BIGINT) << CAST(i - 1 AS INT) ELSE 0 END)"
    every, last = f"((CAST(1 AS BIGINT) << CAST(length({ref}) AS INT)) - 1)", f"(CAST(1 AS BIGINT) << CAST(length({ref}) - 1 AS INT))"
    steps = f"list_transform(string_split({text}, ''), lambda ch: [CAST(list_sum({place}) AS BIGINT)])"
    across = "(xor((x[1] & s[1]) + s[1], s[1]) | x[1])"
    more, less = f"(s[2] | ({every} & ~({across} | s[1])))", f"(s[1] & {across})"
    edits = f"(s[3] + CASE WHEN {more} & {last} <> 0 THEN 1 ELSE 0 END - CASE WHEN {less} & {last} <> 0 THEN 1 ELSE 0 END)"
    up = f"((({less} << 1) & {every}) | ({every} & ~(x[1] | s[2] | (({more} << 1) & {every}))))"
    down = f"((({more} << 1) & {every}) & (x[1] | s[2]))"
    first = f"[{every}, CAST(0 AS BIGINT), CAST(length({ref}) AS BIGINT), CAST(length({ref}) AS BIGINT)]"
    folded = f"list_reduce(list_prepend({first}, {steps}), lambda s, x: [{up}, {down}, {edits}, least(s[4], {edits})])"
    return f"CASE WHEN {text} = '' THEN 0.0 ELSE greatest(0.0, 1 - ({folded})[4] / length({ref})) END"


FUZZY = ["the", "thing", "loser", "scum", "of the", "is in the"]


def _fuzzy_sql() -> str:
    """Every window against every keyword of its length, without phonetic matches."""
    wanted = sorted({t for k in FUZZY for t in k.split()})
    parts = [f"WITH {WORDS}, d AS (SELECT DISTINCT token FROM words), r AS (SELECT token, wanted, {_ratio_sql('token', 'wanted')} AS ratio FROM d, (VALUES {', '.join(f'({t!r})' for t in wanted)}) v(wanted))"]
    found = []
    for k in FUZZY:
        ts = k.split()
        n = len(ts)
        leads = ", ".join([f"lead(token, {i}) OVER w AS t{i}" for i in range(n)])
        score = " + ".join(f"lead(score_c, {i}) OVER w" for i in range(n))
        joins = " ".join(f"JOIN r AS r{i} ON r{i}.token = t{i} AND r{i}.wanted = '{t}'" for i, t in enumerate(ts))
        exact = " AND ".join(f"t{i} = '{t}'" for i, t in enumerate(ts))
        mean = "(" + " + ".join(f"r{i}.ratio" for i in range(n)) + f") / {n}"
        found.append(f"SELECT '{k}' AS keyword, CASE WHEN {exact} THEN 'exact' ELSE 'fuzzy' END AS match_type, sc / {n * 100}.0 * CASE WHEN {exact} THEN 1.0 ELSE {mean} / 100 END AS confidence FROM (SELECT {leads}, {score} AS sc FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) {joins} WHERE {mean} >= 85")
    return parts[0] + ", f AS (" + " UNION ALL ".join(found) + ") SELECT keyword, match_type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM f WHERE confidence >= 0.5 GROUP BY ALL"


@register("fuzzy_keyword_match", _fuzzy_sql())
def fuzzy_keyword_match(spark, sf_dir):
    found = M.cascade_matches(streams(spark, sf_dir), M.targets(spark, FUZZY), phonetic=False)
    return found.groupBy("keyword", "match_type").agg(F.count("*").alias("n"), r6(F.avg("confidence"), "confidence"))


@register("match_cascade")
def match_cascade(spark, sf_dir):
    """With phonetic matches, for which SQL has no code."""
    found = M.cascade_matches(streams(spark, sf_dir), M.targets(spark, FUZZY))
    return found.groupBy("keyword", "match_type").agg(F.count("*").alias("n"), r6(F.avg("confidence"), "confidence"))


@register("phonetic_match")
def phonetic_match(spark, sf_dir):
    tokens = token_rows(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    # As it counts as not deterministic, it is asked once for the join and the result.
    code = F.pandas_udf(T.metaphone_code.func, "string").asNondeterministic()
    coded = tokens.withColumn("code", code("token"))
    wanted = M.targets(spark, SINGLE).select("keyword", F.element_at("codes", 1).alias("code"))
    return coded.join(small(wanted), "code").select("keyword", "token", "code", "n")


def _wanted(spark):
    return small(spark.createDataFrame([("thing",), ("loser",), ("scum",)], "keyword string"))


RATIOS = f"WITH {WORDS}, t AS (SELECT DISTINCT token FROM words), k AS (SELECT * FROM (VALUES ('thing'), ('loser'), ('scum')) v(keyword)), p AS (SELECT keyword, token, round({_ratio_sql('token', 'keyword')}, 6) AS ratio FROM t, k)"


@register("indel_ratio", f"{RATIOS} SELECT keyword, count(*) AS n, count(*) FILTER (WHERE ratio = 0) AS n_zero, count(*) FILTER (WHERE ratio >= 85) AS n_fuzzy FROM p GROUP BY keyword")
def indel_ratio(spark, sf_dir):
    """How many of all distinct tokens share nothing with a keyword, and how many reach the ratio of a match."""
    scored = indel_ratio_by_token(spark, sf_dir)
    return scored.groupBy("keyword").agg(F.count("*").alias("n"), F.count_if(F.col("ratio") == 0).alias("n_zero"), F.count_if(F.col("ratio") >= 85).alias("n_fuzzy"))


@register("indel_ratio_by_token", f"{RATIOS} SELECT keyword, token, ratio FROM p")
def indel_ratio_by_token(spark, sf_dir):
    """The ratio of every distinct token of any length and each of a stated set of keywords."""
    tokens = token_rows(spark, sf_dir).select("token").distinct()
    return tokens.crossJoin(_wanted(spark)).select("keyword", "token", r6(T.indel_ratio(F.col("token"), F.col("keyword")), "ratio"))


@register("infix_similarity", f"SELECT conv_id, turn, round({_infix_sql(repr('there'), 'text')}, 6) AS similarity FROM conversations")
def infix_similarity(spark, sf_dir):
    """The best match of a keyword anywhere in each turn's whole text."""
    texts = read(spark, sf_dir, "conversations")
    return texts.select("conv_id", "turn", r6(T.infix_in_text(F.lit("there"), F.col("text")), "similarity"))


@register("loo_similarity", f"WITH k AS (SELECT DISTINCT event_type FROM events), p AS (SELECT a.event_type, {_infix_sql('a.event_type', 'b.event_type')} AS s FROM k a JOIN k b ON a.event_type <> b.event_type) SELECT 1 AS key, round(avg(m), 6) AS loo_mean FROM (SELECT event_type, max(s) AS m FROM p GROUP BY 1)")
def loo_similarity(spark, sf_dir):
    """The kinds of events as phoneme sequences of one keyword, each against the others."""
    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    refs = kinds.select(F.lit(1).alias("key"), F.col("event_type").alias("id"), F.split("event_type", "").alias("phones"))
    return VF.leave_one_out(refs, "key", "id").select("key", r6("loo_mean", "loo_mean"))


@register(
    "ctc_collapse",
    """WITH c AS (SELECT conv_id, turn, unnest(range(0, length(text))) AS i, unnest(string_split(text, '')) AS x FROM conversations WHERE text <> ''),
k AS (SELECT *, lag(x) OVER (PARTITION BY conv_id, turn ORDER BY i) AS p FROM c)
SELECT conv_id, turn, count(*) AS n, string_agg(x, '' ORDER BY i) AS phones FROM k WHERE (p IS NULL OR p <> x) AND x NOT IN (' ', '|', '<', '') GROUP BY ALL""",
)
def ctc_collapse(spark, sf_dir):
    """Characters of turns as frames, the space as blank."""
    turns = read(spark, sf_dir, "conversations").filter("text <> ''").select("conv_id", "turn", T.ctc_collapse(F.split("text", ""), " ").alias("p"))
    return turns.filter(F.size("p") > 0).select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.array_join("p", "").alias("phones"))


@register("scan_chunk_order", "SELECT event_id, 'live_' || event_id || '.wav' AS path, event_id AS chunk_idx FROM events")
def scan_chunk_order(spark, sf_dir):
    """Event ids as chunk files, in numeric order."""
    files = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("live_"), "event_id", F.lit(".wav")).alias("path"))
    return files.select("event_id", "path", T.chunk_index(F.col("path")).alias("chunk_idx")).orderBy("chunk_idx")


@register("class_size_filter", "SELECT label, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) >= 3")
def class_size_filter(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).filter("n >= 3")


@register("transcript_keyword_truth", "SELECT conv_id, turn, list_contains(regexp_extract_all(lower(text), '[a-z'']+'), 'the') AS has_the, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z'']+'))) AS INT) AS n_tokens FROM conversations")
def transcript_keyword_truth(spark, sf_dir):
    tokens = T.token_set(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_contains(tokens, "the").alias("has_the"), F.size(tokens).alias("n_tokens"))


@register("keyword_free_chunks", "SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = c.conv_id AND t.turn = c.turn AND list_contains(regexp_extract_all(lower(t.text), '[a-z'']+'), 'the'))")
def keyword_free_chunks(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    bearing = turns.filter(F.array_contains(T.token_set(F.col("text")), "the")).select("conv_id", "turn")
    return turns.select("conv_id", "turn").join(bearing, ["conv_id", "turn"], "left_anti")


def _segments(spark, sf_dir):
    """Events as stream segments: stream by user, sequence number from the props."""
    number = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "event_id", "ts", "value", F.concat(F.lit("http://host/seg?sq="), number, F.lit("&sig="), "event_id").alias("uri"))


@register(
    "dedupe_by_sequence",
    """WITH s AS (SELECT user_id AS stream, event_id, ts, json_extract_string(props, '$.k') AS seq FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY stream, seq ORDER BY ts, event_id) AS k FROM s)
SELECT stream, seq, event_id, row_number() OVER (PARTITION BY stream ORDER BY ts, event_id) - 1 AS chunk_idx FROM f WHERE k = 1""",
)
def dedupe_by_sequence(spark, sf_dir):
    keyed = _segments(spark, sf_dir).withColumn("seq", R.sequence_key(F.col("uri"))).select("stream", "seq", "event_id", "ts")
    first = R.first_of(keyed, ["stream", "seq"], ["ts", "event_id"])
    return R.indexed(first, "stream", ["ts", "event_id"]).select("stream", "seq", "event_id", "chunk_idx")


@register("dedupe_by_md5", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) - 1 AS n_skipped FROM documents GROUP BY md5(text)")
def dedupe_by_md5(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), (F.count("*") - 1).alias("n_skipped"))


CHUNKS = "ch AS (SELECT user_id AS stream, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS chunk_idx, CASE WHEN value <= 300 THEN value END AS duration FROM events)"


def _chunks(spark, sf_dir):
    """Events as chunks in order; long ones lack a duration."""
    return R.indexed(_segments(spark, sf_dir), "stream", ["ts", "event_id"]).withColumn("duration", F.when(F.col("value") <= 300, F.col("value")))


@register("stream_time_offset", f"WITH {CHUNKS} SELECT stream, chunk_idx, round(coalesce(sum(coalesce(duration, 5.0)) OVER (PARTITION BY stream ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS \"offset\" FROM ch")
def stream_time_offset(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    durations = chunks.filter("duration IS NOT NULL").select("stream", "chunk_idx", "duration")
    return R.stream_offsets(chunks, durations, "stream").select("stream", "chunk_idx", F.round("offset", 3).alias("offset"))


@register("chunk_retention", f"WITH {CHUNKS}, n AS (SELECT stream, max(chunk_idx) AS newest FROM ch GROUP BY 1) SELECT stream, chunk_idx, event_id FROM ch JOIN n USING (stream) WHERE chunk_idx >= newest - 7")
def chunk_retention(spark, sf_dir):
    return R.retained(_chunks(spark, sf_dir), "stream").select("stream", "chunk_idx", "event_id")


NEAR = """h AS (SELECT conv_id, turn FROM conversations WHERE list_contains(regexp_extract_all(lower(text), '[a-z'']+'), 'with')),
x AS (SELECT h.conv_id, h.turn AS hit_turn, c.turn AS near, c.role FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN greatest(h.turn - 1, 0) AND h.turn + 1)"""


def _near(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumnRenamed("turn", "chunk_idx")
    hit = turns.filter(F.array_contains(T.token_set(F.col("text")), "with")).select("conv_id", "chunk_idx")
    return R.context(hit, turns.select("conv_id", "chunk_idx", "role"), "conv_id", reach=1).withColumnRenamed("chunk_idx", "hit_turn")


@register("context_range_join", f"WITH {NEAR} SELECT conv_id, hit_turn, near, role FROM x")
def context_range_join(spark, sf_dir):
    return _near(spark, sf_dir).select("conv_id", "hit_turn", "near", "role")


@register("context_manifest", f"WITH {NEAR} SELECT conv_id, hit_turn, string_agg('turn_' || near || '.mp4', ',' ORDER BY near) AS manifest FROM x GROUP BY ALL")
def context_manifest(spark, sf_dir):
    named = _near(spark, sf_dir).withColumn("path", F.concat(F.lit("turn_"), "near", F.lit(".mp4")))
    return R.manifest(named, ["conv_id", "hit_turn"], "path", "near")


@register("hopping_windows", "SELECT doc_id, unnest(range(0, greatest(n_chars * 20 - 24000, 0) + 1, 8000)) AS start FROM documents")
def hopping_windows(spark, sf_dir):
    """Texts as sounds of twenty samples a character."""
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(R.hop_starts(F.col("n_chars") * 20)).alias("start"))


@register(
    "multiscale_windows",
    """WITH w AS (SELECT doc_id, n_chars * 20 AS n, scale, size FROM documents, (VALUES (0.6, 9600), (0.8, 12800), (1.0, 16000)) s(scale, size))
SELECT doc_id, CAST(scale AS DOUBLE) AS scale, size, count(*) AS n_windows, max(start) AS last_start FROM (SELECT *, unnest(range(0, n - size + 1, 800)) AS start FROM w WHERE n >= size) GROUP BY doc_id, scale, size""",
)
def multiscale_windows(spark, sf_dir):
    sounds = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 20).alias("n"))
    found = R.scaled_windows(sounds, "n", 1.0)
    return found.groupBy("doc_id", "scale", "size").agg(F.count("*").alias("n_windows"), F.max("start").alias("last_start"))


CENTROIDS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM e) GROUP BY ALL),
c AS (SELECT label, list(x / n ORDER BY i) AS c FROM (SELECT *, greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12) AS n FROM m) GROUP BY label)"""
DOT = "list_sum([a * b FOR a, b IN list_zip(v, c)])"


@register("label_centroid", f"WITH {CENTROIDS} SELECT label, i, round(x, 6) AS x FROM (SELECT label, unnest(range(0, len(c))) AS i, unnest(c) AS x FROM c)")
def label_centroid(spark, sf_dir):
    found = S.centroids(read(spark, sf_dir, "embeddings"), "label")
    return found.select("label", F.posexplode("centroid").alias("i", "x")).select("label", "i", r6("x", "x"))


def _scored(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return vectors.join(S.centroids(vectors, "label"), "label").select("vec_id", "label", V.dot(V.as_doubles(F.col("embedding")), F.col("centroid")).alias("score"))


SCORED = CENTROIDS + ", s AS (SELECT vec_id, label, list_inner_product(v, c) AS score FROM e JOIN c USING (label))"


@register("cosine_scores", f"WITH {SCORED} SELECT vec_id, label, round(score, 6) AS score FROM s")
def cosine_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "label", r6("score", "score"))


@register("l2_distance", f"WITH {CENTROIDS} SELECT vec_id, round(list_distance(v, c), 6) AS distance FROM e JOIN c USING (label)")
def l2_distance(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return vectors.join(S.centroids(vectors, "label"), "label").select("vec_id", r6(V.l2_distance(V.as_doubles(F.col("embedding")), F.col("centroid")), "distance"))


@register("centroid_outlier_trim", f"WITH {SCORED}, k AS (SELECT label, count(*) AS n, count(*) FILTER (WHERE score < 0.5) AS n_out FROM s GROUP BY label) SELECT *, n_out > 0 AND n_out < 0.3 * n AS trimmed FROM k")
def centroid_outlier_trim(spark, sf_dir):
    return S.outliers_trimmed(read(spark, sf_dir, "embeddings"), "label")


@register("chunk_score_max", f"WITH {SCORED} SELECT label, vec_id // 10 AS chunk, round(max(score), 6) AS score, count(*) AS n FROM s GROUP BY ALL")
def chunk_score_max(spark, sf_dir):
    chunk = F.floor(F.col("vec_id") / 10).cast("long")
    return _scored(spark, sf_dir).groupBy("label", chunk.alias("chunk")).agg(r6(F.max("score"), "score"), F.count("*").alias("n"))


@register("chunk_best_window", f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY label, vec_id // 10 ORDER BY round(score, 6) DESC, vec_id) AS k FROM s) SELECT label, vec_id // 10 AS chunk, vec_id, round(score, 6) AS score FROM k WHERE k = 1")
def chunk_best_window(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("label", F.floor(F.col("vec_id") / 10).cast("long").alias("chunk"), "vec_id", r6("score", "score"))
    return R.first_of(rows.withColumn("neg", -F.col("score")), ["label", "chunk"], ["neg", "vec_id"]).drop("neg")


@register("topk_stats", f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC) AS k FROM s) SELECT label, round(avg(score), 6) AS mu, round(greatest(stddev_pop(score), 0.001), 6) AS sigma FROM k WHERE k <= 20 GROUP BY label")
def topk_stats(spark, sf_dir):
    return S.top_stats(_scored(spark, sf_dir), ["label"], 20).select("label", r6("mu", "mu"), r6("sigma", "sigma"))


@register(
    "asnorm_scores",
    f"""WITH {CENTROIDS}, a AS (SELECT label, c AS anchor FROM c), h AS (SELECT a.label, c.c AS cohort FROM a, c WHERE a.label <> c.label),
ka AS (SELECT label, list_inner_product(cohort, anchor) AS s FROM h JOIN a USING (label)), ka2 AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC) AS k FROM ka),
sa AS (SELECT label, avg(s) AS m, greatest(stddev_pop(s), 0.001) AS d FROM ka2 WHERE k <= 5 GROUP BY 1),
kw AS (SELECT e.vec_id, e.label, list_inner_product(v, cohort) AS s FROM e JOIN h USING (label)), kw2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC) AS k FROM kw),
sw AS (SELECT vec_id, avg(s) AS m, greatest(stddev_pop(s), 0.001) AS d FROM kw2 WHERE k <= 5 GROUP BY 1)
SELECT e.label AS key, e.vec_id AS window_id, round(list_inner_product(v, anchor), 6) AS raw, round(0.5 * ((list_inner_product(v, anchor) - sa.m) / sa.d + (list_inner_product(v, anchor) - sw.m) / sw.d), 5) AS score
FROM e JOIN a USING (label) JOIN sa USING (label) JOIN sw USING (vec_id)""",
)
def asnorm_scores(spark, sf_dir):
    """Windows of each label against its centroid, the other labels' centroids as cohort."""
    vectors = read(spark, sf_dir, "embeddings")
    anchor = S.centroids(vectors, "label").select(F.col("label").alias("key"), F.col("centroid").alias("anchor"))
    cohort = anchor.select(F.col("key").alias("other"), F.col("anchor").alias("cohort")).join(anchor.select("key"), F.col("key") != F.col("other")).select("key", "cohort")
    windows = vectors.select(F.col("label").alias("key"), F.col("vec_id").alias("window_id"), V.as_doubles(F.col("embedding")).alias("embedding"))
    return S.adaptive_scores(windows, anchor, cohort, 5).select("key", "window_id", r6("raw", "raw"), F.round("score", 5).alias("score"))


CALIBRATION = "p AS (SELECT lang, text IS NOT NULL AND l.quality = 1 AS positive, CAST(n_chars AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id))"


def _labelled(spark, sf_dir):
    """Labelled texts: length as score, quality as truth, language as keyword."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", F.col("n_chars").cast("double").alias("score")).join(labels, "doc_id").select("doc_id", "lang", "score", (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 1).alias("toxic"))


@register(
    "calibration_report",
    f"""WITH {CALIBRATION}, b AS (SELECT lang, quantile_cont(score, 0.99) FILTER (WHERE NOT positive) AS threshold, avg(score) FILTER (WHERE NOT positive) AS neg_mean, stddev_pop(score) FILTER (WHERE NOT positive) AS neg_std, max(score) FILTER (WHERE NOT positive) AS neg_max,
avg(score) FILTER (WHERE positive) AS pos_mean, min(score) FILTER (WHERE positive) AS pos_min, count(*) FILTER (WHERE positive) AS n_pos, count(*) FILTER (WHERE NOT positive) AS n_neg FROM p GROUP BY lang),
r AS (SELECT lang, avg(CASE WHEN score >= threshold THEN 1.0 WHEN score < threshold THEN 0 END) AS recall FROM p JOIN b USING (lang) WHERE positive GROUP BY lang)
SELECT lang, round(threshold, 4) AS threshold, round(neg_mean, 4) AS neg_mean, round(neg_std, 4) AS neg_std, neg_max, round(pos_mean, 4) AS pos_mean, pos_min, n_pos, n_neg, round(recall, 6) AS recall, round(pos_mean - threshold, 4) AS margin, CASE WHEN pos_mean - threshold > 0 THEN 'OK' ELSE 'overlap' END AS verdict FROM b LEFT JOIN r USING (lang)""",
)
def calibration_report(spark, sf_dir):
    found = S.calibration(_labelled(spark, sf_dir), "lang")
    rounded = {c: F.round(c, 4) for c in ("threshold", "neg_mean", "neg_std", "pos_mean", "margin")}
    return found.withColumns(rounded | {"recall": F.round("recall", 6)})


@register("calibration_threshold", f"WITH {CALIBRATION} SELECT lang, round(quantile_cont(score, 0.9), 4) AS p90, round(quantile_cont(score, 0.95), 4) AS p95, round(quantile_cont(score, 0.99), 4) AS p99, round(quantile_cont(score, 0.995), 4) AS p995, max(score) AS p100 FROM p WHERE NOT positive GROUP BY lang")
def calibration_threshold(spark, sf_dir):
    negatives = _labelled(spark, sf_dir).filter("NOT positive")
    found = selection.percentiles(negatives, ["lang"], F.col("score"), {"p90": 0.9, "p95": 0.95, "p99": 0.99, "p995": 0.995, "p100": 1.0})
    return found.select("lang", *[F.round(c, 4).alias(c) for c in ("p90", "p95", "p99", "p995")], "p100")


@register("threshold_resolution", "SELECT label, CASE WHEN label < 3 THEN 0.9 WHEN n > 40 THEN CAST(n AS DOUBLE) / 100 ELSE 0.5 END AS threshold, CASE WHEN label < 3 THEN 'explicit' WHEN n > 40 THEN 'calibrated' ELSE 'default' END AS provenance FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def threshold_resolution(spark, sf_dir):
    counts = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    explicit = counts.filter("label < 3").select("label", F.lit(0.9).alias("threshold"))
    calibrated = counts.filter("n > 40").select("label", (F.col("n") / 100.0).alias("threshold"))
    return S.resolved_thresholds(counts, explicit, calibrated, "label", 0.5)


@register("knn_topk", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, f.vec_id AS frame_id, list_inner_product(q.v, f.v) AS cosine FROM e q JOIN e f ON q.vec_id % 50 = 0 AND q.vec_id <> f.vec_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, frame_id) AS INT) AS rank FROM p) SELECT query_id, frame_id, rank, round(cosine, 6) AS cosine FROM k WHERE rank <= 4")
def knn_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return S.nearest(queries, vectors.select(F.col("vec_id").alias("frame_id"), "embedding"), 4).select("query_id", "frame_id", "rank", r6("cosine", "cosine"))


@register(
    "greedy_nms_topn",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 86400e6 AS time, value AS score FROM events),
r AS (SELECT DISTINCT user_id, CAST(-1 AS INT) AS rank, CAST([] AS DOUBLE[]) AS kept, CAST(NULL AS DOUBLE) AS time, CAST(NULL AS DOUBLE) AS score FROM e
UNION ALL
SELECT user_id, rank, kept, time, score FROM (
  SELECT r.user_id, CAST(r.rank + 1 AS INT) AS rank, list_append(r.kept, e.time) AS kept, e.time, e.score, row_number() OVER (PARTITION BY r.user_id ORDER BY e.score DESC, e.time) AS k
  FROM r JOIN e ON e.user_id = r.user_id AND len(list_filter(r.kept, lambda t: abs(t - e.time) < 0.25)) = 0 WHERE r.rank < 7) x WHERE k = 1)
SELECT user_id, rank, time, score FROM r WHERE rank >= 0""",
)
def greedy_nms_topn(spark, sf_dir):
    """Events of a user as scored windows, time in days."""
    events = read(spark, sf_dir, "events").select("user_id", F.lit(1.0).alias("scale"), (F.unix_micros(F.col("ts").cast("timestamp")) / 86_400e6).alias("time"), F.col("value").alias("score"))
    return M.greedy_suppressed(events, ["user_id"]).select("user_id", F.posexplode("kept").alias("rank", "k")).select("user_id", "rank", "k.time", "k.score")


@register(
    "candidate_rescue_union",
    """WITH d AS (SELECT user_id, 1.0 AS scale, CAST(event_id AS DOUBLE) AS time FROM events WHERE event_type = 'click'), c AS (SELECT user_id, 1.0 AS scale, event_id + CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN CAST(4e-7 AS DOUBLE) ELSE CAST(2e-6 AS DOUBLE) END AS time FROM events WHERE value > 100)
SELECT user_id, CAST(scale AS DOUBLE) AS scale, time, false AS rescued FROM d UNION ALL SELECT c.user_id, CAST(c.scale AS DOUBLE), c.time, true FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = c.user_id AND d.scale = c.scale AND abs(d.time - c.time) < 1e-6)""",
)
def candidate_rescue_union(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", F.lit(1.0).alias("scale"), F.col("event_id").cast("double").alias("time"), "event_type", "value")
    moved = F.col("time") + F.when(F.col("time") % 3 == 0, 0.0).when(F.col("time") % 3 == 1, 4e-7).otherwise(2e-6)
    return R.rescued(events.filter("event_type = 'click'").select("user_id", "scale", "time"), events.filter("value > 100").select("user_id", "scale", moved.alias("time")), ["user_id"])


@register(
    "interval_match_eval",
    f"""WITH RECURSIVE {HITS}, p AS (SELECT doc_id, start_ms / 1000 AS s, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms) AS i FROM hits WHERE keyword = 'the'),
t AS (SELECT doc_id, start_ms / 1000 AS s, end_ms / 1000 AS e, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms) AS j FROM hits WHERE keyword = 'of the'),
c AS (SELECT p.doc_id, p.i, list(t.j ORDER BY t.j) FILTER (WHERE t.j IS NOT NULL) AS js FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND p.s BETWEEN t.s - 0.5 AND t.e + 0.5 GROUP BY ALL),
w AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used FROM p
UNION ALL SELECT w.doc_id, c.i, CASE WHEN len(list_filter(coalesce(c.js, []), lambda j: NOT list_contains(w.used, j))) > 0 THEN list_append(w.used, list_filter(c.js, lambda j: NOT list_contains(w.used, j))[1]) ELSE w.used END FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i + 1),
m AS (SELECT doc_id, max(len(used)) AS tp FROM w GROUP BY doc_id), np AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), nt AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1)
SELECT doc_id, CAST(coalesce(tp, 0) AS INT) AS tp, CAST(coalesce(np.n, 0) - coalesce(tp, 0) AS INT) AS fp, CAST(coalesce(nt.n, 0) - coalesce(tp, 0) AS INT) AS fn
FROM np FULL JOIN nt USING (doc_id) LEFT JOIN m USING (doc_id)""",
)
def interval_match_eval(spark, sf_dir):
    """Exact hits of 'the' against those of 'of the' as truth, by text."""
    found = hits(spark, sf_dir)
    seconds = found.select("doc_id", "keyword", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"))
    return E.interval_matches(seconds.filter("keyword = 'the'"), seconds.filter("keyword = 'of the'"), ["doc_id"])


TRUTH = "t AS (SELECT lang, quality = 1 AS truth, n_chars > 1500 AS predicted, CAST(n_chars AS DOUBLE) AS score FROM documents JOIN labels USING (doc_id))"


def _truth(spark, sf_dir):
    return _labelled(spark, sf_dir).select("lang", F.col("positive").alias("truth"), (F.col("score") > 1500).alias("predicted"), "score")


COUNTS4 = "count(*) FILTER (WHERE truth AND predicted) AS tp, count(*) FILTER (WHERE NOT truth AND predicted) AS fp, count(*) FILTER (WHERE NOT truth AND NOT predicted) AS tn, count(*) FILTER (WHERE truth AND NOT predicted) AS fn"


@register("confusion_matrix", f"WITH {TRUTH} SELECT lang, {COUNTS4} FROM t GROUP BY lang")
def confusion_matrix(spark, sf_dir):
    return E.confusion(_truth(spark, sf_dir), ["lang"])


RATES = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@register("prf1_by_class", f"WITH {TRUTH}, k AS (SELECT lang, {COUNTS4} FROM t GROUP BY GROUPING SETS ((lang), ())) SELECT lang, tp, fp, fn, {RATES} FROM k")
def prf1_by_class(spark, sf_dir):
    return E.by_class_and_total(_truth(spark, sf_dir), "lang").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register("micro_macro_avg", f"WITH {TRUTH}, k AS (SELECT lang, {COUNTS4} FROM t GROUP BY lang), r AS (SELECT *, {RATES} FROM k), a AS (SELECT avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM r) SELECT round(tp / (tp + fp), 5) AS micro_precision, round(tp / (tp + fn), 5) AS micro_recall, round(2 * tp / (2 * tp + fp + fn), 5) AS micro_f1, round(mp, 5) AS macro_precision, round(mr, 5) AS macro_recall, round(mf, 5) AS macro_f1 FROM a")
def micro_macro_avg(spark, sf_dir):
    return E.micro_macro(E.confusion(_truth(spark, sf_dir), ["lang"])).select(*[F.round(c, 5).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")])


@register(
    "best_f1_sweep",
    f"""WITH {TRUTH}, d AS (SELECT lang, score, count(*) FILTER (WHERE truth) AS t, count(*) FILTER (WHERE NOT truth) AS f FROM t GROUP BY ALL),
w AS (SELECT *, sum(t) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(f) OVER (PARTITION BY lang ORDER BY score DESC) AS fp, sum(t) OVER (PARTITION BY lang) AS pos FROM d),
k AS (SELECT *, 2.0 * tp / (tp + fp + pos) AS f1, row_number() OVER (PARTITION BY lang ORDER BY 2.0 * tp / (tp + fp + pos) DESC, score) AS k FROM w)
SELECT lang, score AS threshold, round(f1, 6) AS f1, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM k WHERE k = 1 AND f1 > 0""",
)
def best_f1_sweep(spark, sf_dir):
    return E.best_f1(_truth(spark, sf_dir), ["lang"]).withColumn("f1", F.round("f1", 6))


@register(
    "rank_auc",
    f"WITH {TRUTH}, r AS (SELECT lang, truth, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM t) SELECT lang, round((sum(r) FILTER (WHERE truth) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc FROM r JOIN (SELECT lang, count(*) FILTER (WHERE truth) AS n1, count(*) FILTER (WHERE NOT truth) AS n0 FROM t GROUP BY lang) USING (lang) GROUP BY lang, n1, n0",
)
def rank_auc(spark, sf_dir):
    return E.rank_auc(_truth(spark, sf_dir), ["lang"]).withColumn("auc", F.round("auc", 6))


@register(
    "transcript_forward_fill",
    """WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
h AS (SELECT *, CASE WHEN length(line) > 120 THEN left(line, 12) END AS hd FROM l)
SELECT doc_id, i, last_value(hd IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS header FROM h""",
)
def transcript_forward_fill(spark, sf_dir):
    """Lines over 120 characters as headers, the first twelve of them the key."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return R.forward_filled(lines, ["doc_id"], "i", F.when(F.length("line") > 120, F.substring("line", 1, 12))).select("doc_id", "i", "header")


@register("nested_detection_json", "SELECT user_id, count(*) AS n_windows, count(*) FILTER (WHERE value > 250) AS n_detections, max(value) AS best_score FROM events GROUP BY user_id")
def nested_detection_json(spark, sf_dir):
    """Events to nested detection documents as JSON text and back through the declared schema."""
    from hearken.sources.detections import DETECTIONS

    chunk = F.struct(F.col("event_type").alias("file"), F.lit(1).alias("n_windows"), F.col("value").alias("best_score"), F.when(F.col("value") > 250, F.array(F.struct(F.col("value").alias("score")))).otherwise(F.array().cast("array<struct<score:double>>")).alias("detections"))
    nested = read(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(chunk).alias("chunks"))).alias("j"))
    parsed = nested.select("user_id", F.from_json("j", DETECTIONS).alias("d"))
    chunks = F.col("d.chunks")
    size = lambda f: F.aggregate(chunks, F.lit(0).cast("long"), lambda a, c: a + f(c))
    return parsed.select("user_id", size(lambda c: c["n_windows"]).alias("n_windows"), size(lambda c: F.size(c["detections"])).alias("n_detections"), F.array_max(F.transform(chunks, lambda c: c["best_score"])).alias("best_score"))


@register("voice_set_difference", "SELECT DISTINCT event_type FROM events EXCEPT SELECT DISTINCT event_type FROM events WHERE value > 490")
def voice_set_difference(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select("event_type").distinct().join(events.filter("value > 490").select("event_type").distinct(), "event_type", "left_anti")


@register("stream_dedupe", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY user_id")
def stream_dedupe(spark, sf_dir):
    found = jobs.deduplicated(spark, f"{sf_dir}/events.parquet")
    return found.groupBy("user_id").agg(F.count("*").alias("n"))


@register("stream_keyword_counts", "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (WHERE list_contains(regexp_extract_all(lower(text), '[a-z'']+'), 'the')) AS n_hits FROM conversations GROUP BY conv_id")
def stream_keyword_counts(spark, sf_dir):
    return jobs.keyword_counts(spark, f"{sf_dir}/conversations.parquet", "the")


@register("stream_running_offset", f"WITH {CHUNKS} SELECT stream, count(*) AS n_chunks, round(sum(coalesce(duration, 5.0)), 3) AS total FROM ch GROUP BY stream")
def stream_running_offset(spark, sf_dir):
    found = jobs.running_offsets(spark, f"{sf_dir}/events.parquet")
    return found.groupBy("stream").agg(F.max("n_chunks").alias("n_chunks"), F.round(F.max("total"), 3).alias("total"))
