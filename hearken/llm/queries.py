"""The registered queries of the training-data operators, each over its whole table, with SQL
equivalents where SQL can express them. The operators keep their own interfaces; these add the
digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.llm import collocations, decontamination, divergence, html_extraction, jaccard_join, language_id, pii_surrogates, quality, secret_scan, sentencepiece_codec, token_files, toxicity, url_filters
from hearken.llm.shared import table

URL_RULES = ["allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/"]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    network = language_id.learn(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")), network, ["doc_id", "held_out"])


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), [url_filters.parse_rule(r) for r in URL_RULES])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.as_text(base), 256).alias("base_sha256"), secret_scan.as_text(F.col("found")).alias("spans"), "n_random")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("hearken.pii.key", "for tests only")
    replaced = pii_surrogates.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return replaced.select("doc_id", "text", "n_entities", F.array_join("kinds", ",").alias("kinds"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents")).drop("text_key", "comp")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(table(spark, sf_dir, "documents"), ["doc_id"], checked=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "round_trip")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).drop("lang", "text_key")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    lexicon = toxicity.learn(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return toxicity.score(marked, lexicon, ["doc_id", "held_out"])


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.new_folder(spark)
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_files.digests(spark, folder)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_extraction": op7_html_extraction,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_collocations": op12_collocations,
    "op13_divergence": op13_divergence,
    "pipeline": pipeline,
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

ORACLES: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS gram, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op3_url_filters": r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, rv)),
m AS (SELECT page_id, rh, rp, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
      FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1""",
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
c AS MATERIALIZED (SELECT lang, k, g, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING k = 1 OR count(*) >= 10),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY 1),
parts AS MATERIALIZED (SELECT lang, k, g, f AS a, cut, array_to_string(split(g, ' ')[1 : cut], ' ') AS lp, array_to_string(split(g, ' ')[cut + 1 : k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM c WHERE k > 1)),
cuts AS (SELECT p.lang, p.k, p.g, a, cut, x.f AS l, y.f AS r, (1000000 * a * a) // (x.f * y.f) AS score
         FROM parts p JOIN c x ON x.lang = p.lang AND x.g = p.lp JOIN c y ON y.lang = p.lang AND y.g = p.rp),
best AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inside AS (SELECT lang, h, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(split(g, ' ')[1:2], ' '), array_to_string(split(g, ' ')[2:3], ' ')]) AS h, a FROM best WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.lang, b.g AS phrase, a, l, r, score FROM best b LEFT JOIN inside i ON b.k = 2 AND i.lang = b.lang AND i.h = b.g
         WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY 1),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (total + 2 * v) AS q FROM k JOIN l USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, q.term, coalesce(c.n, 0) AS n, q, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(gn.total, 0) + 2 * v) AS p
      FROM g JOIN q USING (lang) JOIN l USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = q.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
