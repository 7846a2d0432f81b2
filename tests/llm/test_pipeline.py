import re

import corpus_pipeline
from hearken.llm import quality, sentencepiece_codec
from hearken.llm.shared import stored, table
from tests.llm.data import SMALL
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secret_scan import base_spans


def item_windows(spark):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(word, lower(t))
    grams = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r["text"])
        grams |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1)) if w}
    return words, grams


def test_stages_against_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    outputs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), "test")
        outputs.append({r["doc_id"]: r for r in docs.collect()})
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == table(spark, SMALL, "documents").columns
    start = table(spark, SMALL, "documents")
    kept = {r["doc_id"] for r in quality.verdicts(start).collect() if r["kept"]}
    assert outputs[0].keys() == kept
    rows = [(i, r["text"]) for i, r in outputs[0].items()]
    comp, _ = brute(rows)
    assert outputs[1].keys() == set(comp)
    words, grams = item_windows(spark)
    lengths = {len(g) for g in grams}
    leaks = {i for i, r in outputs[1].items() if any(tuple(w[k : k + n]) in grams for w in [words(r["text"])] for n in lengths for k in range(len(w) - n + 1))}
    assert leaks and outputs[2].keys() == outputs[1].keys() - leaks
    assert outputs[3].keys() == outputs[2].keys()
    for i, r in outputs[3].items():
        assert not base_spans(r["text"])
        if not re.search(r"(?i)password|passwd|secret|token|api_?key|AKIA|[A-Za-z0-9+/_-]{20}", outputs[2][i]["text"]):
            assert r["text"] == outputs[2][i]["text"]
    codec = sentencepiece_codec.codec(sentencepiece_codec.public_model(), "zipf")
    assert outputs[4].keys() == outputs[3].keys()
    assert all(r["round_trip"] and codec.decode(r["ids"]) == outputs[3][i]["text"] and r["n_tokens"] == len(r["ids"]) for i, r in outputs[4].items())


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def some_docs(spark, extra=()):
    import random

    rng = random.Random(1)
    good = [" ".join(f"{rng.choice(WORDS)}{rng.randrange(400)}" for _ in range(120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0]), (101, None), (102, ""), (103, "too short"), (3, good[3]), (None, good[4] + " end"), *extra]
    return spark.createDataFrame([(i, t, "en" if i != 7 else None, None if i == 8 else "s", 1, "x", 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, row int").repartition(3)


def test_stages_chained_without_writing_and_called_twice(spark):
    """Results of stages stay readable whatever runs between, in this and in another pipeline."""
    docs = some_docs(spark)
    lazy = [docs]
    for _, stage in corpus_pipeline.STAGES:
        lazy.append(stage(spark, lazy[-1], SMALL))
    again = some_docs(spark, [(200, "one two three " * 40)])
    other = corpus_pipeline.STAGES[0][1](spark, again, SMALL)
    twice = [corpus_pipeline.STAGES[1][1](spark, other, SMALL) for _ in range(2)]
    written = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        written = stored(stage(spark, written, SMALL), "test")
        assert sorted(map(str, written.collect())) == sorted(map(str, lazy[k + 1].collect()))
    ids = [r["doc_id"] for r in lazy[2].collect()]
    # Of copies the smallest id stays, of repeated rows one; a null id takes part.
    assert 100 not in ids and ids.count(3) == 1 and not {101, 102, 103} & set(ids) and {0, 7, 8} <= set(ids)
    assert lazy[4].columns == docs.columns
    first, second = ([r["doc_id"] for r in t.collect()] for t in twice)
    assert sorted(first, key=str) == sorted(second, key=str)


def test_an_empty_table_gives_nothing(spark):
    docs = some_docs(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.collect() == []
