from pyspark.sql import functions as F

from hearken.llm import toxicity
from hearken.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.1"


def test_folding():
    assert toxicity.fold("ІDIОT, 1d10t i$diot!! $$$ 4524") == " idiot idiot isdiot 4524 "
    assert toxicity.fold("ｍｏｒｏｎ loser l0ser") == " moron ioser ioser "
    assert toxicity.fold("") == "  "


def test_held_out_accuracy(spark):
    scored = QUERIES["op10_toxicity"](spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").filter("toxic IS NOT NULL")
    assert scored.count() == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert len(rows) > 50 and wrong <= 0.02 * len(rows)


def test_lexicon_exceptions_and_edges(spark):
    toxic = [(i, f"you are a scum and word{i} other{i} text{i}", "x") for i in range(40)]
    clean = [(100 + i, f"pond scum grows where water{i} rests{i}" if i % 4 == 0 else f"fine words{i} here{i} about{i} things{i}", "x") for i in range(120)]
    docs = spark.createDataFrame([*toxic, *clean, (999, None, "x"), (999, None, "x"), (998, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, *_ in [*toxic, *clean]] + [(999, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    lexicon = toxicity.Lexicon({" scum ": 3.0}, toxicity._exceptions(toxicity.Lexicon({" scum ": 3.0}), [(toxicity.fold(t), int(i < 100)) for i, t, _ in [*toxic, *clean]]), (-4.0, 4.0, 0.0))
    assert " pond scum " in lexicon.exceptions
    out = {r["doc_id"]: r for r in toxicity.score(docs.drop("score"), lexicon, ["doc_id"]).collect()}
    assert out[3]["predicted"] == 1 and out[100]["predicted"] == 0 and out[998]["n_hits"] == 0
    assert toxicity.score(docs.drop("score").limit(0), lexicon, ["doc_id"]).count() == 0
    nothing = toxicity.learn(docs, labels.filter(F.lit(False)))
    assert nothing.weights == {}


def test_hits_against_one_by_one():
    """Hits without those in an exception, against a look at every pair of them."""
    lexicon = toxicity.Lexicon({" scum ": 3.0, " scu": 1.0, " mud": 2.0}, {" pond scum ", " scum mud "}, (-4.0, 4.0, 0.0))
    folded = toxicity.fold(" ".join(["pond scum mud scum", "mud pond scum scum mud", "scumy mud"] * 40))
    every = [(i, w) for p, w in lexicon.weights.items() for i in range(len(folded)) if folded.startswith(p, i)]
    ranges = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
    want = {}
    for i, w in every:
        if not any(a <= i < b - 1 for a, b in ranges):
            want[i] = max(w, want.get(i, 0))
    assert lexicon.hits(folded) == want


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a scum", "x", 5, 6)], "doc_id long, text string, score string, predicted int, n_hits int")
    out = toxicity.score(docs, toxicity.Lexicon({" scum ": 3.0}, set(), (-4.0, 4.0, 0.0)), docs.columns)
    assert sorted(out.columns) == sorted(docs.columns) and out.first()["n_hits"] == 1
