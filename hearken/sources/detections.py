"""Declared schemas of the nested detection log and its companions; later additions are nullable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DETECTION = "struct<time:double,score:double,raw_cos:double,scale:double,phone_sim:double,rescued:boolean>"
DETECTIONS = (
    "keyword string, threshold double, anchor string, window_seconds double, "
    "phone_verification struct<model:string,tau:double,n_refs:int,fa_percentile:double>, "
    "chunks array<struct<file:string,skipped:boolean,n_windows:int,best_score:double,best_raw_cos:double,best_time:double,"
    f"best_scale:double,best_phone_sim:double,phone_verified:boolean,detections:array<{_DETECTION}>,candidates:array<{_DETECTION}>>>"
)


def with_default_scale(detections: Column) -> Column:
    """Older logs have no scale; theirs is 1."""
    return F.transform(detections, lambda d: d.withField("scale", F.coalesce(d["scale"], F.lit(1.0))))


#: Fixed names: what a calibration says of a keyword.
CALIBRATION = (
    "keyword string, threshold double, fa_percentile double, top_k int, window_samples long, neg_mean double, neg_std double, neg_max double, neg_p99 double, "
    "pos_mean double, pos_min double, pos_raw_cos_mean double, neg_raw_cos_mean double, n_pos long, n_neg long, calibrated_at timestamp"
)
MANIFEST = "sample_rate int, voices int, eval_words array<string>, bank map<string,array<string>>"
TRUTH = "map<string,array<struct<word:string,start:double,end:double>>>"
#: Tables in place of array files: one row a keyword, and one a vector of its cohort.
ANCHORS = "keyword string, centroid array<float>, positives array<array<float>>, window_samples long"
COHORTS = "keyword string, cohort_id long, source string, embedding array<float>"


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, by a declared schema: fields that a file lacks are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, threshold) of a document that maps one to the other."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("keyword", "threshold"))
    return read.filter("threshold IS NOT NULL")


def bank(spark: SparkSession, path: str) -> DataFrame:
    """(word, path, held_out, sample_rate): the clips of a manifest, those of evaluation words held out."""
    clips = documents(spark, path, MANIFEST).select("sample_rate", "eval_words", F.explode("bank").alias("word", "paths"))
    return clips.select("word", F.explode("paths").alias("path"), F.array_contains("eval_words", F.col("word")).alias("held_out"), "sample_rate")


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, word, start, end) of a document that maps chunks to what is said in them."""
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TRUTH)).alias("chunk", "said"))
    return read.select("chunk", F.inline("said"))


def write_table(df: DataFrame, path: str, schema: str) -> None:
    """Anchors or cohorts as Parquet by keyword, in the declared types and order."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).write.mode("overwrite").partitionBy("keyword").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.read.schema(schema).parquet(path).select(*names)
