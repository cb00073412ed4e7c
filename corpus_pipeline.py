"""The corpus pipeline: toxicity, near copies, repeated passages, mixing, tokens. Each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm import bpe_queue, chosen_path, source_mixing, substring_dedup, toxicity_fm
from copse.llm.shared import fresh_path, remove, scratch, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Tokens by domain (toxic documents are gone by then) that the mix is to have; no document is left out (a rate of 1 at least).
TARGETS = {"high": 0.80, "low": 0.20}


#: What tells rows apart: doc_id, 0 where it is null, and a hash of the text.
TOLD = ["key", "unknown", "th"]


def _key() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("unknown")]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine finds toxic (0.5 or more) go."""
    docs = docs.select(*COLUMNS)
    machine = toxicity_fm.train(docs, _labels(spark, sf_dir))
    return toxicity_fm.with_toxicity(docs, machine).where("toxicity < 0.5").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies that links tie, one row stays: the smallest doc_id's (known ones first), then the smallest text hash's."""
    docs = docs.select(*COLUMNS, *_key(), F.xxhash64("text").alias("th"))
    joined = chosen_path.chosen_path_join(docs).select(*_key(), "th", "component")
    rows = joined.groupBy("component", "unknown", "key", "th").agg(F.count("*").alias("rows"))
    kept = rows.groupBy("component").agg(F.min(F.struct("unknown", "key", "th", "rows")).alias("kept")).select("kept.*")
    left = docs.join(settle(kept, "kept"), TOLD)
    same = left.where("rows > 1").dropDuplicates(TOLD)
    return left.where("rows = 1").unionByName(same).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that stand elsewhere too go; every document stays, with what is left of its text."""
    docs = docs.select(*COLUMNS, *_key(), F.xxhash64("text").alias("th"))
    kept = substring_dedup.substring_dedup(docs, texts=True).where("n_removed > 0")
    kept = kept.select(*_key(), "th", F.col("kept_text").alias("kept")).dropDuplicates(TOLD)
    joined = docs.join(kept, TOLD, "left")
    text = F.coalesce("kept", "text")
    return joined.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate says, once at least."""
    docs = docs.select(*COLUMNS)
    labels = source_mixing.domain_labels(_labels(spark, sf_dir))
    domains, targets = list(TARGETS), list(TARGETS.values())
    model = source_mixing.train(docs, labels, domains)
    path = fresh_path(spark, "mixing")
    source_mixing.posteriors(docs.withColumn("body", F.col("text")), model).withColumnRenamed("body", "text").write.parquet(path)
    table = spark.read.parquet(path)
    moves = source_mixing.fitted(table.select("tokens", "posterior"), targets, None, 1.0)
    times = source_mixing.copies(source_mixing.rate_at(moves, 1.0), F.col("doc_id"))
    return table.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests for every copy of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bpe_queue.bpe(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("tokens", tokens),
]
#: Fitted models, joins by windows and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again; what it wrote on the way is deleted then, and so are the rows of the stage before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    old = None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            remove(spark, old)
        docs, old = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
