"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, token files; each stage on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import decontamination, mixing, ngram_join, token_files, toxicity
from rankwell.llm.queries import word_tokenizer
from rankwell.llm.shared import bounded_batches, table
from rankwell.scratch import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject.

    Rows without an id are judged by their text as well, rows that repeat one each by its own; null and empty
    texts are scored like a text without signs.  All columns stay as they are.  An empty table stays empty.
    """
    bounded_batches(spark)
    scores = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return scores.where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of every class linked by 5-word shingles at 0.8.

    Rows without an id stay, and so do texts without words.  Of rows that repeat an id the first by its other
    columns stays.
    """
    bounded_batches(spark)
    classes = ngram_join.ngram_jaccard_classes(docs, n=5, percent=80)
    gone = classes.where("doc_id <> component_id").select("doc_id").distinct()
    # A row that repeats the kept id is a copy of it, or a version of it; the first text by order stays.
    kept = docs.join(gone, "doc_id", "left_anti")
    rest = [c for c in docs.columns if c != "doc_id"]
    named = kept.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("_r"))
    return named.select("doc_id", "_r.*").select(docs.columns).unionByName(kept.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.  Rows that repeat an id go together; null texts stay."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as rows of equal columns; texts without words are never taken."""
    mixed = mixing.mix_sources(docs, carry=docs.columns)
    return mixed.withColumn("_k", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))))).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards and index; a row per document and copy as read back, null texts with the end id alone."""
    bounded_batches(spark)
    return token_files.token_records(docs, scratch_path(spark, "tokens"), word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("token_files", write_tokens),
]

#: Models, dependent rounding and token files are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's result is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
