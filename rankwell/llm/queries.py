"""The registered queries of this folder and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import (
    alignment, chat, collocations, decontamination, grid_join, language, licenses, mixing, ngram_join, quality, repeats,
    token_files, toxicity,
)
from rankwell.llm.shared import table
from rankwell.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@_query("op1_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_jaccard_classes(table(spark, folder, "documents"), n=4, percent=85)


@_query("op2_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query("op3_remove_repeats")
def remove_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


@_query("op4_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op5_token_files")
def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_records(table(spark, folder, "documents"), scratch_path(spark, "tokens"), word_tokenizer())


@_query("op6_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op7_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(table(spark, folder, "documents"))


@_query("op8_decontaminate", decontamination.contaminated_sql())
def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@_query("op9_chat_format")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.formatted_digests(rows.unionByName(extra))


@_query("op10_quality_rules", quality.quality_sql())
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, folder, "documents"))


@_query("op11_grid_order_join")
def grid_order_join(spark: SparkSession, folder: str) -> DataFrame:
    return grid_join.near_copies(table(spark, folder, "embeddings"), threshold=0.9)


@_query("op12_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment_scores(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op13_collocations", collocations.collocations_sql())
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
