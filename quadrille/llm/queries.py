"""The queries of this subpackage: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, sql
from .best_fit_packing import pack_documents
from .common import table
from .embedding_dedup import embedding_components
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .quality_classifier import classify
from .quality_rules import quality_rules
from .sentencepiece_viterbi import encode_pieces
from .simhash_dedup import simhash_components
from .substring_dedup import dedup_substrings


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), ids=False)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preference_pairs(table(spark, sf_dir, "conversations"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain counts of op3, which SQL can express."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def chat_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a common prefix: each conversation, and a copy of it with another last turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("stop"))
    last = F.when(F.col("turn") == F.col("stop"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    copies = turns.join(ends, "conv_id").select((F.col("conv_id") * 2 + 1).alias("conv_id"), "turn", "role", last.alias("text"))
    return chat_format.preference_pairs(turns.withColumn("conv_id", F.col("conv_id") * 2).unionByName(copies))


_QUERIES = (
    op1_license_scan, op2_line_dedup, op3_quality_rules, op4_best_fit_packing, op5_sentencepiece, op6_chat_format,
    op7_substring_dedup, op8_simhash_dedup, op9_embedding_dedup, op10_quality_classifier, base_quality, chat_forks,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": sql.license_scan(),
        "op2_line_dedup": sql.LINE_DEDUP,
        "op6_chat_format": chat_format.SQL,
        "op7_substring_dedup": sql.SUBSTRING_DEDUP,
        "op9_embedding_dedup": sql.EMBEDDING_DEDUP,
        "base_quality": sql.BASE_QUALITY,
        "chat_forks": sql.CHAT_FORKS,
    }
