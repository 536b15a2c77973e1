"""From raw documents to packed sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.best_fit_packing import pack_documents
from quadrille.llm.common import stage, table
from quadrille.llm.line_dedup import dedup_lines
from quadrille.llm.quality_classifier import classify
from quadrille.llm.shingle_dedup import keep_similar
from quadrille.llm.substring_dedup import dedup_substrings


def _retold(docs: DataFrame, text: DataFrame) -> DataFrame:
    """text: docs with a changed text, and n_chars after it."""
    return text.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    rejected = classify(docs, table(spark, sf_dir, "labels")).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one repeats."""
    return _retold(docs, dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of pairs of similarity 0.8 or more in shingles of five words."""
    return keep_similar(docs, width=5, similarity=0.8).select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words in windows of 13 that an earlier one holds."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    return _retold(docs, dedup_substrings(docs, keep_text=True, names=rest).withColumnRenamed("kept_text", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, and its place in a sequence."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("best-fit packing", packing),
]

#: The classifier and the tokenizer are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs, _ = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
