"""Cleaning a corpus: each stage reads what its predecessor kept, as Parquet, and all but the last return documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables (an empty table gives an
empty one), and hands on columns that it doesn't know as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontam, jaccard_join, packing, pii, quality
from tidewire.llm.common import bounded_broadcast, documents, materialize
from tidewire.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the strict policy rejects go; null and empty texts have too few words and go too. Repeated rows are
    judged alike."""
    return quality.filter_documents(docs, quality.STRICT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: shingles of five words, similarity 0.8, the smallest id.

    A document is an id and a text: different texts under one id, or without an id, are documents of their own, and repeated
    rows are one. Ties take the smaller id, then the smaller hash of the text; no id comes last. Texts without words are
    like no others, so they all stay.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return firsts_of_classes(docs, "doc_id")
    th = F.xxhash64("text")
    keys = docs.select(F.col("doc_id").alias("_id"), th.alias("_th")).distinct().orderBy(F.col("_id").asc_nulls_last(), "_th")
    keys = materialize(keys.withColumn("_key", F.monotonically_increasing_id()), "document-keys")  # rises with the id
    keyed = docs.join(bounded_broadcast(keys, keys.count(), 1_000_000), F.col("doc_id").eqNullSafe(F.col("_id")) & (th == F.col("_th")))
    return firsts_of_classes(keyed.select(*docs.columns, "_key"), "_key").dropDuplicates(["_key"]).drop("_key")


def firsts_of_classes(docs: DataFrame, key: str) -> DataFrame:
    classes = materialize(jaccard_join.similarity_classes(docs, 5, 80, key), "classes-of-docs")
    drop = materialize(classes.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_drop")).distinct(), "drop")
    return docs.join(bounded_broadcast(drop, drop.count(), 1_000_000), F.col(key) == F.col("_drop"), "left_anti")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none. Rows of one id are judged by their texts."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind; n_chars follows the text. A null text stays null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 tokens; every row is packed, a null or empty text as its end alone."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL expresses neither the tokenizer nor the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
