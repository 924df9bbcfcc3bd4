"""A training-data pipeline over `documents`: every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm import bottom_k, mixing, packing, quality_rules, secret_scan
from clipledger.llm.common import table, written
from clipledger.llm.tokens import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id.

    Rows without an id stay; rows that share one are one document, of which every text stays once.
    """
    kept = written(bottom_k.near_duplicates(docs).where("kept").select("doc_id").distinct(), "pipeline-kept")
    one = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret."""
    return secret_scan.masked_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order that interleaves the sources by the square roots of their sizes."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 2048 tokens, documents taken and sequences numbered in the order docs were written."""
    docs, places = packing.file_places(docs)
    return packing.pack_documents(docs, vocabulary_path(), places=places)


STAGES = [
    ("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", secrets), ("source_mix", mix),
    ("best_fit_packing", pack),
]
#: Learned rules, character models and a tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
