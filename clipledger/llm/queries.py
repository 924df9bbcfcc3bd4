"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm import bottom_k, kmeans_tree, line_dedup, mixing, packing, periodic_runs, pitman_yor, quality_rules, ranked_search, secret_scan, suffix_dedup, token_store, warc
from clipledger.llm.common import table, written
from clipledger.llm.tokens import vocabulary_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.cut_documents(table(spark, root, "documents"))


def op2_pfair_source_mix(spark: SparkSession, root: str) -> DataFrame:
    """Weights are the square roots of the sources' sizes."""
    return mixing.interleaved(table(spark, root, "documents"))


def op3_kmeans_tree_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, root, "embeddings"), "vec_id % 20 = 0", k=20)


def op4_decision_list_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.judged(table(spark, root, "documents"), table(spark, root, "labels"))[0]


def op5_dictionary_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.read_archives(written(warc.write_archives(table(spark, root, "pages"), at_least=0), "warc-manifest"))


def op6_bottom_k_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, root, "documents"), 3, Fraction(85, 100))


def op7_bit_plane_tokens(spark: SparkSession, root: str) -> DataFrame:
    shards = written(token_store.write_shards(table(spark, root, "documents"), vocabulary_path()), "token-manifest")
    return token_store.read_shards(shards)


def op8_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack_documents(table(spark, root, "documents"), vocabulary_path())


def op9_markov_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return secret_scan.scanned(table(spark, root, "documents"))


def op10_pitman_yor_scores(spark: SparkSession, root: str) -> DataFrame:
    held_out = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 1"
    return pitman_yor.scored(table(spark, root, "documents"), held_out)


def op11_best_position_search(spark: SparkSession, root: str) -> DataFrame:
    return ranked_search.search(table(spark, root, "documents"), table(spark, root, "benchmark"), k=10)


def op12_cuckoo_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    docs, index = table(spark, root, "documents"), line_dedup.LineIndex(spark)
    index.insert(docs)
    return index.kept(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_sparse_diagonal_runs(spark: SparkSession, root: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, root, "documents"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, least=6, times=4))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from clipledger.llm.oracle import SQL

    return SQL
