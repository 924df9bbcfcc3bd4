"""Links, extensions and log tails from text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.constants import CANONICAL_PREFIX, LINK_PATTERN, LOG_LINE_BYTES, LOG_TAIL_ERROR
from clipledger.functions.links import link_matches, post_id
from clipledger.functions.urls import media_extension


def extract_links(texts: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """One row per usable post link, in order of appearance; repeats stay."""
    found = texts.where(F.col(text_col).contains("/status/")).select(
        # outer, then filtered: an inner explode would match every text twice more to skip empty ones
        id_col, *keep, F.posexplode_outer(link_matches(text_col)).alias("pos", "original_url")
    ).where("pos IS NOT NULL")
    link = F.col("original_url")
    return found.select(
        id_col, *keep, "pos",
        F.regexp_extract(link, LINK_PATTERN, 1).alias("user"),
        post_id(link).alias("tweet_id"),
        "original_url",
    ).withColumn(
        "canonical_url",
        F.concat(F.lit(CANONICAL_PREFIX), "user", F.lit("/status/"), F.col("tweet_id").cast("string")),
    )


def canonical_link_stats(links: DataFrame, ts: str = "ts") -> DataFrame:
    """Mentions, host aliases and first/last time per canonical URL."""
    host = F.regexp_extract("original_url", "^https?://([^/]+)/", 1)
    return links.groupBy("canonical_url").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(host).alias("n_hosts"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def with_extension(media_urls: DataFrame, type_col: str = "type", url_col: str = "url") -> DataFrame:
    return media_urls.withColumn("ext", media_extension(F.col(type_col), F.col(url_col)))


def extension_profile(media_urls: DataFrame, type_col: str = "type", url_col: str = "url") -> DataFrame:
    """Media URLs per (type, normalised extension)."""
    return (
        with_extension(media_urls, type_col, url_col)
        .groupBy(F.col(type_col).alias("media_type"), "ext")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _cut_bytes(text: str, limit: int) -> Column:
    """At most ``limit`` UTF-8 bytes; a split character becomes the replacement mark."""
    head = F.substring(F.encode(F.col(text), "UTF-8"), 1, limit).cast("string")
    return F.when(F.octet_length(text) > limit, F.make_valid_utf8(head)).otherwise(F.col(text))


def log_tail(
    lines: DataFrame,
    n: int = LOG_TAIL_ERROR,
    *,
    proc: str = "proc",
    line_no: str = "line_no",
    text: str = "text",
    line_bytes: int = LOG_LINE_BYTES,
) -> DataFrame:
    """Last ``n`` lines per process joined in order.

    ``truncated`` tells that earlier lines were dropped, ``cut_lines`` how many of the
    joined ones were longer than ``line_bytes``.  Lines are cut where they are read; one
    line more than needed is kept to tell whether anything was dropped, and the rank
    filter is applied per map task before the shuffle, so a chatty process sends few rows.
    """
    short = lines.select(
        proc, line_no, _cut_bytes(text, line_bytes).alias("_line"), (F.octet_length(text) > line_bytes).alias("_cut")
    )
    ranked = short.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(proc).orderBy(F.col(line_no).desc()))
    ).where(F.col("_rn") <= n + 1)
    kept = F.when(F.col("_rn") <= n, F.struct(F.col(line_no).alias("at"), F.col("_line").alias("line")))
    return ranked.groupBy(proc).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["line"]), "\n").alias("tail"),
        (F.count(F.lit(1)) > n).alias("truncated"),
        F.count_if((F.col("_rn") <= n) & F.col("_cut")).alias("cut_lines"),
    )
