"""Audits of URLs, resolved addresses and redirect chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS
from clipledger.constants import BLOCKED_V4, BLOCKED_V6
from clipledger.functions.addresses import readable, with_blocked
from clipledger.functions.urls import with_policy


def url_policy_audit(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, port and the first failing rule (``ok`` when none)."""
    return with_policy(urls, url)


def url_policy_counts(audited: DataFrame) -> DataFrame:
    return audited.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def resolved_ip_audit(
    url_ips: DataFrame,
    *,
    key: str = "url_id",
    ip: str = "ip",
    rules: DataFrame | Sequence[str] = (*BLOCKED_V4, *BLOCKED_V6),
) -> DataFrame:
    """Per key: any blocked address rejects it, and so does an unreadable one or having none.

    ``rules``: blocked ranges as a list, or a table of any size with a column ``cidr``.
    """
    known = readable(F.col(ip))
    # unreadable text never reaches the parser
    staged = url_ips.select(key, F.when(known, F.col(ip)).alias("_ip"), (~known).alias("_unread"))
    return (
        with_blocked(staged, "_ip", "_blocked", rules)
        .groupBy(key)
        .agg(
            (F.count("_ip") + F.count_if("_unread")).alias("n_addrs"), F.count_if("_blocked").alias("n_blocked"),
            F.count_if("_unread").alias("_unread"),
        )
        .withColumn(
            "reason",
            F.when(F.col("n_blocked") > 0, "resolved to blocked ip")
            .when(F.col("_unread") > 0, "unreadable ip")
            .when(F.col("n_addrs") == 0, "dns lookup returned no addresses")
            .otherwise("ok"),
        )
        .drop("_unread")
    )


def redirect_chain_audit(hops: DataFrame, max_redirects: int = DEFAULTS.max_redirects) -> DataFrame:
    """Per request: the hop that ends the chain decides; ``incomplete`` if the log stops before one does."""
    policy = F.col("reason")
    redirected = F.col("status").between(300, 399)
    verdict = (
        F.when(policy != "ok", policy)
        .when(~redirected, "ok")
        .when(F.col("location").isNull(), "redirect missing location header")
        .when(F.col("hop") >= max_redirects, "too many redirects")
    )
    ended = with_policy(hops, "url").withColumn("_verdict", verdict)
    end = F.min(F.when(F.col("_verdict").isNotNull(), F.struct("hop", "_verdict", "url")))
    return (
        ended.groupBy("req")
        .agg(end.alias("_end"), F.count(F.lit(1)).alias("_seen"))
        .select(
            "req",
            F.coalesce(F.col("_end.hop") + 1, F.col("_seen")).alias("n_hops"),
            F.when(F.col("_end._verdict") == "ok", F.col("_end.url")).alias("final_url"),
            F.coalesce(F.col("_end._verdict"), F.lit("incomplete")).alias("reason"),
        )
    )
