"""Labels for failures, downloads, encoder errors and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS, MIB
from clipledger.constants import ERROR_MESSAGES
from clipledger.functions.failures import durable_failure, hardware_failure
from clipledger.functions.shared import whole_number


def resolve_failure_durability(failures: DataFrame) -> DataFrame:
    """Failed resolves per resolver, kind and whether the failure is durable."""
    return (
        failures.withColumn("durable", durable_failure("kind", "status", "message"))
        .groupBy("resolver", "kind", "durable")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def download_outcomes(
    downloads: DataFrame,
    *,
    max_bytes: int = DEFAULTS.max_download_bytes,
    timeout_s: int = DEFAULTS.download_timeout_s,
) -> DataFrame:
    """First applicable outcome per download; a cap of 0 means no cap."""
    over_header = F.lit(max_bytes > 0) & (F.col("header_bytes") > max_bytes)
    over_stream = F.lit(max_bytes > 0) & (F.col("received_bytes") > max_bytes)
    outcome = (
        F.when(F.col("elapsed_ms") > timeout_s * 1000, "timeout")
        .when(F.col("blocked"), "ssrf_blocked")
        .when(~F.col("status").between(200, 299), "http_status")
        .when(over_header | over_stream, "too_large")
        .when(F.col("received_bytes") == 0, "empty_response")
        .when(F.col("declared_bytes") != F.col("received_bytes"), "download incomplete")
        .otherwise("ok")
    )
    seen = F.when(over_header, F.col("header_bytes")).otherwise(F.col("received_bytes"))
    large = F.col("outcome") == "too_large"
    return downloads.withColumn("outcome", outcome).select(
        "id",
        "outcome",
        F.when(large, F.floor(seen / MIB)).alias("size_mb"),
        F.when(large, F.lit(max_bytes // MIB).cast("bigint")).alias("max_mb"),
    )


def download_outcome_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def probe_flags(
    downloads: DataFrame,
    *,
    upload_bytes: int = DEFAULTS.max_upload_bytes,
    buffer_bytes: int = DEFAULTS.buffer_bytes,
    max_bytes: int = DEFAULTS.max_download_bytes,
) -> DataFrame:
    """Adds must_probe, should_probe, memory_only and reserve_bytes."""
    size = F.col("declared_bytes")
    must = size.isNull()
    should = (
        must
        | ~F.col("has_duration")
        | ~F.col("has_resolution")
        | ((F.col("media_type") == "video") & (size > upload_bytes))
    )
    memory = ~F.col("should_probe") & F.coalesce(size.between(1, min(buffer_bytes, upload_bytes)), F.lit(False))
    known = F.coalesce("header_bytes", "declared_bytes")
    reserve = F.when(F.col("memory_only"), 0).when(known > 0, known).otherwise(max(max_bytes, 0))
    return (
        downloads.withColumn("must_probe", must)
        .withColumn("should_probe", F.coalesce(should, F.lit(False)))
        .withColumn("memory_only", memory)
        .withColumn("reserve_bytes", reserve.cast("bigint"))
    )


def probe_requirements(downloads: DataFrame, **limits: int) -> DataFrame:
    return probe_flags(downloads, **limits).select(
        "id", "must_probe", "should_probe", "memory_only", "reserve_bytes"
    )


def probe_requirement_totals(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("must_probe", "should_probe", "memory_only").agg(
        F.count(F.lit(1)).alias("n"), F.sum("reserve_bytes").alias("reserve_bytes")
    )


def hw_failure_match(attempts: DataFrame) -> DataFrame:
    """Encoder attempts and whether their error text blames their hardware backend."""
    return attempts.select(
        "attempt_id", "backend", hardware_failure(F.col("backend"), F.col("stderr")).alias("is_hw_failure")
    )


def _backoff(attempt: Column, base: int, most: int) -> Column:
    """base * 2^min(attempt, 8), at most ``most``."""
    doubled = F.lit(base).cast("bigint") * F.pow(F.lit(2.0), F.least(attempt, F.lit(8))).cast("bigint")
    return F.least(doubled, F.lit(most).cast("bigint"))


def retry_schedule(
    http_attempts: DataFrame, max_retries: int = DEFAULTS.max_retries, *, jitter: bool = False
) -> DataFrame:
    """Per request: tries made, milliseconds waited and how it ended.

    ``attempt`` counts from 0.  The first attempt that succeeds, cannot be retried or
    uses up the retries ends the request, so only waits before it count; the few
    waits are kept as one conditional sum each and no ordering is needed.
    """
    a, outcome = F.col("attempt"), F.col("outcome")
    code = whole_number(outcome, "int")
    good = code.between(200, 299)
    retryable = outcome.isin("timeout", "request_error", "cancelled") | (code == 429) | code.between(500, 599)
    wait = (
        F.when((code == 429) & F.col("retry_after_ms").isNotNull(), F.greatest("retry_after_ms", F.lit(0)))
        .when(code == 429, _backoff(a, 1_000, 15_000))
        .otherwise(_backoff(a, 500, 8_000))
    )
    if jitter:
        wait = wait + F.pmod(F.xxhash64("req", "attempt"), F.lit(250))
    good, retryable = F.coalesce(good, F.lit(False)), F.coalesce(retryable, F.lit(False))
    ending = F.when(good, "ok").when(~retryable, "not_retryable").when(a >= max_retries, "gave_up")
    rows = http_attempts.select("req", "attempt", ending.alias("_ending"), wait.alias("_wait"))
    waits = [F.sum(F.when(a == i, F.col("_wait"))).alias(f"_w{i}") for i in range(max_retries)]
    folded = rows.groupBy("req").agg(
        F.min(F.when(F.col("_ending").isNotNull(), F.struct("attempt", "_ending"))).alias("_end"),
        F.count(F.lit(1)).alias("_seen"),
        *waits,
    )
    last = F.coalesce(F.col("_end.attempt"), F.col("_seen"))
    total = sum(
        (F.when(last > i, F.coalesce(F.col(f"_w{i}"), F.lit(0))).otherwise(0) for i in range(max_retries)),
        F.lit(0).cast("bigint"),
    )
    return folded.select(
        "req",
        F.coalesce(F.col("_end.attempt") + 1, F.col("_seen")).alias("n_attempts"),
        total.alias("total_delay_ms"),
        F.coalesce(F.col("_end._ending"), F.lit("unfinished")).alias("final"),
    )


def error_notifications(errors: DataFrame) -> DataFrame:
    """User message and notify flag per error, counted; the rule table is a fixed ten rows.

    Kinds that no rule knows are counted as ``unmapped`` and notify.
    """
    spark = errors.sparkSession
    rules = spark.createDataFrame(ERROR_MESSAGES, "error_kind string, source string, message string, notify boolean")
    exact = rules.where("source IS NOT NULL").select(
        "error_kind", F.col("source").alias("source_kind"), F.col("message").alias("_m1"), F.col("notify").alias("_n1")
    )
    general = rules.where("source IS NULL").select(
        "error_kind", F.col("message").alias("_m2"), F.col("notify").alias("_n2")
    )
    return (
        errors.groupBy("error_kind", "source_kind")
        .agg(F.count(F.lit(1)).alias("_c"))
        .join(F.broadcast(exact), ["error_kind", "source_kind"], "left")
        .join(F.broadcast(general), "error_kind", "left")
        .groupBy(
            F.coalesce("_m1", "_m2", F.lit("unmapped")).alias("message"),
            F.coalesce("_n1", "_n2", F.lit(True)).alias("notify"),
        )
        .agg(F.sum("_c").alias("n"))
    )
