"""Counters, averages and status rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS
from clipledger.constants import ERROR_CATEGORIES, STAGES, UPLOAD_STAGES
from clipledger.functions.failures import any_hardware_failure


def _closed(spark, name: str, values: list[str]) -> DataFrame:
    """A fixed dimension table."""
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def int_avg(total: Column, count: Column) -> Column:
    """Floor of total / count, 0 for no samples; both are non-negative integers."""
    return F.coalesce(F.call_function("div", total, F.when(count > 0, count)), F.lit(0).cast("bigint"))


def run_totals(jobs: DataFrame) -> DataFrame:
    """Runs, successes and failures; duplicates never became a run."""
    ran = jobs.where(F.coalesce(F.col("error_kind") != "duplicate", F.lit(True)))
    return ran.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if("ok").alias("successes"),
        F.count_if(~F.col("ok")).alias("failures"),
    )


def stage_averages(stage_runs: DataFrame) -> DataFrame:
    """Samples and integer average per stage; every stage appears."""
    got = stage_runs.groupBy("stage").agg(
        F.sum("duration_ms").alias("_sum"), F.count("duration_ms").alias("_n")
    )
    samples = F.coalesce("_n", F.lit(0))
    return _closed(stage_runs.sparkSession, "stage", STAGES).join(got, "stage", "left").select(
        "stage", int_avg(F.col("_sum"), F.col("_n")).alias("avg_ms"), samples.alias("samples")
    )


def stage_window(stage_runs: DataFrame, window_s: int) -> DataFrame:
    """Stage averages per tumbling window of event time, for windows and stages that have runs."""
    start = (F.floor(F.unix_seconds("ts") / window_s) * window_s).alias("window_start_s")
    return stage_runs.groupBy(start, "stage").agg(
        int_avg(F.sum("duration_ms"), F.count("duration_ms")).alias("avg_ms"),
        F.count("duration_ms").alias("samples"),
    )


def error_category_counts(failures: DataFrame) -> DataFrame:
    """Failures per known category, zero-filled; unknown keys are dropped."""
    return zero_filled_categories(failures.groupBy("category").agg(F.count(F.lit(1)).alias("n")))


def zero_filled_categories(counts: DataFrame) -> DataFrame:
    """(category, n) for exactly the known categories."""
    return _closed(counts.sparkSession, "category", ERROR_CATEGORIES).join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("n")
    )


def job_diagnostics(jobs: DataFrame) -> DataFrame:
    """Completed, failed, timeout and hardware failures over all jobs."""
    return jobs.agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count_if(F.col("error_kind") == "timeout").alias("timeouts"),
        F.count_if(
            (F.col("error_kind") == "transcode_failed") & any_hardware_failure(F.col("stderr_tail"))
        ).alias("hardware_failures"),
    )


def job_diagnostics_by_kind(jobs: DataFrame) -> DataFrame:
    """Failed jobs per error kind and source kind with subtotals; ``level`` is 0 for detail rows."""
    return (
        jobs.where(~F.col("ok"))
        .rollup("error_kind", "source_kind")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))
    )


def encoder_stats(encodes: DataFrame, backend: str = "backend", duration_ms: str = "duration_ms") -> DataFrame:
    """Hardware and software encodes, their integer averages and the hardware share."""
    hw = F.col(backend) != "none"
    return encodes.agg(
        F.count_if(hw).alias("hw_count"),
        F.count_if(~hw).alias("sw_count"),
        int_avg(F.sum(F.when(hw, F.col(duration_ms))), F.count_if(hw)).alias("hw_avg_ms"),
        int_avg(F.sum(F.when(~hw, F.col(duration_ms))), F.count_if(~hw)).alias("sw_avg_ms"),
    ).withColumn(
        "hw_pct",
        F.when(
            F.col("hw_count") + F.col("sw_count") > 0,
            F.round(F.col("hw_count") * 100.0 / (F.col("hw_count") + F.col("sw_count")), 6),
        ),
    )


def upload_timing(upload_runs: DataFrame) -> DataFrame:
    """Total time, slowest step (the later one on ties) and throughput per upload."""
    names = ["prepare_ms", "send_ms", "parse_ms", "cleanup_ms"]
    slow = F.array_max(
        F.array(
            *(
                F.struct(F.col(c).alias("ms"), F.lit(i).alias("ord"), F.lit(UPLOAD_STAGES[i]).alias("name"))
                for i, c in enumerate(names)
            )
        )
    )
    return upload_runs.withColumn("_slow", slow).select(
        "id",
        sum((F.col(c) for c in names[1:]), F.col(names[0])).alias("total_ms"),
        F.col("_slow.name").alias("slow_stage"),
        F.col("_slow.ms").alias("slow_ms"),
        F.when(
            F.col("send_ms") > 0, F.round(F.col("payload_bytes") / (F.col("send_ms") / 1000.0), 3)
        ).alias("bytes_per_s"),
    )


def upload_timing_rollup(timed: DataFrame) -> DataFrame:
    return timed.groupBy("slow_stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum("slow_ms").alias("slow_ms"), F.sum("total_ms").alias("total_ms")
    )


CACHE_TTLS = {
    "dedup": DEFAULTS.dedup_ttl_s,
    "resolver_positive": DEFAULTS.positive_ttl_s,
    "resolver_negative": DEFAULTS.negative_ttl_s,
}


def live_cache_counts(entries: DataFrame, now_s: Column | int, ttls: dict[str, int] = CACHE_TTLS) -> DataFrame:
    """Entries alive at ``now_s`` per cache: dedup keeps its last second, resolver caches do not."""
    now = F.lit(now_s) if isinstance(now_s, int) else now_s
    age = F.greatest(now - F.col("ts"), F.lit(0))
    alive = F.lit(False)
    for cache, ttl in ttls.items():
        fresh = age <= ttl if cache == "dedup" else age < ttl
        alive = alive | ((F.col("cache") == cache) & fresh)
    got = entries.where(alive).groupBy("cache").agg(F.count(F.lit(1)).alias("_n"))
    return _closed(entries.sparkSession, "cache", list(ttls)).join(got, "cache", "left").select(
        "cache", F.coalesce("_n", F.lit(0)).alias("n")
    )


def status_summary(
    totals: DataFrame, encoders: DataFrame, caches: DataFrame, queue: DataFrame, pending: DataFrame
) -> DataFrame:
    """One row holding the columns of all one-row inputs; ``caches`` is turned sideways first."""
    sideways = caches.agg(
        *(F.coalesce(F.sum(F.when(F.col("cache") == c, F.col("n"))), F.lit(0)).alias(f"live_{c}") for c in CACHE_TTLS)
    )
    inputs = (totals, encoders, sideways, queue, pending)
    stacked = inputs[0]
    for part in inputs[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    # each column has exactly one non-null value, so max picks it without a cross join
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))
