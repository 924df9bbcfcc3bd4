"""Streaming counters, stage windows and store writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.operators import metrics
from clipledger.sources.keyed_store import KeyedStore
from clipledger.sources.stores import KEY
from clipledger.streaming.runner import drain_batches
from clipledger.session import scratch_path


def stream_stage_window(stage_runs: DataFrame, window: str = "60 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Stage averages per tumbling window, open ones included, after the available input.

    Every micro-batch writes the windows it has changed, the watermark bounds what is kept
    between them, and the last version of a window counts.
    """
    spark = stage_runs.sparkSession
    where = scratch_path(spark, "windows")
    changed = (
        stage_runs.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), "stage")
        .agg(F.sum("duration_ms").alias("_sum"), F.count("duration_ms").alias("samples"))
        .select(F.unix_seconds("window.start").alias("window_start_s"), "stage", "_sum", "samples")
    )
    seen: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{where}/v{batch_id}")
        seen.append(batch_id)

    drain_batches(changed, "update", write, where)
    versions = spark.read.parquet(*(f"{where}/v{i}" for i in seen)) if seen else spark.createDataFrame([], changed.schema).withColumn("_batch", F.lit(0))
    last = versions.groupBy("window_start_s", "stage").agg(F.max_by(F.struct("_sum", "samples"), "_batch").alias("_last"))
    return last.select(
        "window_start_s", "stage", metrics.int_avg(F.col("_last._sum"), F.col("_last.samples")).alias("avg_ms"), "_last.samples"
    )


def _latest(totals: DataFrame) -> DataFrame:
    """Run a cumulative aggregate; every micro-batch writes a snapshot of its own and the last one is returned."""
    spark = totals.sparkSession
    where = scratch_path(spark, "totals")
    seen: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/v{batch_id}")
        seen.append(batch_id)

    drain_batches(totals, "complete", write, where)
    return spark.read.parquet(f"{where}/v{max(seen)}") if seen else spark.createDataFrame([], totals.schema)


def stream_run_totals(jobs: DataFrame) -> DataFrame:
    """Cumulative runs, successes and failures after the available input."""
    return _latest(metrics.run_totals(jobs))


def stream_error_counts(failures: DataFrame) -> DataFrame:
    """Cumulative failures per known category, zero-filled."""
    counts = _latest(failures.groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    return metrics.zero_filled_categories(counts)


def stream_store_upsert(writes: DataFrame, where: str | None = None, **layout: int) -> DataFrame:
    """The dedup store after every micro-batch of (scope_id, tweet_id, ts, batch_no) writes.

    A micro-batch replaces the cells that its keys leave or enter. Batch ``i`` is update ``i`` of the
    store, so a repeated batch gives the same store again; a restart goes on from it. ``layout``:
    see ``KeyedStore``.
    """
    spark = writes.sparkSession
    where = where or scratch_path(spark, "store")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in writes.schema.fields if f.name in KEY)

    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedStore(batch.sparkSession, where, key_type=types, **layout).upsert(batch, batch_id)

    drain_batches(writes, "append", write, where)
    return KeyedStore(spark, where, key_type=types, **layout).read()
