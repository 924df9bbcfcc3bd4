"""The dedup and metrics stores as Parquet tables, and the job report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS
from clipledger.constants import ERROR_CATEGORIES
from clipledger.operators.chunks import numbered

KEY = ["scope_id", "tweet_id"]


def dedup_store_upsert(store: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The store after a batch of (key, ts, batch_no) writes; the last write of a key wins."""
    writes = batch.select(*KEY, "ts", "batch_no")
    if store is not None:
        writes = store.select(*KEY, "ts", F.lit(-1).cast("bigint").alias("batch_no")).unionByName(writes)
    return writes.groupBy(*KEY).agg(F.max_by("ts", F.struct("batch_no", "ts")).alias("ts"))


def write_snapshot(store: DataFrame, path: str) -> DataFrame:
    """Write a snapshot to a path of its own, so a failed write never harms the one being read."""
    store.write.mode("overwrite").parquet(path)
    return store.sparkSession.read.parquet(path)


def expired(now_s: Column | int, ttl_s: int) -> Column:
    """Whether a time lies more than ``ttl_s`` back; one in the future does not."""
    now = F.lit(now_s) if isinstance(now_s, int) else now_s
    return F.greatest(now - F.col("ts"), F.lit(0)) > ttl_s


def dedup_store_hydrate(store: DataFrame, now_s: Column | int, ttl_s: int = DEFAULTS.dedup_ttl_s) -> DataFrame:
    """Keys still live at ``now_s``; a time in the future counts as live."""
    return store.where(~expired(now_s, ttl_s)).select(*KEY)


def dedup_store_prune(
    store: DataFrame, now_s: Column | int, ttl_s: int = DEFAULTS.dedup_ttl_s, batch_size: int = DEFAULTS.prune_batch
) -> DataFrame:
    """The expired keys one run removes: at most ``batch_size``, in key order."""
    return store.where(expired(now_s, ttl_s)).orderBy(*KEY).limit(max(batch_size, 1)).select(*KEY)


def dedup_store_remainder(store: DataFrame, removed: DataFrame) -> DataFrame:
    return store.join(removed, KEY, "left_anti")


def metrics_store_load(kv: DataFrame) -> DataFrame:
    """Totals and error counts from persisted (key, value) counters, one row per known key."""
    known = ["total_runs", "successes", "failures"] + [f"error:{c}" for c in ERROR_CATEGORIES]
    got = kv.where(F.col("key").isin(known)).groupBy("key").agg(F.sum("value").alias("_v"))
    keys = kv.sparkSession.createDataFrame([(k,) for k in known], "key string")
    return keys.join(got, "key", "left").select("key", F.coalesce("_v", F.lit(0)).alias("value"))


def job_report(jobs: DataFrame, media: DataFrame, parts: DataFrame, max_bytes: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """One nested record per job.

    jobs: id, resolve_ms, download_ms, optimize_ms; media: resolved and downloaded facts
    per id; parts: job, pos, size.  Part totals are map-side combined sums; the parts
    themselves are the rows of ``job_report_parts``, so no record grows with its job.
    """
    sums = parts.groupBy("job").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_total"))
    total = F.coalesce("_total", F.lit(0))
    resolution = F.when(F.col("w").isNotNull() & F.col("h").isNotNull(), F.array("w", "h"))
    return (
        jobs.join(media, "id")
        .join(sums.withColumnRenamed("job", "id"), "id", "left")
        .select(
            "id",
            F.struct(
                F.struct("resolve_ms", "download_ms", "optimize_ms").alias("stages"),
                F.struct("media_type", F.col("ext").alias("extension")).alias("resolved"),
                F.struct(
                    F.col("size").alias("size_bytes"),
                    F.col("duration_s").alias("duration_secs"),
                    resolution.alias("resolution"),
                    F.struct("container", "video_codec", "audio_codec", "bitrate_kbps").alias("facts"),
                ).alias("downloaded"),
                F.struct(
                    F.when(F.col("_n") > 1, "split").otherwise("single").alias("kind"),
                    F.coalesce("_n", F.lit(0)).alias("n_parts"),
                    total.alias("total_size_bytes"),
                    F.lit(max_bytes).cast("bigint").alias("upload_limit_bytes"),
                    (total <= max_bytes).alias("fits_single_upload"),
                    F.when(F.col("size") > 0, total / F.col("size")).alias("size_ratio_to_download"),
                ).alias("output"),
            ).alias("report"),
        )
    )


def job_report_parts(
    parts: DataFrame, max_bytes: int = DEFAULTS.max_upload_bytes, n_chunks: int | None = None
) -> DataFrame:
    """Every part of every job: its number, size, share of the job's bytes and whether it fits an upload.

    A job may have any number of parts: they are split into chunks, which are numbered
    and summed; the input is read once.
    """
    rows = numbered(parts.select("job", "pos", "size"), ["job"], ["pos"], "part", {"_total": "size"}, n_chunks)
    return rows.select(
        "job",
        "part",
        F.col("size").alias("size_bytes"),
        F.when(F.col("_total") > 0, F.col("size") / F.col("_total")).alias("share"),
        (F.col("size") <= max_bytes).alias("fits"),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines; absent optional fields are left out."""
    reports.select(F.to_json(F.struct("id", "report.*")).alias("value")).write.mode("overwrite").text(path)
