"""Encoding plans for a whole catalogue: pure projections, one small aggregate per rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS, Limits
from clipledger.constants import IMAGE_GRID
from clipledger.functions.rates import (
    audio_kbps, budget_kbps, budget_reason, fixed3, kept_from_kbps, scale_axis,
    source_cap, split_bits, split_count, split_kbps, usable_duration, with_ladder,
)
from clipledger.functions.shared import computed_once


def bitrate_budget(media: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """Video and audio rate that make one file of each item fit, or why none does."""
    d = F.col("duration_s")
    return media.select(
        "id",
        budget_kbps(d, cfg).alias("video_kbps"),
        F.when(usable_duration(d), audio_kbps(d)).cast("bigint").alias("audio_kbps"),
        budget_reason(d, cfg).alias("reason"),
    )


def bitrate_budget_bands(media: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """Items per reason and audio tier."""
    return (
        bitrate_budget(media, cfg)
        .groupBy("reason", "audio_kbps")
        .agg(F.count(F.lit(1)).alias("n"), F.min("video_kbps").alias("min_kbps"), F.max("video_kbps").alias("max_kbps"))
    )


def quality_targets(media: DataFrame, preset: str | None = None, cfg: Limits = DEFAULTS) -> DataFrame:
    """Target short edge per item and the axis it limits; null keeps the source's."""
    w, h, name = F.col("w"), F.col("h"), preset or cfg.preset
    edge = F.col(f"edge_{name}")
    return with_ladder(media, F.col("duration_s"), w, h, [name], cfg).select(
        "id",
        F.when(w.isNotNull() & h.isNotNull(), F.least(w, h)).cast("bigint").alias("source_edge"),
        F.when(edge.isNotNull(), scale_axis(w, h)).alias("axis"),
        edge.cast("bigint").alias("target_edge"),
    )


def quality_ladder_demand(media: DataFrame, preset: str | None = None, cfg: Limits = DEFAULTS) -> DataFrame:
    """Items per (source edge, target edge, axis)."""
    return (
        quality_targets(media, preset, cfg)
        .groupBy("source_edge", "target_edge", "axis")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _with_split(media: DataFrame, d: Column, where: Column, cfg: Limits) -> DataFrame:
    """Adds split_n, split_seconds and split_kbps of the first acceptable segment count; null when none can be made.

    A count ends the search when it cannot be made, reaches the source's own rate or keeps its edge;
    as rates never exceed the source's, that is one comparison. Rates rise with the count, so the
    rate formula is solved for the count that is enough, and likewise for the first count with segments
    too short to make; rounding moves neither by more than one, so the neighbours are
    tried as well, and the first count and the last.
    """
    n, lo, hi = F.col("split_n"), F.col("_lo"), F.col("_hi")
    seconds, cap = F.col("split_seconds"), F.col("_cap")

    def rate(length: Column) -> Column:
        return split_kbps(length, split_bits(length, cfg), cap, cfg)

    staged = (
        media.withColumn("_d", F.when(where & usable_duration(d), d))
        .withColumn("_cap", source_cap(F.col("bitrate_kbps"), cfg))
        .withColumn("_enough", F.least("_cap", kept_from_kbps(F.col("h"), cfg.preset)))
        .withColumn("_lo", F.ceil(F.col("_d") / F.least(F.col("_d"), F.lit(float(cfg.max_segment_s)))))
        .withColumn("_hi", F.greatest(F.col("_lo"), F.lit(cfg.parts_per_request).cast("bigint")))
    )
    solved = F.least(split_count(F.col("_d"), F.col("_enough"), cfg), F.ceil(F.col("_d") / 0.1))
    staged = staged.withColumn("_near", F.greatest(lo, F.least(F.coalesce(solved, lo), hi)))
    stop = F.when(F.lit(False), lo)
    for count in (lo, *(F.col("_near") + i for i in (-1, 0, 1))):
        tried = F.coalesce(rate(F.col("_d") / count), F.lit(2**53))
        stop = stop.when((count >= lo) & ((count >= hi) | (tried >= F.col("_enough"))), count)
    stop = stop.when(lo.isNotNull(), hi)
    return (
        staged.withColumn("split_n", stop)
        .withColumn("split_seconds", F.col("_d") / n)
        .withColumn("split_kbps", rate(seconds))
        .drop("_d", "_cap", "_enough", "_lo", "_hi", "_near")
    )


def split_plan(media: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """Segments, their length and rates; items that cannot be split have no row."""
    found = _with_split(media.select("id", "duration_s", "h", "bitrate_kbps"), F.col("duration_s"), F.lit(True), cfg)
    plan = F.struct(
        F.col("split_n").alias("segments"),
        F.col("split_seconds").alias("segment_s"),
        F.col("split_kbps").alias("video_kbps"),
        F.lit(128).cast("bigint").alias("audio_kbps"),
    )
    return computed_once(found, "plan", plan, "id").where("plan.video_kbps IS NOT NULL").select("id", "plan.*")


def segment_schedule(plans: DataFrame, stem: Column | None = None) -> DataFrame:
    """One row per segment of each split plan."""
    stem = F.col("id").cast("string") if stem is None else stem
    rows = plans.select("id", "segment_s", stem.alias("_stem"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("segments") - 1)).alias("seg"))
    return rows.withColumn("_start", F.col("seg") * F.col("segment_s")).select(
        "id",
        "seg",
        fixed3(F.col("_start")).alias("start_s"),
        fixed3(F.col("segment_s")).alias("dur_s"),
        F.format_string("%s_seg%03d.mp4", "_stem", "seg").alias("name"),
    )


def strategy_plan(media: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """Ordered ladder of strategies per item; an empty ladder means nothing can work."""
    d = F.coalesce("duration_s", F.lit(cfg.default_duration_s))
    oversize = F.col("size") > cfg.max_upload_bytes
    presets = list(dict.fromkeys([cfg.preset, "size"]))
    planned = with_ladder(media, d, F.col("w"), F.col("h"), presets, cfg)
    planned = _with_split(planned, d, oversize & (F.col("media_type") != "image"), cfg)
    copyable = (F.col("video_codec") == "h264") & F.col("audio_codec").isin("aac", "none")
    unknown = (F.col("video_codec") == "other") | (F.col("audio_codec") == "other")
    remux = ~F.col("container").isin("mp4", "mov") & (copyable | unknown)
    single = F.coalesce(F.col("kbps") >= cfg.min_kbps, F.lit(False))
    sharper = ~F.col("edge_size").eqNullSafe(F.col(f"edge_{cfg.preset}"))
    made = F.col("split_kbps").isNotNull()
    ladder = F.array_compact(
        F.array(
            F.when(remux, "remux"),
            F.when(single, "transcode-balanced"),
            F.when(single & sharper, "transcode-aggressive"),
            F.when(made, "split-transcode"),
        )
    )
    parallel = made & F.lit(cfg.transcode_concurrency > 1) & (F.col("split_n") >= cfg.parallel_segments)
    encoder = F.lit(cfg.backend)
    if cfg.backend == "qsv":  # low-rate splits fall back to software
        encoder = F.when(F.col("split_kbps") < cfg.min_kbps, "none").otherwise(encoder)
    return planned.select(
        "id",
        "media_type",
        "container",
        F.when(~oversize, F.array(F.lit("pass-through")))
        .when(F.col("media_type") == "image", F.array(F.lit("image-compress")))
        .otherwise(ladder)
        .alias("strategies"),
        F.coalesce(parallel, F.lit(False)).alias("parallel"),
        encoder.alias("encoder"),
    )


def strategy_demand(plans: DataFrame) -> DataFrame:
    """Items per media type, container and first strategy, with subtotals."""
    first = F.coalesce(F.get("strategies", F.lit(0)), F.lit("exhausted")).alias("first")
    return (
        plans.select("media_type", "container", first)
        .rollup("media_type", "container", "first")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("bigint").alias("level"))
    )


def image_attempt_grid(media: DataFrame, cfg: Limits = DEFAULTS) -> DataFrame:
    """Compression attempts for oversize images in order: scale outer, quality inner."""
    ratio = F.col("size").cast("double") / float(cfg.max_upload_bytes)

    def grid(scales: list[float], qualities: list[int]) -> Column:
        cells = [(s, q) for s in scales for q in qualities]
        return F.array(*(F.struct(F.lit(s).alias("scale"), F.lit(q).alias("quality")) for s, q in cells))

    steps = F.when(F.lit(False), grid([1.0], [1]))
    for bound, scales, qualities in IMAGE_GRID:
        cells = grid(scales, qualities)
        steps = steps.when(ratio < bound, cells) if bound is not None else steps.otherwise(cells)
    ext = (
        F.when(F.lower("ext").isin("png", "webp", "gif"), F.lower("ext")).otherwise("jpg")
    )
    return (
        media.where((F.col("media_type") == "image") & (F.col("size") > cfg.max_upload_bytes))
        .select("id", ext.alias("ext"), F.posexplode_outer(steps).alias("attempt", "_g"))
        .select("id", "attempt", "_g.scale", "_g.quality", "ext")
    )
