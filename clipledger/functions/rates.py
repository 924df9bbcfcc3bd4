"""Bitrate budgets and the resolution ladder as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS, Limits
from clipledger.constants import TIERS

_EDGES = [edge for edge, _ in TIERS]


def usable_duration(d: Column) -> Column:
    return F.coalesce((d > 0.1) & (d < float("inf")), F.lit(False))


def audio_kbps(d: Column) -> Column:
    return F.when(d > 600.0, 128).when(d > 300.0, 160).otherwise(192)


def _video_bits(d: Column, audio: Column, ratio: float, cfg: Limits) -> Column:
    target = float(cfg.max_upload_bytes) * ratio * 8.0
    usable = target * (1.0 - cfg.container_overhead)
    return F.lit(usable) - audio * 1000.0 * d * cfg.audio_padding


def _kbps(bits: Column, d: Column, cfg: Limits) -> Column:
    return F.floor((bits / d / 1000.0) * (1.0 - cfg.vbr_margin))


def budget_reason(d: Column, cfg: Limits = DEFAULTS) -> Column:
    bits = _video_bits(d, audio_kbps(d), cfg.target_ratio, cfg)
    return (
        F.when(~usable_duration(d), "invalid media duration")
        .when(bits <= 0.0, "video too long to fit")
        .otherwise("ok")
    )


def budget_kbps(d: Column, cfg: Limits = DEFAULTS) -> Column:
    """Video kbps for one file, null when no budget exists."""
    bits = _video_bits(d, audio_kbps(d), cfg.target_ratio, cfg)
    return F.when(
        usable_duration(d) & (bits > 0.0), F.greatest(_kbps(bits, d, cfg), F.lit(150).cast("bigint"))
    )


def source_cap(source_kbps: Column, cfg: Limits = DEFAULTS) -> Column:
    """Highest video kbps worth spending on a split of a source; null for an unknown source."""
    ratio = min(max(cfg.split_ratio, 0.1), 1.0)
    return F.when(
        source_kbps.isNotNull(),
        F.greatest(F.floor(source_kbps * ratio) - 128, F.lit(100).cast("bigint")),
    )


def split_bits(d: Column, cfg: Limits = DEFAULTS) -> Column:
    """Video bits left for one segment of ``d`` seconds."""
    return _video_bits(d, F.lit(128), cfg.split_ratio, cfg)


def split_kbps(d: Column, bits: Column, cap: Column, cfg: Limits = DEFAULTS) -> Column:
    """Video kbps for one segment, held to the source's cap; null when it cannot fit."""
    free = F.greatest(_kbps(bits, d, cfg), F.lit(100).cast("bigint"))
    return F.when(usable_duration(d) & (bits > 0.0), F.least(free, cap))


def split_count(d: Column, kbps: Column, cfg: Limits = DEFAULTS) -> Column:
    """How many segments ``d`` seconds need for a rate of ``kbps``, but for rounding: ``split_kbps`` solved for the count."""
    bits = float(cfg.max_upload_bytes) * cfg.split_ratio * 8.0 * (1.0 - cfg.container_overhead)
    if bits <= 0.0 or cfg.vbr_margin >= 1.0:  # no count is enough, or none can be made
        return F.lit(1).cast("bigint")
    per_second = kbps / (1.0 - cfg.vbr_margin) * 1000.0 + 128 * 1000.0 * cfg.audio_padding
    return F.ceil(d * per_second / bits)


def supported_edge(kbps: Column) -> Column:
    """Highest tier the rate reaches, else the lowest tier."""
    out = F.when(F.lit(False), 0)
    for edge, least_kbps in TIERS:
        out = out.when(kbps >= least_kbps, edge)
    return out.otherwise(_EDGES[-1])


def tier_index(edge: Column) -> Column:
    """Index of the tier at or under ``edge``, else the last."""
    out = F.when(F.lit(False), 0)
    for i, tier in enumerate(_EDGES):
        out = out.when(edge >= tier, i)
    return out.otherwise(len(_EDGES) - 1)


def kept_from_kbps(source: Column, preset: str) -> Column:
    """Smallest rate at which the ladder keeps the source's edge; null when it never does."""
    if preset == "size":
        keeps = F.when(source <= _EDGES[-1], 0)
    else:
        keeps = F.when(source <= _EDGES[-1], 0)
        for edge, least_kbps in reversed(TIERS[:-1]):
            keeps = keeps.when(source <= edge, least_kbps)
    return F.when(source.isNull(), 1001).otherwise(keeps)


def with_ladder(df: DataFrame, d: Column, w: Column, h: Column, presets: Sequence[str], cfg: Limits = DEFAULTS) -> DataFrame:
    """Adds kbps and one ``edge_<preset>`` per preset: 360 without a budget, null to keep the source's edge.

    Each step is a column of its own, so later steps read it instead of repeating it.
    """
    source, best, capped = F.col("_source"), F.col("_best"), F.col("_capped")
    rungs = F.array(*(F.lit(e) for e in _EDGES))
    staged = (
        df.withColumn("_d", d)
        .withColumn("kbps", budget_kbps(F.col("_d"), cfg))
        .withColumn("_source", F.when(w.isNotNull() & h.isNotNull(), F.least(w, h)))
        .withColumn("_best", supported_edge(F.col("kbps")))
        .withColumn("_capped", F.least("_source", "_best"))
        .withColumn("_tier", tier_index(capped))
    )

    def rung(steps: int) -> Column:
        return F.element_at(rungs, F.least(F.col("_tier") + steps, F.lit(len(_EDGES) - 1)) + 1)

    for preset in presets:
        wanted = {"size": rung(2), "fast": F.when(source > best, rung(1)).otherwise(capped)}.get(preset, capped)
        staged = staged.withColumn("_wanted", wanted).withColumn(
            f"edge_{preset}",
            F.when(F.col("kbps").isNull(), 360)
            .when(source.isNull(), F.when(F.col("kbps") <= 1000, best))
            .when(F.col("_wanted") < source, F.col("_wanted")),
        )
    return staged.drop("_d", "_source", "_best", "_capped", "_tier", "_wanted")


def scale_axis(w: Column, h: Column) -> Column:
    return F.when(F.coalesce(h > w, F.lit(False)), "width").otherwise("height")


def fixed3(x: Column) -> Column:
    """A non-negative number with three decimals, rounded from its exact binary value, ties to even.

    The fraction is split in two parts whose products with 1000 are exact.
    """
    whole = F.floor(x)
    high = F.floor((x - whole) * 67_108_864.0) / 67_108_864.0
    low = (x - whole) - high
    thousandths = F.floor(high * 1000.0)
    rest = (high * 1000.0 - thousandths - 0.5) + low * 1000.0
    up = (rest > 0.0) | ((rest == 0.0) & (thousandths % 2 == 1))
    total = whole * 1000 + thousandths + up.cast("bigint")
    return F.concat(F.floor(total / 1000).cast("string"), F.lit("."), F.lpad((total % 1000).cast("string"), 3, "0"))
