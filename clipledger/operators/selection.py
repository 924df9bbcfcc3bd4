"""Best-of choices as aggregates, combined before the shuffle; no group is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS
from clipledger.constants import IMAGE_EXTENSIONS, MEDIA_PRIORITY
from clipledger.functions.urls import url_suffix


def best_post_media(post_media: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Best media per post by type, earliest position on ties; posts without media get ``no media``."""
    rank = F.lit(3)
    for name, value in MEDIA_PRIORITY.items():
        rank = F.when(F.col("type") == name, value).otherwise(rank)
    best = post_media.groupBy("id").agg(
        F.min(F.struct(rank.alias("rank"), F.col("pos"), F.col("url"), F.col("type"))).alias("_b")
    )
    if posts is not None:
        best = posts.select("id").join(best, "id", "left")
    return best.select(
        "id",
        "_b.url",
        "_b.type",
        F.col("_b.type").isin("image", "photo").alias("is_image"),
        F.when(F.col("_b").isNull(), "no media").alias("error"),
    )


def best_format(formats: DataFrame) -> DataFrame:
    """Item URL if given, else the best format, else the thumbnail, else ``no formats``."""
    has_url = F.col("item_url").isNotNull()
    vcodec, acodec = F.coalesce("vcodec", F.lit("")), F.coalesce("acodec", F.lit(""))
    compatible = (vcodec.startswith("avc") | vcodec.contains("h264")) & (
        acodec.startswith("mp4a") | acodec.contains("aac")
    )
    usable = F.col("url").isNotNull() & (vcodec != "none")
    choice = F.struct(
        compatible.alias("fits"), F.coalesce("tbr", F.lit(0.0)).alias("rate"), F.col("pos"),
        F.col("url"), F.col("ext"), F.col("w"), F.col("h"),
    )
    item = ["item_url", "item_ext", "item_w", "item_h", "thumbnail"]
    got = formats.groupBy("id").agg(
        F.max(F.when(usable, choice)).alias("_f"), *(F.max(c).alias(c) for c in item)
    )
    item_ext = F.coalesce("item_ext", F.lit("mp4"))
    both = F.col("_f.w").isNotNull() & F.col("_f.h").isNotNull()
    item_both = F.col("item_w").isNotNull() & F.col("item_h").isNotNull()
    chosen = F.col("_f").isNotNull()

    def dim(side: str):
        own = F.when(item_both, F.col(f"item_{side}"))
        return F.when(has_url, own).when(chosen, F.when(both, F.col(f"_f.{side}")).otherwise(own))

    return got.select(
        "id",
        F.coalesce("item_url", "_f.url", "thumbnail").alias("url"),
        F.when(has_url, item_ext)
        .when(chosen, F.coalesce("_f.ext", F.lit("mp4")))
        .when(F.col("thumbnail").isNotNull(), F.coalesce(url_suffix(F.col("thumbnail")), F.lit("jpg")))
        .alias("ext"),
        F.when(has_url, item_ext.isin(IMAGE_EXTENSIONS))
        .when(chosen, False)
        .when(F.col("thumbnail").isNotNull(), True)
        .alias("is_image"),
        dim("w").cast("bigint").alias("w"),
        dim("h").cast("bigint").alias("h"),
        F.when(~has_url & ~chosen & F.col("thumbnail").isNull(), "no formats").alias("error"),
    )


def strategy_outcome(attempts: DataFrame, max_bytes: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """First attempt of an item that fits; a split attempt ends the ladder whether it fits or not.

    ``attempts``: id, ord, strategy, size (null when the attempt failed).
    """
    fits = F.coalesce(F.col("size").between(0, max_bytes), F.lit(False))
    split = F.col("strategy") == "split-transcode"
    end = F.min(
        F.when(fits | split, F.struct("ord", F.col("strategy"), F.col("size"), fits.alias("fits")))
    )
    e = F.col("_e")
    return (
        attempts.groupBy("id")
        .agg(end.alias("_e"))
        .select(
            "id",
            F.when(e["fits"], e["strategy"]).alias("winner"),
            F.when(e["fits"], e["size"]).alias("size"),
            F.when(e["fits"], "ok")
            .when(e.isNull(), "transcode strategy ladder exhausted")
            .when(e["size"].isNull(), "split failed")
            .otherwise("split segment exceeded upload limit")
            .alias("reason"),
        )
    )


def split_fit_check(
    segments: DataFrame, max_bytes: int = DEFAULTS.max_upload_bytes, jobs: DataFrame | None = None
) -> DataFrame:
    """Whether every segment of a split exists, is not empty and fits."""
    got = segments.groupBy("job").agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("_min"), F.max("size").alias("_max")
    )
    if jobs is not None:
        got = jobs.select("job").join(got, "job", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = (
        F.when(F.col("_min") == 0, "split produced an empty segment")
        .when(F.col("n") == 0, "split produced no segments")
        .when(F.col("_max") > max_bytes, "split segment exceeded upload limit")
        .otherwise("ok")
    )
    return got.withColumn("reason", reason).select("job", (F.col("reason") == "ok").alias("ok"), "n", "reason")
