"""JSON documents to rows. Malformed documents come back as quarantine rows, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.constants import AUDIO_CODECS, CONTAINER_BY_PROBE_NAME, VIDEO_CODECS
from clipledger.functions.shared import computed_once, real_number

_POST = """media_extended array<struct<url: string, type: string, duration_millis: bigint,
           width: bigint, height: bigint>>, _broken string"""
_ITEM = """url string, ext string, thumbnail string, duration double, width bigint, height bigint,
           formats array<struct<url: string, ext: string, width: bigint, height: bigint, vcodec: string,
           acodec: string, tbr: double>>, _broken string"""
_PROBE = """format struct<format_name: string, duration: string, bit_rate: string>,
            streams array<struct<codec_type: string, codec_name: string, width: bigint, height: bigint>>,
            _broken string"""


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    doc = F.from_json("json", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return computed_once(raw, "doc", doc, "id", "json")


def _bad() -> Column:
    return F.col("doc").isNull() | F.col("doc._broken").isNotNull()


def _quarantine(raw: DataFrame, schema: str) -> DataFrame:
    return _parsed(raw, schema).where(_bad()).select("id", F.lit("parse_failed").alias("kind"), "json")


def ingest_post_media(raw: DataFrame) -> DataFrame:
    """One row per attached media; a post without the list has none."""
    m = F.col("m")
    both = m["width"].isNotNull() & m["height"].isNotNull()
    return (
        _parsed(raw, _POST)
        .where(~_bad())
        .select("id", F.posexplode_outer("doc.media_extended").alias("pos", "m"))
        .where("pos IS NOT NULL")
        .select(
            "id", "pos", m["url"].alias("url"), m["type"].alias("type"),
            (m["duration_millis"] / 1000.0).alias("duration_s"),
            F.when(both, m["width"]).alias("w"), F.when(both, m["height"]).alias("h"),
        )
    )


def post_media_quarantine(raw: DataFrame) -> DataFrame:
    return _quarantine(raw, _POST)


def ingest_formats(raw: DataFrame) -> DataFrame:
    """One row per format with its list position; an item without formats keeps one row with null position."""
    f = F.col("f")
    return (
        _parsed(raw, _ITEM)
        .where(~_bad())
        .select("id", "doc", F.posexplode_outer("doc.formats").alias("pos", "f"))
        .select(
            "id", "pos", f["url"].alias("url"), f["ext"].alias("ext"), f["width"].alias("w"), f["height"].alias("h"),
            f["vcodec"].alias("vcodec"), f["acodec"].alias("acodec"), f["tbr"].alias("tbr"),
            F.col("doc.url").alias("item_url"), F.col("doc.ext").alias("item_ext"),
            F.col("doc.thumbnail").alias("thumbnail"), F.col("doc.duration").alias("duration_s"),
            F.col("doc.width").alias("item_w"), F.col("doc.height").alias("item_h"),
        )
    )


def formats_quarantine(raw: DataFrame) -> DataFrame:
    return _quarantine(raw, _ITEM)


def _named(value: Column, names: dict[str, str], default: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), F.lit(default))


def ingest_probe_facts(raw: DataFrame) -> DataFrame:
    """Duration, size, container, codecs and rate from probe documents; unreadable numbers are null."""
    streams = F.coalesce("doc.streams", F.array().cast("array<struct<codec_type:string,codec_name:string,width:bigint,height:bigint>>"))

    def first(kind: str) -> Column:
        return F.get(F.filter(streams, lambda s: s["codec_type"] == kind), F.lit(0))

    video, audio = F.col("_v"), F.col("_a")
    both = video["width"].isNotNull() & video["height"].isNotNull()
    known = F.array(*(F.lit(n) for n in CONTAINER_BY_PROBE_NAME))
    names = F.filter(
        F.transform(F.split("doc.format.format_name", ","), lambda n: F.trim(n)), lambda n: F.array_contains(known, n)
    )
    bps = real_number(F.col("doc.format.bit_rate"))
    kbps = F.ceil(bps / 1000.0)
    fine = (bps > 0.0) & (bps < float("inf")) & (kbps <= 4_294_967_295)
    return (
        _parsed(raw, _PROBE)
        .where(~_bad())
        .withColumn("_v", first("video"))
        .withColumn("_a", first("audio"))
        .select(
            "id",
            real_number(F.col("doc.format.duration")).alias("duration_s"),
            F.when(both, video["width"]).alias("w"),
            F.when(both, video["height"]).alias("h"),
            _named(F.get(names, F.lit(0)), CONTAINER_BY_PROBE_NAME, "unknown").alias("container"),
            _named(video["codec_name"], VIDEO_CODECS, "other").alias("video_codec"),
            F.when(audio["codec_name"].isNull(), "none")
            .otherwise(_named(audio["codec_name"], AUDIO_CODECS, "other"))
            .alias("audio_codec"),
            F.when(fine, kbps).alias("bitrate_kbps"),
        )
    )


def probe_quarantine(raw: DataFrame) -> DataFrame:
    return _quarantine(raw, _PROBE)
