import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS, MIB
from clipledger.functions.rates import fixed3
from clipledger.plans import catalogue as C

MEDIA = """id bigint, size bigint, duration_s double, w int, h int, container string, video_codec string,
           audio_codec string, media_type string, ext string, bitrate_kbps bigint"""


def item(spark, rows):
    base = dict(size=20 * MIB, duration_s=60.0, w=1280, h=720, container="mp4", video_codec="h264", audio_codec="aac",
                media_type="video", ext="mp4", bitrate_kbps=None)
    full = [{**base, **r, "id": i} for i, r in enumerate(rows)]
    names = [c.strip().split()[0] for c in MEDIA.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], MEDIA)


def test_budget(spark):
    cases = [
        (60.0, 675, 192, "ok"), (30.0, 1551, 192, "ok"), (300.0, None, 192, "video too long to fit"),
        (300.001, 150, 160, "ok"), (600.0, None, 160, "video too long to fit"), (600.001, None, 128, "video too long to fit"),
        (720.0, None, 128, "video too long to fit"), (0.0, None, None, "invalid media duration"),
        (None, None, None, "invalid media duration"), (float("inf"), None, None, "invalid media duration"),
        (float("nan"), None, None, "invalid media duration"),
    ]
    got = C.bitrate_budget(item(spark, [dict(duration_s=c[0]) for c in cases])).orderBy("id").collect()
    assert [(r.video_kbps, r.audio_kbps, r.reason) for r in got] == [c[1:] for c in cases]


def edges(spark, preset, rows):
    return [(r.axis, r.target_edge) for r in C.quality_targets(item(spark, rows), preset).orderBy("id").collect()]


def test_ladder(spark):
    # durations whose budgets are 1600 and 675 kbps
    long_enough = [d / 1000 for d in range(28_000, 31_000)]
    budgets = C.bitrate_budget(item(spark, [dict(duration_s=d) for d in long_enough])).orderBy("id").collect()
    d1600 = next(d for d, b in zip(long_enough, budgets) if b.video_kbps == 1600)
    full, sd = dict(duration_s=d1600, w=1920, h=1080), dict(duration_s=60.0, w=640, h=480)
    assert edges(spark, "balanced", [full]) == [("height", 720)]
    assert edges(spark, "size", [full]) == [("height", 360)]
    assert edges(spark, "fast", [sd]) == [(None, None)]
    assert edges(spark, "size", [sd]) == [("height", 240)]
    assert edges(spark, "fast", [dict(duration_s=53.986395, w=1080, h=1920)]) == [("width", 360)]
    assert edges(spark, "fast", [dict(duration_s=720.0, w=1080, h=1920)]) == [("width", 360)]
    assert edges(spark, "fast", [dict(w=None, h=None)]) == [("height", 480)]


def plan(spark, cfg=DEFAULTS, **row):
    got = C.split_plan(item(spark, [row]), cfg).collect()
    return [(r.segments, round(r.segment_s, 6), r.video_kbps) for r in got]


def test_split(spark):
    assert plan(spark, duration_s=167.872, h=720)[0][0::2] == (4, 1045)
    assert plan(spark, duration_s=190.566168, h=974, bitrate_kbps=570)[0][0::2] == (2, 328)
    assert plan(spark, duration_s=60.0, h=1080, bitrate_kbps=2800) == [(3, 20.0, 2112)]
    assert plan(spark, duration_s=720.0, h=1080, bitrate_kbps=1400)[0][:2] == (10, 72.0)
    assert plan(spark, duration_s=0.05) == [] and plan(spark, duration_s=None) == []
    flat = replace(DEFAULTS, max_upload_bytes=10 * MIB, container_overhead=0.0, vbr_margin=0.0, split_ratio=1.0, audio_padding=1.0)
    n, sec, kbps = plan(spark, flat, duration_s=5000.0, h=240)[0]
    assert n == 42 and sec == round(5000 / 42, 6) and kbps == int((10 * MIB * 8 - 128000 * (5000 / 42)) / (5000 / 42) / 1000)


def test_segment_names(spark):
    got = C.segment_schedule(C.split_plan(item(spark, [dict(duration_s=720.0, h=1080, bitrate_kbps=1400)])), F.lit("clip"))
    rows = sorted(got.collect(), key=lambda r: r.seg)
    assert (rows[3].start_s, rows[3].dur_s, rows[3].name) == ("216.000", "72.000", "clip_seg003.mp4") and len(rows) == 10


def test_three_decimals(spark):
    numbers = np.random.default_rng(7).uniform(0, 1e6, 5000).tolist()
    numbers += [k / 16 for k in range(200)] + [k / 1000 + 0.0005 for k in range(2000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for r in df.select("x", fixed3(F.col("x")).alias("s")).collect():
        assert r.s == f"{r.x:.3f}", r


def ladder(spark, **row):
    return C.strategy_plan(item(spark, [row])).first().strategies


def test_strategies(spark):
    three = ["transcode-balanced", "transcode-aggressive", "split-transcode"]
    assert ladder(spark) == three
    assert ladder(spark, container="webm", video_codec="vp9", audio_codec="opus") == three
    assert ladder(spark, container="unknown", video_codec="other", audio_codec="other") == ["remux", *three]
    assert ladder(spark, container="matroska") == ["remux", *three]
    assert ladder(spark, duration_s=720.0) == ["split-transcode"]
    assert ladder(spark, duration_s=None) == three
    assert ladder(spark, size=8 * MIB) == ["pass-through"]
    assert ladder(spark, media_type="image") == ["image-compress"]
    assert ladder(spark, duration_s=0.05) == []


def test_software_for_slow_qsv_splits(spark):
    cfg = replace(DEFAULTS, backend="qsv", transcode_concurrency=2)
    slow, quick = C.strategy_plan(item(spark, [dict(duration_s=1200.0), dict(duration_s=60.0)]), cfg).orderBy("id").collect()
    assert (slow.encoder, slow.parallel) == ("none", True)
    assert (quick.encoder, quick.parallel) == ("qsv", False)


@pytest.mark.parametrize("ratio,n", [(1.1, 2), (1.5, 6), (2.0, 9)])
def test_image_grid(spark, ratio, n):
    rows = C.image_attempt_grid(item(spark, [dict(media_type="image", ext="JPEG", size=int(8 * MIB * ratio))])).orderBy("attempt").collect()
    assert len(rows) == n and {r.ext for r in rows} == {"jpg"}
    assert [r.scale for r in rows] == sorted((r.scale for r in rows), reverse=True)


@pytest.mark.parametrize("cfg", [
    DEFAULTS, replace(DEFAULTS, parts_per_request=1), replace(DEFAULTS, parts_per_request=400, max_segment_s=3000),
    replace(DEFAULTS, preset="size", max_upload_bytes=2 * MIB), replace(DEFAULTS, max_upload_bytes=0),
])
def test_split_search_finds_the_first_count(spark, cfg):
    """Solving for the count and trying its neighbours gives what trying every count gives."""
    from clipledger.functions.rates import kept_from_kbps, source_cap, split_bits, split_kbps

    rnd = random.Random(9)
    rows = [dict(id=i, duration_s=d, h=rnd.choice([None, 100, 240, 480, 720, 1080, 2160]), bitrate_kbps=rnd.choice([None, 90, 300, 900, 2500, 9000]))
            for i, d in enumerate([0.05, 0.11, 0.5, 0.95, 1.0, 1.1, 120.0, 120.1, 1080.0, 1200.0, None, *(rnd.expovariate(1 / 600) for _ in range(300))])]
    df = spark.createDataFrame([(r["id"], r["duration_s"], r["h"], r["bitrate_kbps"]) for r in rows], "id int, duration_s double, h int, bitrate_kbps int")
    # every count of every item as a row
    lo = F.ceil(F.col("duration_s") / F.least("duration_s", F.lit(float(cfg.max_segment_s))))
    tried = df.where("duration_s > 0.1").withColumn("lo", lo).withColumn("hi", F.greatest(lo, F.lit(cfg.parts_per_request)))
    tried = tried.withColumn("n", F.explode(F.sequence("lo", "hi"))).withColumn("s", F.col("duration_s") / F.col("n"))
    tried = tried.withColumn("cap", source_cap(F.col("bitrate_kbps"), cfg)).withColumn("k", split_kbps(F.col("s"), split_bits(F.col("s"), cfg), F.col("cap"), cfg))
    tried = tried.withColumn("enough", F.least("cap", kept_from_kbps(F.col("h"), cfg.preset)))
    first = tried.where("n = hi OR k IS NULL AND enough IS NOT NULL OR k >= enough").groupBy("id").agg(F.min(F.struct("n", "k")).alias("first"))
    want = {(r.id, r["first"].n, r["first"].k) for r in first.collect() if r["first"].k is not None}
    got = {(r.id, r.segments, r.video_kbps) for r in C.split_plan(df, cfg).collect()}
    assert got == want


def test_split_plan_does_not_grow_with_the_limit(spark):
    df = item(spark, [dict(duration_s=720.0, h=1080, bitrate_kbps=1400)])
    sizes = {len(C.split_plan(df, replace(DEFAULTS, parts_per_request=n))._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 99)}
    assert len(sizes) == 1
