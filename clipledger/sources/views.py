"""Adapter views: the driver's tables reshaped into request logs, media and attempt logs.

Every column is integer arithmetic on the given columns, so another engine can
derive the same rows.  No view shuffles: each is one scan plus projections.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.config import MIB

HOST_ALIASES = [
    "twitter.com", "www.twitter.com", "mobile.twitter.com", "x.com", "www.x.com", "mobile.x.com",
    "fxtwitter.com", "vxtwitter.com", "fixupx.com", "twittpr.com",
]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def shape_events(raw: DataFrame) -> DataFrame:
    """Works on batch and streaming frames: TIMESTAMP event time plus the number in ``props``."""
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )


def events(spark: SparkSession, root: str) -> DataFrame:
    return shape_events(table(spark, root, "events"))


def shape_requests(ev: DataFrame) -> DataFrame:
    hosts = "array(" + ",".join(f"'{h}'" for h in HOST_ALIASES) + ")"
    tweet = "1000 + (event_id * 31) % 40"
    link = f"concat('https://', element_at({hosts}, cast(event_id % 10 + 1 as int)), '/user', user_id, '/status/', {tweet})"
    return ev.selectExpr(
        "event_id AS request_id",
        "ts",
        "CASE WHEN event_id % 31 <> 0 THEN user_id END AS author_id",
        "CASE WHEN event_id % 29 <> 0 THEN k % 20 END AS channel_id",
        f"{tweet} AS tweet_id",
        f"""CASE WHEN event_id % 37 = 0 THEN NULL
                 WHEN event_id % 41 = 0 THEN 'nothing here'
                 WHEN event_id % 43 = 0 THEN concat({link}, ' and https://x.com/user', user_id, '/status/', {tweet} + 1)
                 ELSE concat('look ', {link}, '?s=20') END AS content""",
        "ts + make_dt_interval(0, 0, 0, cast(floor(value) * 100 as decimal(18,6))) AS end_ts",
        "event_type <> 'error' AS ok",
    )


def requests(spark: SparkSession, root: str) -> DataFrame:
    return shape_requests(events(spark, root))


def jobs(spark: SparkSession, root: str) -> DataFrame:
    return shape_jobs(events(spark, root))


def shape_jobs(ev: DataFrame) -> DataFrame:
    kinds = (
        "array('duplicate','resolve_failed','download_failed','download_failed','transcode_failed',"
        "'timeout','disk_space','io','upload_failed')"
    )
    tails = (
        "array('no nvenc capable device','CUDA error','qsv init failed','MFX session','muxer error',"
        "'out of memory','hwaccel init','invalid data')"
    )
    return ev.selectExpr(
        "event_id AS job_id",
        "user_id",
        "ts AS start_ts",
        "ts + make_dt_interval(0, 0, 0, cast(floor(value) * 100 as decimal(18,6))) AS end_ts",
        "event_type <> 'error' AS ok",
        f"CASE WHEN event_type = 'error' THEN element_at({kinds}, cast(k % 9 + 1 as int)) END AS error_kind",
        """CASE WHEN event_type = 'error' AND k % 9 = 2 THEN 'ssrf_blocked'
                WHEN event_type = 'error' AND k % 9 = 3 THEN 'http_status' END AS source_kind""",
        f"""CASE WHEN event_type = 'error' AND k % 9 = 4
                 THEN element_at({tails}, cast(event_id % 8 + 1 as int)) END AS stderr_tail""",
    )


def stage_runs(spark: SparkSession, root: str) -> DataFrame:
    return shape_stage_runs(events(spark, root))


def shape_stage_runs(ev: DataFrame) -> DataFrame:
    return ev.where("event_type <> 'error'").selectExpr(
        "event_id AS run_id",
        "ts",
        """CASE event_type WHEN 'view' THEN 'resolve' WHEN 'click' THEN 'download'
                WHEN 'purchase' THEN 'optimize' ELSE 'upload' END AS stage""",
        "cast(floor(value * 100) as bigint) AS duration_ms",
    )


def shape_failures(ev: DataFrame) -> DataFrame:
    names = (
        "array('resolve_failed','download_failed','ssrf_blocked','optimize_failed','upload_failed',"
        "'progress_update_errors','legacy_error_key')"
    )
    return ev.where("event_type = 'error'").selectExpr(
        "event_id", "ts", f"element_at({names}, cast(k % 7 + 1 as int)) AS category"
    )


def failures(spark: SparkSession, root: str) -> DataFrame:
    return shape_failures(events(spark, root))


def queue_events(spark: SparkSession, root: str) -> DataFrame:
    """Enqueue, leave and stray leave rows of one system; ``seq`` orders rows of one instant."""
    j = jobs(spark, root)
    moves = F.array(
        F.struct(F.unix_micros("start_ts").alias("at_us"), F.lit(1).cast("bigint").alias("delta"),
                 (F.col("job_id") * 3).alias("seq")),
        F.struct(F.unix_micros("end_ts").alias("at_us"), F.lit(-1).cast("bigint").alias("delta"),
                 (F.col("job_id") * 3 + 1).alias("seq")),
        F.when(
            F.col("job_id") % 97 == 0,
            F.struct(F.unix_micros("start_ts").alias("at_us"), F.lit(-1).cast("bigint").alias("delta"),
                     (F.col("job_id") * 3 + 2).alias("seq")),
        ),
    )
    return j.select(F.lit("all").alias("scope"), F.explode(F.array_compact(moves)).alias("m")).select("scope", "m.*")


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """One encoder attempt per event; a source's backend is fixed."""
    backends = "array('none','nvenc','vaapi','videotoolbox','qsv','amf')"
    texts = (
        "array('No NVENC capable devices','cuda_error_no_device','VAAPI init failed','videotoolbox session error',"
        "'MFX_ERR_UNSUPPORTED qsv','AMF component failed','hwaccel initialisation','conversion failed')"
    )
    return events(spark, root).selectExpr(
        "event_id AS attempt_id",
        "user_id AS src",
        "event_id AS seq",
        "event_type <> 'error' AS ok",
        f"element_at({backends}, cast(user_id % 6 + 1 as int)) AS backend",
        f"CASE WHEN event_type = 'error' THEN element_at({texts}, cast(k % 8 + 1 as int)) END AS stderr",
        "cast(floor(value * 100) as bigint) AS duration_ms",
    )


def http_attempts(spark: SparkSession, root: str) -> DataFrame:
    outcomes = "array('200','429','500','503','400','timeout','cancelled')"
    return events(spark, root).selectExpr(
        "event_id div 5 AS req",
        "event_id % 5 AS attempt",
        f"element_at({outcomes}, cast(k % 7 + 1 as int)) AS outcome",
        "CASE WHEN k % 7 = 1 AND k % 3 > 0 THEN (k % 3) * 500 END AS retry_after_ms",
    )


def lookups(spark: SparkSession, root: str) -> DataFrame:
    texts = (
        "array('account is private','protected post','post not found','no media in post','video unavailable',"
        "'post does not exist','request timed out','rate limit exceeded','HTTP 429','network unreachable',"
        "'connection reset','internal server error')"
    )
    return events(spark, root).selectExpr(
        "event_id AS request_id",
        "1000 + (event_id * 31) % 40 AS tweet_id",
        "ts",
        "k < 60 AS primary_ok",
        "CASE WHEN k >= 60 THEN 'http_status' END AS primary_kind",
        "CASE WHEN k >= 60 THEN CASE WHEN k % 2 = 0 THEN 404 ELSE 503 END END AS primary_status",
        "CASE WHEN k >= 60 THEN concat('status ', CASE WHEN k % 2 = 0 THEN 404 ELSE 503 END) END AS primary_error",
        "k >= 60 AND k < 75 AS fallback_ok",
        "CASE WHEN k >= 75 THEN 'process_failed' END AS fallback_kind",
        f"CASE WHEN k >= 75 THEN element_at({texts}, cast(k % 12 + 1 as int)) END AS fallback_error",
    )


def resolve_failures(spark: SparkSession, root: str) -> DataFrame:
    """Failed resolves of three kinds with their status or message."""
    texts = (
        "array('account is private','protected post','post not found','no media in post','video unavailable',"
        "'post does not exist','request timed out','rate limit exceeded','HTTP 429','network unreachable',"
        "'connection reset','internal server error','temporarily not found')"
    )
    parses = "array('EOF while parsing','unexpected end of input','Unterminated string','truncated body','partial body','invalid type','no media')"
    return events(spark, root).selectExpr(
        "event_id AS request_id",
        "CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'fallback' END AS resolver",
        "element_at(array('http_status','parse_failed','process_failed'), cast(k % 3 + 1 as int)) AS kind",
        "CASE WHEN k % 3 = 0 THEN element_at(array(404, 403, 429, 500), cast(event_id % 4 + 1 as int)) END AS status",
        f"""CASE WHEN k % 3 = 1 THEN element_at({parses}, cast(event_id % 7 + 1 as int))
                 WHEN k % 3 = 2 THEN element_at({texts}, cast(event_id % 13 + 1 as int)) END AS message""",
    )


def progress(spark: SparkSession, root: str) -> DataFrame:
    return shape_progress(events(spark, root))


def shape_progress(ev: DataFrame) -> DataFrame:
    stage = """CASE event_type WHEN 'view' THEN 'transcoding' WHEN 'click' THEN 'transcoding'
                    WHEN 'purchase' THEN 'uploading_segment' WHEN 'signup' THEN 'uploading' ELSE 'downloading' END"""
    counted = "event_type IN ('view','click','purchase')"
    return ev.selectExpr(
        "user_id AS job",
        "event_id AS seq",
        "ts",
        f"{stage} AS stage",
        f"CASE WHEN {counted} THEN least(k % 6, 4) END AS done",
        f"CASE WHEN {counted} THEN cast(4 as bigint) END AS total",
    )


def media(spark: SparkSession, root: str) -> DataFrame:
    """One downloaded file per order."""
    dims = """CASE o_custkey % 6 WHEN 0 THEN array(1920, 1080) WHEN 1 THEN array(1080, 1920) WHEN 2 THEN array(1280, 720)
                   WHEN 3 THEN array(640, 480) WHEN 4 THEN array(3840, 2160) END"""
    base = table(spark, root, "orders").selectExpr(
        "o_orderkey AS id",
        "cast(floor(o_totalprice * 200) as bigint) AS size",
        "CASE WHEN o_orderkey % 53 <> 0 THEN (o_orderkey % 900) * 1000 + o_custkey % 1000 END AS duration_ms",
        f"{dims} AS dims",
        "element_at(array('mp4','mov','webm','matroska','avi','mpegts','gif','unknown'), cast(o_orderkey % 8 + 1 as int)) AS container",
        "element_at(array('h264','h265','vp8','vp9','av1','other'), cast(o_custkey % 6 + 1 as int)) AS video_codec",
        "element_at(array('aac','opus','vorbis','mp3','none','other'), cast(o_orderkey % 6 + 1 as int)) AS audio_codec",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'image' ELSE 'video' END AS media_type",
        "element_at(array('png','webp','gif','jpeg','jpg','mp4'), cast(o_custkey % 6 + 1 as int)) AS ext",
    )
    return base.selectExpr(
        "id", "size", "duration_ms", "duration_ms / 1000.0D AS duration_s",
        "dims[0] AS w", "dims[1] AS h", "container", "video_codec", "audio_codec", "media_type", "ext",
        "CASE WHEN duration_ms > 0 AND id % 7 <> 0 THEN size * 8 div duration_ms END AS bitrate_kbps",
    )


# position keys need only order items of one post; they are unique, not dense
ITEM_POS = "cast(l_linenumber as bigint) * 1000000000000000 + l_partkey * 10000000 + l_suppkey"


def post_media(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").selectExpr(
        "l_orderkey AS id",
        f"{ITEM_POS} AS pos",
        """CASE WHEN l_returnflag = 'A' THEN 'image' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'video'
                WHEN l_returnflag = 'N' THEN 'gif' WHEN l_linestatus = 'O' THEN 'photo' ELSE 'audio' END AS type""",
        """concat('https://', element_at(array('video','pbs','abs'), cast(l_partkey % 3 + 1 as int)), '.twimg.com/m/', l_partkey,
            element_at(array('.mp4','.JPG?name=small','?format=png&name=large','/clip','.tar.gz','.webm#t=1','?Name=x&FORMAT=WEBP','.'),
                       cast(l_suppkey % 8 + 1 as int))) AS url""",
    )


def formats(spark: SparkSession, root: str) -> DataFrame:
    """Formats of one item each, with the item-level fields repeated on every row."""
    return table(spark, root, "lineitem").selectExpr(
        "l_orderkey AS id",
        f"{ITEM_POS} AS pos",
        "CASE WHEN l_discount > 0 THEN concat('https://video.twimg.com/f/', l_partkey, '/', l_suppkey) END AS url",
        "element_at(array('mp4','webm','mkv'), cast(l_suppkey % 3 + 1 as int)) AS ext",
        "CASE WHEN l_suppkey % 5 <> 0 THEN 320 + (l_partkey % 5) * 320 END AS w",
        "CASE WHEN l_suppkey % 7 <> 0 THEN 180 + (l_partkey % 5) * 180 END AS h",
        "CASE l_returnflag WHEN 'A' THEN 'none' WHEN 'N' THEN 'avc1.64001f' ELSE 'vp9' END AS vcodec",
        "CASE l_linestatus WHEN 'O' THEN 'mp4a.40.2' ELSE 'opus' END AS acodec",
        "CASE WHEN l_tax > 0 THEN l_quantity END AS tbr",
        "CASE WHEN l_orderkey % 23 = 0 THEN concat('https://video.twimg.com/direct/', l_orderkey) END AS item_url",
        "CASE WHEN l_orderkey % 23 = 0 THEN element_at(array('jpg','mp4','webp'), cast(l_orderkey % 3 + 1 as int)) END AS item_ext",
        "CASE WHEN l_orderkey % 3 = 0 THEN 640 END AS item_w",
        "CASE WHEN l_orderkey % 3 = 0 THEN 360 END AS item_h",
        "CASE WHEN l_orderkey % 2 = 0 THEN concat('https://pbs.twimg.com/t/', l_orderkey, element_at(array('.JPG?x=1','.png','/thumb'), cast(l_orderkey % 3 + 1 as int))) END AS thumbnail",
    )


def parts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").selectExpr(
        "l_orderkey AS job",
        f"{ITEM_POS} AS pos",
        "CASE WHEN l_partkey % 71 = 0 THEN cast(0 as bigint) ELSE cast(floor(l_extendedprice * 100) as bigint) END AS size",
        "element_at(array('mp4','webm','png'), cast(l_orderkey % 3 + 1 as int)) AS ext",
    )


def strategy_attempts(spark: SparkSession, root: str) -> DataFrame:
    """Ladder attempts per item: order in the ladder, strategy, output size or null when it failed."""
    return table(spark, root, "lineitem").selectExpr(
        "l_orderkey AS id",
        f"{ITEM_POS} AS ord",
        "element_at(array('remux','transcode-balanced','transcode-aggressive','split-transcode'), cast(l_partkey % 4 + 1 as int)) AS strategy",
        "CASE WHEN l_suppkey % 4 <> 0 THEN cast(floor(l_extendedprice * 200) as bigint) END AS size",
    )


def raw_posts(spark: SparkSession, root: str) -> DataFrame:
    """One JSON document per order: a post with 0 to 3 media; every 61st is cut off."""
    item = """named_struct(
        'url', concat('https://video.twimg.com/p/', o_orderkey, '/', i, '.mp4'),
        'type', element_at(array('video','gif','image'), cast((o_orderkey + i) % 3 + 1 as int)),
        'duration_millis', CASE WHEN (o_custkey + i) % 4 <> 0 THEN (o_custkey + i) * 250 END,
        'width', CASE WHEN i % 2 = 0 THEN 1280 END,
        'height', CASE WHEN o_orderkey % 5 <> 0 THEN 720 END)"""
    doc = f"""CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 8 = 3 THEN '{{"text":"empty"}}'
        ELSE to_json(named_struct('text', 'post', 'media_extended',
            transform(slice(array(0, 1, 2), 1, cast(o_orderkey % 4 as int)), i -> {item}))) END"""
    return table(spark, root, "orders").selectExpr("o_orderkey AS id", f"{doc} AS doc").selectExpr(
        "id", "CASE WHEN id % 61 = 0 THEN substr(doc, 1, length(doc) - 2) ELSE doc END AS json"
    )


def raw_items(spark: SparkSession, root: str) -> DataFrame:
    """One JSON document per order in the fallback resolver's shape; every 61st is cut off."""
    fmt = """named_struct(
        'url', CASE WHEN (o_custkey + i) % 5 <> 0 THEN concat('https://video.twimg.com/f/', o_orderkey, '/', i) END,
        'ext', element_at(array('mp4','webm'), cast(i % 2 + 1 as int)),
        'width', 320 + i * 320, 'height', 180 + i * 180,
        'vcodec', element_at(array('none','avc1.64001f','vp9'), cast((o_orderkey + i) % 3 + 1 as int)),
        'acodec', CASE WHEN i % 2 = 0 THEN 'mp4a.40.2' END,
        'tbr', (o_custkey % 100 + i * 50) / 4.0D)"""
    doc = f"""to_json(named_struct(
        'url', CASE WHEN o_orderkey % 23 = 0 THEN concat('https://video.twimg.com/direct/', o_orderkey) END,
        'ext', CASE WHEN o_orderkey % 23 = 0 THEN 'mp4' END,
        'thumbnail', CASE WHEN o_orderkey % 2 = 0 THEN concat('https://pbs.twimg.com/t/', o_orderkey, '.jpg') END,
        'duration', CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey / 8.0D END,
        'width', CASE WHEN o_orderkey % 3 = 0 THEN 640 END,
        'height', CASE WHEN o_orderkey % 3 = 0 THEN 360 END,
        'formats', transform(slice(array(0, 1, 2), 1, cast(o_orderkey % 4 as int)), i -> {fmt})))"""
    return table(spark, root, "orders").selectExpr("o_orderkey AS id", f"{doc} AS doc").selectExpr(
        "id", "CASE WHEN id % 61 = 0 THEN substr(doc, 1, length(doc) - 2) ELSE doc END AS json"
    )


def raw_probes(spark: SparkSession, root: str) -> DataFrame:
    """One probe document per order: numbers as strings, some not numeric; every 61st is cut off."""
    video = """named_struct('codec_type', 'video',
        'codec_name', element_at(array('h264','hevc','vp8','vp9','av1','mpeg4'), cast(o_custkey % 6 + 1 as int)),
        'width', CASE WHEN o_custkey % 11 <> 0 THEN 1280 END, 'height', 720)"""
    audio = """named_struct('codec_type', 'audio',
        'codec_name', element_at(array('aac','opus','vorbis','mp3','flac',NULL), cast(o_orderkey % 6 + 1 as int)),
        'width', cast(NULL as int), 'height', cast(NULL as int))"""
    data = "named_struct('codec_type', 'data', 'codec_name', 'bin', 'width', cast(NULL as int), 'height', cast(NULL as int))"
    doc = f"""to_json(named_struct(
        'format', named_struct(
            'format_name', element_at(array('mov,mp4,m4a,3gp,3g2,mj2','matroska,webm','avi','mpegts','gif','ogg','foo, webm'), cast(o_orderkey % 7 + 1 as int)),
            'duration', CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE cast((o_orderkey % 900) + 0.5D as string) END,
            'bit_rate', CASE WHEN o_orderkey % 17 = 0 THEN '-1' WHEN o_orderkey % 19 = 0 THEN 'N/A'
                             ELSE cast(o_custkey * 1001 + 1 as string) END),
        'streams', CASE o_orderkey % 4 WHEN 0 THEN array({data}, {video}, {audio}) WHEN 1 THEN array({audio}, {video}, {audio})
                        WHEN 2 THEN array({video}) ELSE array({data}) END))"""
    return table(spark, root, "orders").selectExpr("o_orderkey AS id", f"{doc} AS doc").selectExpr(
        "id", "CASE WHEN id % 61 = 0 THEN substr(doc, 1, length(doc) - 2) ELSE doc END AS json"
    )


def upload_runs(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).selectExpr(
        "event_id AS id",
        "CASE WHEN k % 10 = 0 THEN cast(100 as bigint) ELSE k * 3 END AS prepare_ms",
        "CASE WHEN k % 13 = 0 THEN cast(0 as bigint) WHEN k % 10 = 0 THEN cast(100 as bigint) ELSE cast(floor(value) as bigint) END AS send_ms",
        "CASE WHEN k % 10 = 0 THEN cast(100 as bigint) ELSE (99 - k) * 2 END AS parse_ms",
        "CASE WHEN k % 10 = 0 THEN cast(100 as bigint) ELSE (k * 7) % 150 END AS cleanup_ms",
        "cast(floor(value * 10000) as bigint) AS payload_bytes",
    )


def downloads(spark: SparkSession, root: str) -> DataFrame:
    size = "cast(floor(o_totalprice * 2000) as bigint)"
    return table(spark, root, "orders").selectExpr(
        "o_orderkey AS id",
        "o_orderkey % 47 = 0 AS blocked",
        "CASE WHEN o_orderkey % 31 = 0 THEN 404 WHEN o_orderkey % 37 = 0 THEN 500 WHEN o_orderkey % 41 = 0 THEN 204 ELSE 200 END AS status",
        f"CASE WHEN o_custkey % 3 = 0 THEN {size} END AS header_bytes",
        f"CASE WHEN o_custkey % 3 = 0 THEN {size} WHEN o_custkey % 7 <> 0 THEN {size} END AS declared_bytes",
        f"CASE WHEN o_orderkey % 43 = 0 THEN cast(0 as bigint) WHEN o_orderkey % 29 = 0 THEN {size} div 2 ELSE {size} END AS received_bytes",
        "(o_orderkey % 700) * 100 AS elapsed_ms",
        "o_orderkey % 53 <> 0 AS has_duration",
        "o_custkey % 11 <> 0 AS has_resolution",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'image' ELSE 'video' END AS media_type",
    )


def urls(spark: SparkSession, root: str) -> DataFrame:
    """Page URLs plus one hand-written pattern per event."""
    shapes = [
        "concat('https://video.twimg.com/v/', event_id)",
        "concat('https://cdn', user_id, '.example.com/', event_id)",
        "concat('https://printer', user_id, '.local/', event_id)",
        "concat('https://db.INTERNAL./', event_id)",
        "concat('https://localhost:8443/', event_id)",
        "concat('https://10.0.0.', user_id % 256, '/', event_id)",
        "concat('https://[2001:db8::1]/', event_id)",
        "concat('https://pbs.twimg.com:444/', event_id)",
        "concat('https://user@PBS.twimg.com:8443/', event_id)",
        "concat('http://video.twimg.com/', event_id)",
        "concat('not a url ', event_id)",
        "concat('https://sub.a.twimg.com./', event_id)",
    ]
    ev = events(spark, root).selectExpr(
        "event_id AS url_id", f"element_at(array({', '.join(shapes)}), cast(event_id % 12 + 1 as int)) AS url"
    )
    pg = table(spark, root, "pages").selectExpr("page_id + 1000000000000 AS url_id", "url")
    return ev.unionAll(pg)


def url_ips(spark: SparkSession, root: str) -> DataFrame:
    """0 to 2 resolved addresses per URL."""
    ips = (
        "array('1.1.1.1','10.1.2.3','172.31.255.255','192.168.0.1','8.8.8.8','169.254.1.1',"
        "'2001:4860:4860::8888','fd00::1','::ffff:8.8.8.8','2606:4700::1111')"
    )
    return events(spark, root).selectExpr(
        "event_id AS url_id",
        f"""CASE WHEN k % 11 = 0 THEN array(cast(NULL as string))
                 WHEN k % 3 = 0 THEN array(element_at({ips}, cast(k % 10 + 1 as int)), element_at({ips}, cast((k + event_id) % 10 + 1 as int)))
                 ELSE array(element_at({ips}, cast(k % 10 + 1 as int))) END AS found""",
    ).selectExpr("url_id", "explode(found) AS ip")


def hops(spark: SparkSession, root: str) -> DataFrame:
    """Redirect hops: request ``event_id`` follows k % 8 redirects before its final answer."""
    url = """CASE WHEN event_id % 9 = 0 AND hop = 2 THEN 'https://localhost/x'
                  WHEN event_id % 25 = 0 AND hop = 0 THEN concat('http://pbs.twimg.com/', event_id)
                  ELSE concat('https://pbs.twimg.com/', event_id, '/', hop) END"""
    return events(spark, root).selectExpr(
        "event_id", "k % 8 AS last", "explode(sequence(cast(0 as bigint), k % 8)) AS hop"
    ).selectExpr(
        "event_id AS req",
        "hop",
        f"{url} AS url",
        "CASE WHEN hop < last THEN 302 ELSE 200 END AS status",
        """CASE WHEN hop < last AND NOT (event_id % 14 = 0 AND hop = 1)
                THEN concat('https://pbs.twimg.com/', event_id, '/', hop + 1) END AS location""",
    )


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").selectExpr(
        "doc_id AS proc", "posexplode(split(text, '\\n')) AS (line_no, text)"
    )


def processed_writes(spark: SparkSession, root: str) -> DataFrame:
    """Dedup-store writes: key, epoch seconds and the batch that carried them."""
    return shape_processed_writes(events(spark, root))


def shape_processed_writes(ev: DataFrame) -> DataFrame:
    return ev.where("event_type <> 'error'").selectExpr(
        "k % 20 AS scope_id",
        "1000 + (event_id * 31) % 40 AS tweet_id",
        "unix_seconds(ts) AS ts",
        "event_id AS batch_no",
    )


def cache_entries(spark: SparkSession, root: str) -> DataFrame:
    return events(spark, root).selectExpr(
        "CASE WHEN k % 3 = 0 THEN 'dedup' WHEN k % 3 = 1 THEN 'resolver_positive' ELSE 'resolver_negative' END AS cache",
        "event_id AS entry",
        "unix_seconds(ts) AS ts",
    )


def counters(spark: SparkSession, root: str) -> DataFrame:
    """Persisted counters as (key, value) rows, unknown keys included."""
    names = (
        "array('total_runs','successes','failures','error:resolve_failed','error:download_failed',"
        "'error:ssrf_blocked','error:optimize_failed','error:legacy_error_key')"
    )
    return events(spark, root).selectExpr(
        f"element_at({names}, cast(k % 8 + 1 as int)) AS key", "event_id % 5 AS value"
    )
