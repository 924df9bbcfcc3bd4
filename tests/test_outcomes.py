import pytest
from pyspark.sql import functions as F

from clipledger.config import MIB
from clipledger.operators import joins, metrics, outcomes, policy, selection, text
from clipledger.operators.metrics import int_avg
from clipledger.sources import ingest, stores


def test_durability(spark):
    cases = [
        ("process_failed", None, "Protected post", True), ("http_status", 404, None, True), ("http_status", 500, None, False),
        ("parse_failed", None, "invalid type", True), ("parse_failed", None, "EOF while parsing", False),
        ("process_failed", None, "connection reset", False), ("process_failed", None, "video not found: timed out", False),
        ("process_failed", None, "HTTP 429", False), ("process_failed", None, "odd", False), ("parse_failed", None, "no media", True),
    ]
    df = spark.createDataFrame([(str(i), k, s, m) for i, (k, s, m, _) in enumerate(cases)],
                               "resolver string, kind string, status int, message string")
    got = {r.resolver: r.durable for r in outcomes.resolve_failure_durability(df).collect()}
    assert [got[str(i)] for i in range(len(cases))] == [c[3] for c in cases]


def test_downloads(spark):
    schema = """id int, blocked boolean, status int, header_bytes bigint, declared_bytes bigint, received_bytes bigint, elapsed_ms bigint"""
    big = 501 * MIB + 5
    rows = [(0, False, 200, None, None, 10, 1), (1, True, 200, None, 1, 1, 1), (2, False, 404, None, 1, 1, 1),
            (3, False, 200, big, big, 0, 1), (4, False, 200, None, None, big, 1), (5, False, 204, None, None, 0, 1),
            (6, False, 200, None, 9, 8, 1), (7, True, 200, None, 9, 9, 60_001)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: (r.outcome, r.size_mb, r.max_mb) for r in outcomes.download_outcomes(df).collect()}
    assert [got[i][0] for i in range(8)] == ["ok", "ssrf_blocked", "http_status", "too_large", "too_large", "empty_response",
                                             "download incomplete", "timeout"]
    assert got[3] == got[4] == ("too_large", 501, 500)
    free = {r.id: r.outcome for r in outcomes.download_outcomes(df, max_bytes=0).collect()}
    assert free[4] == "ok"


def test_retry(spark):
    rows = [("a", 0, "500"), ("a", 1, "timeout"), ("a", 2, "200"), ("b", 0, "400"), ("b", 1, "200"), ("d", 0, "503")]
    rows += [("c", i, "429") for i in range(5)]
    df = spark.createDataFrame([(*r, 700 if r[:2] == ("c", 1) else None) for r in rows],
                               "req string, attempt bigint, outcome string, retry_after_ms bigint")
    got = {r.req: (r.n_attempts, r.total_delay_ms, r.final) for r in outcomes.retry_schedule(df).collect()}
    assert got == {"a": (3, 1500, "ok"), "b": (1, 0, "not_retryable"), "c": (4, 1000 + 700 + 4000, "gave_up"), "d": (1, 500, "unfinished")}
    shaken = {r.req: r.total_delay_ms for r in outcomes.retry_schedule(df, jitter=True).collect()}
    assert 0 <= shaken["a"] - 1500 <= 2 * 249


def test_retry_waits_are_capped(spark):
    df = spark.createDataFrame([("x", i, "500", None) for i in range(12)], "req string, attempt bigint, outcome string, retry_after_ms bigint")
    assert outcomes.retry_schedule(df, 11).first().total_delay_ms == 500 * (1 + 2 + 4 + 8) + 8000 * 7


def test_notifications(spark):
    df = spark.createDataFrame([("duplicate", None), ("upload_failed", None), ("download_failed", "ssrf_blocked"),
                                ("download_failed", "http_status"), ("io", None), ("discord_api", None)], "error_kind string, source_kind string")
    got = {r.message: (r.notify, r.n) for r in outcomes.error_notifications(df).collect()}
    assert got["this tweet was already archived recently."] == (False, 1)
    assert got["the media URL was blocked for security reasons."] == (True, 1)
    assert got["an internal error occurred."] == (True, 2)


def test_best_media_and_format(spark):
    rows = [(1, 0, "photo", "p"), (1, 1, "video", "v1"), (1, 2, "video", "v2"), (2, 5, "image", "i"), (2, 6, "photo", "j"), (3, 0, "odd", "o")]
    df = spark.createDataFrame(rows, "id int, pos bigint, type string, url string")
    posts = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int")
    got = {r.id: (r.url, r.is_image, r.error) for r in selection.best_post_media(df, posts).collect()}
    assert got[1] == ("v1", False, None) and got[2] == ("i", True, None) and got[4] == (None, None, "no media")
    schema = """id int, pos bigint, url string, ext string, w int, h int, vcodec string, acodec string, tbr double,
                item_url string, item_ext string, item_w int, item_h int, thumbnail string"""
    f = [
        (1, 0, "big", "webm", 9, 9, "vp9", "opus", 9000.0, None, None, 1, 1, None), (1, 1, "fit", None, 7, 5, "avc1.4d", "mp4a.40", 10.0, None, None, 1, 1, None),
        (2, 0, "a", "mp4", None, 5, "vp9", None, None, None, None, 3, 4, None), (2, 1, "b", "mp4", None, 5, "vp9", None, None, None, None, 3, 4, None),
        (3, 0, "x", "mp4", 1, 1, "none", "mp4a", 1.0, None, None, 1, 1, "https://h/t.PNG?x=1"), (4, 0, None, "mp4", 1, 1, "h264", "aac", 1.0, None, None, 1, 1, None),
        (5, 0, "x", "mp4", 1, 1, "h264", "aac", 1.0, "direct", "webp", 6, None, None), (6, 0, None, None, None, None, None, None, None, None, None, None, None, "https://h/t"),
    ]
    got = {r.id: tuple(r)[1:] for r in selection.best_format(spark.createDataFrame(f, schema)).collect()}
    assert got[1] == ("fit", "mp4", False, 7, 5, None)
    assert got[2] == ("b", "mp4", False, 3, 4, None)
    assert got[3] == ("https://h/t.PNG?x=1", "png", True, None, None, None)
    assert got[4] == (None, None, None, None, None, "no formats")
    assert got[5] == ("direct", "webp", True, None, None, None)
    assert got[6] == ("https://h/t", "jpg", True, None, None, None)


def test_split_fit_and_ladder(spark):
    df = spark.createDataFrame([("ok", 5), ("ok", 6), ("zero", 0), ("zero", 9 * MIB), ("big", 9 * MIB)], "job string, size bigint")
    jobs = spark.createDataFrame([(j,) for j in ("ok", "zero", "big", "none")], "job string")
    got = {r.job: (r.ok, r.n, r.reason) for r in selection.split_fit_check(df, jobs=jobs).collect()}
    assert got == {"ok": (True, 2, "ok"), "zero": (False, 2, "split produced an empty segment"),
                   "big": (False, 1, "split segment exceeded upload limit"), "none": (False, 0, "split produced no segments")}
    tries = [(1, 0, "remux", None), (1, 1, "transcode-balanced", 9 * MIB), (1, 2, "transcode-aggressive", 5), (2, 0, "split-transcode", 9 * MIB),
             (2, 1, "remux", 5), (3, 0, "remux", None)]
    got = {r.id: (r.winner, r.reason) for r in selection.strategy_outcome(spark.createDataFrame(tries, "id int, ord int, strategy string, size bigint")).collect()}
    assert got == {1: ("transcode-aggressive", "ok"), 2: (None, "split segment exceeded upload limit"), 3: (None, "transcode strategy ladder exhausted")}


def test_metrics(spark):
    runs = spark.createDataFrame([("resolve", 100), ("resolve", 301), ("upload", 80)], "stage string, duration_ms bigint")
    got = {r.stage: (r.avg_ms, r.samples) for r in metrics.stage_averages(runs).collect()}
    assert got == {"resolve": (200, 2), "upload": (80, 1), "download": (0, 0), "optimize": (0, 0)}
    enc = spark.createDataFrame([("nvenc", 120), ("qsv", 180), ("none", 300)], "backend string, duration_ms bigint")
    assert tuple(metrics.encoder_stats(enc).first()) == (2, 1, 150, 300, 66.666667)
    assert metrics.encoder_stats(enc.limit(0)).first().hw_pct is None
    fails = spark.createDataFrame([("upload_failed",), ("legacy",)], "category string")
    assert {r.category: r.n for r in metrics.error_category_counts(fails).collect()}["upload_failed"] == 1
    ups = spark.createDataFrame([(1, 5, 5, 1, 5, 10), (2, 5, 0, 1, 1, 10)], "id int, prepare_ms bigint, send_ms bigint, parse_ms bigint, cleanup_ms bigint, payload_bytes bigint")
    got = {r.id: (r.slow_stage, r.bytes_per_s) for r in metrics.upload_timing(ups).collect()}
    assert got == {1: ("post_upload_cleanup", 2000.0), 2: ("attachment_preparation", None)}
    slow = spark.createDataFrame([("resolve", 8000), ("resolve", 8001)], "stage string, duration_ms bigint")
    assert tuple(joins.slow_stage_alerts(slow).first())[1:] == (1, 2, 8001, 0.5)


def test_ingest(spark):
    posts = [(1, '{"media_extended":[{"url":"u","type":"video","duration_millis":1500,"width":3},{"url":"v","type":"gif","width":1,"height":2}]}'),
             (2, "{}"), (3, '{"media_extended":[{'), (4, "")]
    raw = spark.createDataFrame(posts, "id int, json string")
    got = [tuple(r) for r in ingest.ingest_post_media(raw).orderBy("id", "pos").collect()]
    assert got == [(1, 0, "u", "video", 1.5, None, None), (1, 1, "v", "gif", None, 1, 2)]
    assert {r.id for r in ingest.post_media_quarantine(raw).collect()} == {3, 4}
    items = [(1, '{"url":"d","formats":[]}'), (2, '{"formats":[{"url":"a","tbr":1.5},{"vcodec":"none"}]}'), (3, "nope"), (4, '{"ext":"mp4"}')]
    raw = spark.createDataFrame(items, "id int, json string")
    got = [(r.id, r.pos, r.url, r.tbr, r.item_url) for r in ingest.ingest_formats(raw).orderBy("id", "pos").collect()]
    assert got == [(1, None, None, None, "d"), (2, 0, "a", 1.5, None), (2, 1, None, None, None), (4, None, None, None, None)]
    assert [r.id for r in ingest.formats_quarantine(raw).collect()] == [3]
    probe = """{"format":{"format_name":"%s","duration":"%s","bit_rate":"%s"},"streams":[%s]}"""
    video, audio = '{"codec_type":"video","codec_name":"hevc","width":4,"height":2}', '{"codec_type":"audio","codec_name":"flac"}'
    docs = [(1, probe % ("mov,mp4,m4a", "1.5", "1000001", video + "," + audio)), (2, probe % ("matroska,webm", "N/A", "-5", video)),
            (3, probe % ("ogg", "2", "inf", "")), (4, "{")]
    raw = spark.createDataFrame(docs, "id int, json string")
    got = {r.id: tuple(r)[1:] for r in ingest.ingest_probe_facts(raw).collect()}
    assert got == {1: (1.5, 4, 2, "mov", "h265", "other", 1001), 2: (None, 4, 2, "matroska", "h265", "none", None),
                   3: (2.0, None, None, "unknown", "other", "none", None)}
    assert [r.id for r in ingest.probe_quarantine(raw).collect()] == [4]


def test_store(spark, tmp_path):
    rows = "scope_id bigint, tweet_id bigint, ts bigint, batch_no bigint"
    first = stores.write_snapshot(stores.dedup_store_upsert(None, spark.createDataFrame([(1, 1, 50, 0), (1, 1, 40, 1), (1, 2, 10, 0)], rows)), str(tmp_path / "a"))
    second = stores.dedup_store_upsert(first, spark.createDataFrame([(1, 2, 5, 0), (2, 1, 99, 0)], rows))
    got = {(r.scope_id, r.tweet_id): r.ts for r in second.collect()}
    assert got == {(1, 1): 40, (1, 2): 5, (2, 1): 99}
    assert {tuple(r) for r in stores.dedup_store_hydrate(second, 60, 20).collect()} == {(1, 1), (2, 1)}  # 20 s old and in the future
    removed = stores.dedup_store_prune(second, 200, 20, 2)
    assert [tuple(r) for r in removed.collect()] == [(1, 1), (1, 2)]
    assert [r.scope_id for r in stores.dedup_store_remainder(second, removed).collect()] == [2]


def test_report_is_json_lines(spark, tmp_path):
    jobs = spark.createDataFrame([(1, 1, 2, 3)], "id bigint, resolve_ms bigint, download_ms bigint, optimize_ms bigint")
    media = spark.createDataFrame([("video", "mp4", 1, 0, None, 1, 2, "mp4", "h264", "aac", None)],
                                  "media_type string, ext string, id bigint, size bigint, duration_s double, w int, h int, container string, video_codec string, audio_codec string, bitrate_kbps bigint")
    parts = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "job bigint, pos bigint, size bigint")
    stores.write_reports(stores.job_report(jobs, media, parts), str(tmp_path / "r"))
    doc = spark.read.json(str(tmp_path / "r")).first()
    assert (doc.output.kind, doc.output.total_size_bytes, doc.downloaded.resolution) == ("split", 11, [1, 2])
    assert "size_ratio_to_download" not in doc.output.asDict() and "duration_secs" not in doc.downloaded.asDict()


@pytest.mark.parametrize("n", [1, 3, 7])
def test_report_lists_every_part(spark, n):
    rows = [(1, p, 10 + p % 7) for p in range(5000)] + [(2, 4, 0), (3, 0, 30), (3, 9, 10)]
    parts = spark.createDataFrame(rows, "job bigint, pos bigint, size bigint")
    got = sorted(stores.job_report_parts(parts, 15, n_chunks=n).collect())
    whole = sum(s for j, _, s in rows if j == 1)
    assert [tuple(r)[:3] + (r.fits,) for r in got[:5000]] == [(1, p + 1, 10 + p % 7, 10 + p % 7 <= 15) for p in range(5000)]
    assert abs(got[6].share - 16 / whole) < 1e-12
    assert [tuple(r) for r in got[5000:]] == [(2, 1, 0, None, True), (3, 1, 30, 0.75, False), (3, 2, 10, 0.25, True)]


def test_averages_are_exact(spark):
    df = spark.createDataFrame([(1705505637400516527, 6617154405817), (7, 2), (None, 0), (5, 0)], "s bigint, n bigint")
    assert [r[0] for r in df.select(int_avg(F.col("s"), F.col("n"))).collect()] == [1705505637400516527 // 6617154405817, 3, 0, 0]


def test_unmapped_errors_stay_visible(spark):
    df = spark.createDataFrame([("brand_new", None), ("brand_new", "x"), ("io", None)], "error_kind string, source_kind string")
    assert {tuple(r) for r in outcomes.error_notifications(df).collect()} >= {("unmapped", True, 2)}


def test_unreadable_addresses_fail_the_audit(spark):
    ips = ["999.1.1.1", "garbage", "8.8.8.8", "10.0.0.1", "2606:4700::1111", "::1", "1::2::3", "::ffff:8.8.8.8", "1.2.3", "fe80::1", "1:2:3:4:5:6:7:8", "", None]
    df = spark.createDataFrame(list(enumerate(ips)), "url_id int, ip string")
    got = {ips[r.url_id]: r.reason for r in policy.resolved_ip_audit(df).collect()}
    want = dict.fromkeys(["999.1.1.1", "garbage", "1::2::3", "1.2.3", ""], "unreadable ip")
    want |= dict.fromkeys(["8.8.8.8", "2606:4700::1111", "1:2:3:4:5:6:7:8"], "ok") | dict.fromkeys(["10.0.0.1", "::1", "fe80::1"], "resolved to blocked ip")
    assert {k: v for k, v in got.items() if k in want} == want and got[None] == "dns lookup returned no addresses"


def test_spellings_of_a_url(spark):
    urls = ["https:/video.twimg.com/x", "https:video.twimg.com/x", "https:\\\\video.twimg.com\\x", "ht\ttps://video.twimg.com/x", "https://", " https://video.twimg.com/x\n"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    got = [r.reason for r in policy.url_policy_audit(df).orderBy("id").collect()]
    assert got == ["ok", "ok", "ok", "ok", "parse error", "ok"]


def test_log_tail_tells_of_cut_lines(spark):
    df = spark.createDataFrame([(1, i, "x" * (5000 if i % 4 == 0 else 5)) for i in range(1, 31)], "proc int, line_no int, text string")
    for n, cut in ((10, 2), (20, 5)):
        got = text.log_tail(df, n).first()
        assert (got.truncated, got.cut_lines, len(got.tail.split("\n"))) == (True, cut, n)


@pytest.mark.parametrize("op,want", [(joins.duplicate_requests, {1, 2}), (joins.new_requests, {3})])
def test_known_keys(spark, op, want):
    reqs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "request_id int, key string")
    running, live = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (["a", "a"], ["b"]))
    assert {r.request_id for r in op(reqs, running, live, ["key"]).collect()} == want
