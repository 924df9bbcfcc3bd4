"""The adapter views once more, as DuckDB SQL over the same tables."""

MIB = 1024 * 1024

HOSTS = (
    "['twitter.com','www.twitter.com','mobile.twitter.com','x.com','www.x.com','mobile.x.com',"
    "'fxtwitter.com','vxtwitter.com','fixupx.com','twittpr.com']"
)
POS = "CAST(l_linenumber AS BIGINT) * 1000000000000000 + l_partkey * 10000000 + l_suppkey"

VIEWS = {
    "ev": """SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s, user_id, event_type, value,
                    CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "requests": f"""SELECT event_id AS request_id, us, s,
               CASE WHEN event_id % 31 <> 0 THEN user_id END AS author_id,
               CASE WHEN event_id % 29 <> 0 THEN k % 20 END AS channel_id,
               1000 + (event_id * 31) % 40 AS tweet_id,
               {HOSTS}[event_id % 10 + 1] AS host, user_id,
               CASE WHEN event_id % 37 = 0 THEN -1 WHEN event_id % 41 = 0 THEN 0 WHEN event_id % 43 = 0 THEN 2 ELSE 1 END AS links,
               s + CAST(floor(value) AS BIGINT) * 100 AS end_s, event_type <> 'error' AS ok FROM ev""",
    "links": """SELECT request_id, us, s, host, user_id, tweet_id, 0 AS pos FROM requests WHERE links >= 1
                UNION ALL SELECT request_id, us, s, 'x.com', user_id, tweet_id + 1, 1 FROM requests WHERE links = 2""",
    "jobs": """SELECT event_id AS job_id, user_id, us AS start_us,
               us + CAST(floor(value) AS BIGINT) * 100000000 AS end_us, event_type <> 'error' AS ok,
               CASE WHEN event_type = 'error' THEN ['duplicate','resolve_failed','download_failed','download_failed',
                 'transcode_failed','timeout','disk_space','io','upload_failed'][k % 9 + 1] END AS error_kind,
               CASE WHEN event_type = 'error' AND k % 9 = 2 THEN 'ssrf_blocked'
                    WHEN event_type = 'error' AND k % 9 = 3 THEN 'http_status' END AS source_kind,
               event_type = 'error' AND k % 9 = 4 AND event_id % 8 IN (0, 1, 2, 3, 6) AS hw FROM ev""",
    "stage_runs": """SELECT event_id AS run_id, s, CASE event_type WHEN 'view' THEN 'resolve' WHEN 'click' THEN 'download'
               WHEN 'purchase' THEN 'optimize' ELSE 'upload' END AS stage, CAST(floor(value * 100) AS BIGINT) AS duration_ms
               FROM ev WHERE event_type <> 'error'""",
    "failures": """SELECT event_id, ['resolve_failed','download_failed','ssrf_blocked','optimize_failed','upload_failed',
               'progress_update_errors','legacy_error_key'][k % 7 + 1] AS category FROM ev WHERE event_type = 'error'""",
    "queue_events": """SELECT start_us AS at_us, 1 AS delta, job_id * 3 AS seq FROM jobs
               UNION ALL SELECT end_us, -1, job_id * 3 + 1 FROM jobs
               UNION ALL SELECT start_us, -1, job_id * 3 + 2 FROM jobs WHERE job_id % 97 = 0""",
    "attempts": """SELECT event_id AS attempt_id, user_id AS src, event_id AS seq, event_type <> 'error' AS ok,
               ['none','nvenc','vaapi','videotoolbox','qsv','amf'][user_id % 6 + 1] AS backend,
               CAST(floor(value * 100) AS BIGINT) AS duration_ms,
               event_type = 'error' AND CASE k % 8 WHEN 0 THEN user_id % 6 = 1 WHEN 1 THEN user_id % 6 = 1
                 WHEN 2 THEN user_id % 6 = 2 WHEN 3 THEN user_id % 6 = 3 WHEN 4 THEN user_id % 6 = 4
                 WHEN 5 THEN user_id % 6 = 5 WHEN 6 THEN user_id % 6 > 0 ELSE false END AS hw FROM ev""",
    "http_attempts": """SELECT event_id // 5 AS req, event_id % 5 AS attempt, k % 7 AS c,
               CASE WHEN k % 7 = 1 AND k % 3 > 0 THEN (k % 3) * 500 END AS retry_after_ms FROM ev""",
    "lookups": """SELECT event_id AS request_id, 1000 + (event_id * 31) % 40 AS tweet_id, us, s, k < 60 AS p_ok,
               k >= 60 AND k < 75 AS f_ok, k >= 60 AND k % 2 = 0 AS p_durable, k >= 75 AND k % 12 < 6 AS f_durable,
               CASE WHEN k >= 60 THEN 'status ' || CASE WHEN k % 2 = 0 THEN 404 ELSE 503 END END AS p_error,
               CASE WHEN k >= 75 THEN ['account is private','protected post','post not found','no media in post',
                 'video unavailable','post does not exist','request timed out','rate limit exceeded','HTTP 429',
                 'network unreachable','connection reset','internal server error'][k % 12 + 1] END AS f_error FROM ev""",
    "progress": """SELECT user_id AS job, event_id AS seq, us, s, CASE event_type WHEN 'view' THEN 'transcoding'
               WHEN 'click' THEN 'transcoding' WHEN 'purchase' THEN 'uploading_segment' WHEN 'signup' THEN 'uploading'
               ELSE 'downloading' END AS stage,
               CASE WHEN event_type IN ('view','click','purchase') THEN least(k % 6, 4) END AS done,
               CASE WHEN event_type IN ('view','click','purchase') THEN CAST(4 AS BIGINT) END AS total FROM ev""",
    "media": """SELECT *, CAST(duration_ms AS DOUBLE) / 1000.0 AS duration_s,
               CASE WHEN duration_ms > 0 AND id % 7 <> 0 THEN size * 8 // duration_ms END AS bitrate_kbps FROM (
               SELECT o_orderkey AS id, CAST(floor(o_totalprice * 200) AS BIGINT) AS size,
               CASE WHEN o_orderkey % 53 <> 0 THEN (o_orderkey % 900) * 1000 + o_custkey % 1000 END AS duration_ms,
               [1920,1080,1280,640,3840,NULL][o_custkey % 6 + 1] AS w, [1080,1920,720,480,2160,NULL][o_custkey % 6 + 1] AS h,
               ['mp4','mov','webm','matroska','avi','mpegts','gif','unknown'][o_orderkey % 8 + 1] AS container,
               ['h264','h265','vp8','vp9','av1','other'][o_custkey % 6 + 1] AS video_codec,
               ['aac','opus','vorbis','mp3','none','other'][o_orderkey % 6 + 1] AS audio_codec,
               CASE WHEN o_orderpriority = '5-LOW' THEN 'image' ELSE 'video' END AS media_type,
               ['png','webp','gif','jpeg','jpg','mp4'][o_custkey % 6 + 1] AS ext,
               ['png','webp','gif','jpg','jpg','jpg'][o_custkey % 6 + 1] AS out_ext FROM orders)""",
    "post_media": f"""SELECT l_orderkey AS id, {POS} AS pos, l_suppkey % 8 AS suffix, l_partkey,
               CASE WHEN l_returnflag = 'A' THEN 'image' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'video'
                WHEN l_returnflag = 'N' THEN 'gif' WHEN l_linestatus = 'O' THEN 'photo' ELSE 'audio' END AS type,
               'https://' || ['video','pbs','abs'][l_partkey % 3 + 1] || '.twimg.com/m/' || l_partkey ||
               ['.mp4','.JPG?name=small','?format=png&name=large','/clip','.tar.gz','.webm#t=1','?Name=x&FORMAT=WEBP','.'][l_suppkey % 8 + 1] AS url
               FROM lineitem""",
    "formats": f"""SELECT l_orderkey AS id, {POS} AS pos,
               CASE WHEN l_discount > 0 THEN 'https://video.twimg.com/f/' || l_partkey || '/' || l_suppkey END AS url,
               ['mp4','webm','mkv'][l_suppkey % 3 + 1] AS ext,
               CASE WHEN l_suppkey % 5 <> 0 THEN 320 + (l_partkey % 5) * 320 END AS w,
               CASE WHEN l_suppkey % 7 <> 0 THEN 180 + (l_partkey % 5) * 180 END AS h,
               l_returnflag AS rf, l_linestatus AS ls, CASE WHEN l_tax > 0 THEN l_quantity ELSE 0 END AS tbr FROM lineitem""",
    "parts": f"""SELECT l_orderkey AS job, {POS} AS pos, CASE WHEN l_partkey % 71 = 0 THEN 0
               ELSE CAST(floor(l_extendedprice * 100) AS BIGINT) END AS size,
               ['mp4','webm','png'][l_orderkey % 3 + 1] AS ext FROM lineitem""",
    "strategy_attempts": f"""SELECT l_orderkey AS id, {POS} AS ord,
               ['remux','transcode-balanced','transcode-aggressive','split-transcode'][l_partkey % 4 + 1] AS strategy,
               CASE WHEN l_suppkey % 4 <> 0 THEN CAST(floor(l_extendedprice * 200) AS BIGINT) END AS size FROM lineitem""",
    "upload_runs": """SELECT event_id AS id, CASE WHEN k % 10 = 0 THEN 100 ELSE k * 3 END AS a,
               CASE WHEN k % 13 = 0 THEN 0 WHEN k % 10 = 0 THEN 100 ELSE CAST(floor(value) AS BIGINT) END AS b,
               CASE WHEN k % 10 = 0 THEN 100 ELSE (99 - k) * 2 END AS c,
               CASE WHEN k % 10 = 0 THEN 100 ELSE (k * 7) % 150 END AS d,
               CAST(floor(value * 10000) AS BIGINT) AS payload FROM ev""",
    "downloads": """SELECT *, CASE WHEN o_custkey % 3 = 0 THEN size END AS header_bytes,
               CASE WHEN o_custkey % 3 = 0 OR o_custkey % 7 <> 0 THEN size END AS declared_bytes,
               CASE WHEN id % 43 = 0 THEN 0 WHEN id % 29 = 0 THEN size // 2 ELSE size END AS received_bytes FROM (
               SELECT o_orderkey AS id, o_custkey, CAST(floor(o_totalprice * 2000) AS BIGINT) AS size,
               o_orderkey % 47 = 0 AS blocked,
               CASE WHEN o_orderkey % 31 = 0 THEN 404 WHEN o_orderkey % 37 = 0 THEN 500 WHEN o_orderkey % 41 = 0 THEN 204 ELSE 200 END AS status,
               (o_orderkey % 700) * 100 AS elapsed_ms, o_orderkey % 53 <> 0 AS has_duration, o_custkey % 11 <> 0 AS has_resolution,
               o_orderpriority = '5-LOW' AS image FROM orders)""",
    "probe_flags": f"""SELECT *, CASE WHEN memory_only THEN 0 WHEN coalesce(header_bytes, declared_bytes) > 0
               THEN coalesce(header_bytes, declared_bytes) ELSE {500 * MIB} END AS reserve_bytes FROM (
               SELECT *, NOT should_probe AND coalesce(declared_bytes > 0 AND declared_bytes <= {8 * MIB}, false) AS memory_only FROM (
               SELECT *, declared_bytes IS NULL AS must_probe,
               declared_bytes IS NULL OR NOT has_duration OR NOT has_resolution OR (NOT image AND declared_bytes > {8 * MIB}) AS should_probe
               FROM downloads))""",
    "probes": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 900) + CAST(0.5 AS DOUBLE) END AS duration_s,
               CASE WHEN o_orderkey % 4 <> 3 AND o_custkey % 11 <> 0 THEN CAST(1280 AS BIGINT) END AS w,
               CASE WHEN o_orderkey % 4 <> 3 AND o_custkey % 11 <> 0 THEN CAST(720 AS BIGINT) END AS h,
               ['mov','matroska','avi','mpegts','gif','unknown','webm'][o_orderkey % 7 + 1] AS container,
               CASE WHEN o_orderkey % 4 = 3 THEN 'other' ELSE ['h264','h265','vp8','vp9','av1','other'][o_custkey % 6 + 1] END AS video_codec,
               CASE WHEN o_orderkey % 4 >= 2 THEN 'none' ELSE ['aac','opus','vorbis','mp3','other','none'][o_orderkey % 6 + 1] END AS audio_codec,
               CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN NULL
                    ELSE CAST(ceil((o_custkey * 1001 + 1) / 1000.0) AS BIGINT) END AS bitrate_kbps
               FROM orders WHERE o_orderkey % 61 <> 0""",
    "urls": """SELECT event_id AS url_id, user_id, event_id % 12 AS p, NULL AS page FROM ev
               UNION ALL SELECT page_id + 1000000000000, NULL, -1, url FROM pages""",
    "url_ips": """SELECT event_id AS url_id, i FROM (SELECT event_id, unnest(CASE WHEN k % 11 = 0 THEN [NULL]
               WHEN k % 3 = 0 THEN [k % 10, (k + event_id) % 10] ELSE [k % 10] END) AS i FROM ev)""",
    "hops": """SELECT event_id AS req, hop, k % 8 AS last,
               CASE WHEN event_id % 9 = 0 AND hop = 2 THEN 'https://localhost/x'
                    WHEN event_id % 25 = 0 AND hop = 0 THEN 'http://pbs.twimg.com/' || event_id
                    ELSE 'https://pbs.twimg.com/' || event_id || '/' || hop END AS url
               FROM (SELECT event_id, k, unnest(range(k % 8 + 1)) AS hop FROM ev)""",
    "log_lines": """SELECT doc_id AS proc, unnest(range(len(string_split(text, chr(10))))) AS line_no,
               unnest(string_split(text, chr(10))) AS line FROM documents""",
    "dedup_store": """SELECT scope_id, tweet_id, arg_max(ts, event_id) AS ts FROM (
               SELECT k % 20 AS scope_id, 1000 + (event_id * 31) % 40 AS tweet_id, s AS ts, event_id FROM ev
               WHERE event_type <> 'error') GROUP BY ALL""",
    "clock": "SELECT max(s) AS now FROM ev",
    "budget": """SELECT *, CASE WHEN usable AND bits > 0 THEN greatest(CAST(floor((bits / d / 1000.0::DOUBLE) * (1.0::DOUBLE - 0.05::DOUBLE)) AS BIGINT), 150) END AS kbps FROM (
               SELECT *, ((8388608.0::DOUBLE * 0.85::DOUBLE) * 8.0::DOUBLE) * (1.0::DOUBLE - 0.03::DOUBLE)
                         - audio * 1000.0::DOUBLE * d * 1.1::DOUBLE AS bits FROM (
               SELECT *, coalesce(d > 0.1::DOUBLE, false) AS usable, CASE WHEN d > 600 THEN 128 WHEN d > 300 THEN 160 ELSE 192 END AS audio
               FROM (SELECT *, duration_s AS d FROM media)))""",
    "tiers": """SELECT * FROM (VALUES (0, 2160, 8000), (1, 1440, 4000), (2, 1080, 2000), (3, 720, 1000), (4, 480, 400),
               (5, 360, 150), (6, 240, 100)) t(idx, edge, min_kbps)""",
}
