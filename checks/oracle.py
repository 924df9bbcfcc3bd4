"""Expected results as DuckDB SQL, one statement per registered query.

Ordered decisions are recursive queries that walk each key row by row, so they
share nothing with the Spark side, which works on seconds and chunks.
"""

from __future__ import annotations

import re

from checks.views_sql import MIB, VIEWS

CAP = 8 * MIB


def _needed(body: str, done: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in done and re.search(rf"(?:FROM|JOIN|,)\s+\(?{name}\b(?!\s+AS \()", body):
            _needed(VIEWS[name], done)
            if name not in done:
                done.append(name)
    return done


def sql(body: str, *ctes: str, recursive: bool = False) -> str:
    """Prefix a body with the views it names and the given extra CTEs."""
    text = " ".join([*ctes, body])
    views = [f"{n} AS ({VIEWS[n]})" for n in _needed(text, [])]
    head = ", ".join([*views, *ctes])
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}" if head else body


def _numbered(name: str, source: str, key: str, cols: str) -> str:
    return f"{name} AS (SELECT {cols}, row_number() OVER (PARTITION BY {key} ORDER BY us, request_id) AS rn FROM {source})"


def _limit(name: str, source: str, key: str, n: int, window: int) -> str:
    """Recursive CTE: anchored window with at most n grants."""
    fresh = f"b.s - r.anchor >= {window}"
    return f"""{name} AS (
        SELECT {key}, rn, request_id, s AS anchor, 1 AS used, true AS allowed FROM {source} WHERE rn = 1
        UNION ALL
        SELECT b.{key}, b.rn, b.request_id, CASE WHEN {fresh} THEN b.s ELSE r.anchor END,
               CASE WHEN {fresh} THEN 1 WHEN r.used < {n} THEN r.used + 1 ELSE r.used END,
               {fresh} OR r.used < {n}
        FROM {name} r JOIN {source} b ON b.{key} = r.{key} AND b.rn = r.rn + 1)"""


def _inflight(name: str, source: str, key: str, ttl: int, inflight: int) -> str:
    """Recursive CTE over (running, done, jobs still to end)."""
    return f"""{name} AS (
        SELECT {key}, rn, request_id, true AS accepted, s + {inflight} AS running, CAST(NULL AS BIGINT) AS done,
               [{{'e': end_s, 'ok': ok}}] AS ends FROM {source} WHERE rn = 1
        UNION ALL
        SELECT {key}, rn, request_id, NOT blocked, CASE WHEN blocked THEN run ELSE s + {inflight} END, fin,
               CASE WHEN blocked THEN rest ELSE list_append(rest, {{'e': end_s, 'ok': ok}}) END
        FROM (SELECT *, coalesce(s < run, false) OR coalesce(s <= fin, false) AS blocked FROM (
            SELECT b.*, CASE WHEN len(list_filter(r.ends, lambda x: x.e <= b.s)) > 0 THEN NULL ELSE r.running END AS run,
                   coalesce(list_max(list_transform(list_filter(r.ends, lambda x: x.e <= b.s AND x.ok), lambda x: x.e)) + {ttl}, r.done) AS fin,
                   list_filter(r.ends, lambda x: x.e > b.s) AS rest
            FROM {name} r JOIN {source} b ON b.g = r.g AND b.rn = r.rn + 1)))"""


def _ladder(src: str, kbps: str, preset: str) -> str:
    """Scalar SQL of the resolution ladder."""
    best = f"coalesce((SELECT max(edge) FROM tiers WHERE {kbps} >= min_kbps), 240)"
    capped = f"least({src}, {best})"

    def down(edge: str, n: int) -> str:
        return f"(SELECT edge FROM tiers WHERE idx = least(coalesce((SELECT min(idx) FROM tiers t2 WHERE t2.edge <= {edge}), 6) + {n}, 6))"

    want = {
        "size": down(capped, 2),
        "fast": f"CASE WHEN {src} > {best} THEN {down(capped, 1)} ELSE {capped} END",
    }.get(preset, capped)
    return f"CASE WHEN {src} IS NULL THEN CASE WHEN {kbps} <= 1000 THEN {best} END WHEN {want} < {src} THEN {want} END"


def _edges(preset: str) -> str:
    return f"CASE WHEN kbps IS NULL THEN 360 ELSE {_ladder('short', 'kbps', preset)} END"


_SPLIT_BITS = "((8388608.0::DOUBLE * 0.8::DOUBLE) * 8.0::DOUBLE) * (1.0::DOUBLE - 0.03::DOUBLE) - 128 * 1000.0::DOUBLE * sec * 1.1::DOUBLE"


def _splits(source: str) -> list[str]:
    """CTEs giving the chosen split per id from (id, d, h, bitrate_kbps)."""
    return [
        f"""sp0 AS (SELECT *, d / n AS sec FROM (SELECT *, unnest(range(lo, greatest(lo, 10) + 1)) AS n FROM (
             SELECT id, d, h, bitrate_kbps, greatest(CAST(ceil(d / least(d, 120.0::DOUBLE)) AS BIGINT), 1) AS lo
             FROM {source} WHERE d > 0.1::DOUBLE)))""",
        f"""sp1 AS (SELECT *, {_SPLIT_BITS} AS bits,
             CASE WHEN bitrate_kbps IS NOT NULL THEN greatest(CAST(floor(bitrate_kbps * 0.8::DOUBLE) AS BIGINT) - 128, 100) END AS cap FROM sp0)""",
        """sp2 AS (SELECT *, CASE WHEN sec > 0.1::DOUBLE AND bits > 0 THEN least(greatest(CAST(floor((bits / sec / 1000.0::DOUBLE)
             * (1.0::DOUBLE - 0.05::DOUBLE)) AS BIGINT), 100), coalesce(cap, 100000000)) END AS kbps FROM sp1)""",
        f"""sp3 AS (SELECT *, kbps IS NULL AS bad, kbps IS NOT NULL AND (coalesce(kbps = cap, false)
             OR ({_ladder('h', 'kbps', 'fast')}) IS NULL) AS good FROM sp2)""",
        """splits AS (SELECT id, n AS segments, sec AS segment_s, kbps AS video_kbps FROM (
             SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN good OR bad THEN 0 ELSE 1 END,
                    CASE WHEN good OR bad THEN n ELSE -n END) AS pick FROM sp3) WHERE pick = 1 AND kbps IS NOT NULL)""",
    ]


def _int(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def build() -> dict[str, str]:
    q: dict[str, str] = {}

    # ---- sources, stores ----------------------------------------------------
    q["ingest_post_media"] = """
        SELECT id, i AS pos, 'https://video.twimg.com/p/' || id || '/' || i || '.mp4' AS url,
               ['video','gif','image'][(id + i) % 3 + 1] AS type,
               CASE WHEN (o_custkey + i) % 4 <> 0 THEN (o_custkey + i) * 250 / 1000.0::DOUBLE END AS duration_s,
               CASE WHEN i % 2 = 0 AND id % 5 <> 0 THEN CAST(1280 AS BIGINT) END AS w,
               CASE WHEN i % 2 = 0 AND id % 5 <> 0 THEN CAST(720 AS BIGINT) END AS h
        FROM (SELECT o_orderkey AS id, o_custkey, CAST(unnest(range(o_orderkey % 4)) AS INTEGER) AS i FROM orders
              WHERE o_orderkey % 61 <> 0 AND o_orderkey % 8 <> 3)"""
    q["post_media_quarantine"] = "SELECT o_orderkey AS id, 'parse_failed' AS kind FROM orders WHERE o_orderkey % 61 = 0"
    q["ingest_formats"] = """
        SELECT o_orderkey AS id, CAST(i AS INTEGER) AS pos,
               CASE WHEN (o_custkey + i) % 5 <> 0 THEN 'https://video.twimg.com/f/' || o_orderkey || '/' || i END AS url,
               CASE WHEN i IS NOT NULL THEN ['mp4','webm'][i % 2 + 1] END AS ext, 320 + i * 320 AS w, 180 + i * 180 AS h,
               CASE WHEN i IS NOT NULL THEN ['none','avc1.64001f','vp9'][(o_orderkey + i) % 3 + 1] END AS vcodec,
               CASE WHEN i % 2 = 0 THEN 'mp4a.40.2' END AS acodec,
               (o_custkey % 100 + i * 50) / 4.0::DOUBLE AS tbr,
               CASE WHEN o_orderkey % 23 = 0 THEN 'https://video.twimg.com/direct/' || o_orderkey END AS item_url,
               CASE WHEN o_orderkey % 23 = 0 THEN 'mp4' END AS item_ext,
               CASE WHEN o_orderkey % 2 = 0 THEN 'https://pbs.twimg.com/t/' || o_orderkey || '.jpg' END AS thumbnail,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey / 8.0::DOUBLE END AS duration_s,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(640 AS BIGINT) END AS item_w,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(360 AS BIGINT) END AS item_h
        FROM (SELECT *, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [NULL::BIGINT] ELSE range(o_orderkey % 4) END) AS i
              FROM orders WHERE o_orderkey % 61 <> 0)"""
    for name in ("formats_quarantine", "probe_quarantine"):
        q[name] = q["post_media_quarantine"]
    q["ingest_probe_facts"] = sql("SELECT * FROM probes")
    q["dedup_store_upsert"] = sql("SELECT scope_id, tweet_id, ts FROM dedup_store")
    q["dedup_store_hydrate"] = sql("SELECT scope_id, tweet_id FROM dedup_store, clock WHERE now - ts <= 86400")
    pruned = "SELECT scope_id, tweet_id FROM dedup_store, clock WHERE now - ts > 86400 ORDER BY 1, 2 LIMIT 500"
    q["dedup_store_prune"] = sql(pruned)
    q["dedup_store_remainder"] = sql(
        f"SELECT * FROM dedup_store WHERE (scope_id, tweet_id) NOT IN (SELECT (scope_id, tweet_id) FROM ({pruned}))"
    )
    q["metrics_store_load"] = sql("""
        SELECT key, CAST(coalesce(v, 0) AS BIGINT) AS value FROM (VALUES ('total_runs'), ('successes'), ('failures'),
          ('error:resolve_failed'), ('error:download_failed'), ('error:ssrf_blocked'), ('error:optimize_failed'),
          ('error:upload_failed'), ('error:progress_update_errors')) t(key)
        LEFT JOIN (SELECT ['total_runs','successes','failures','error:resolve_failed','error:download_failed',
          'error:ssrf_blocked','error:optimize_failed','error:legacy_error_key'][k % 8 + 1] AS key, sum(event_id % 5) AS v
          FROM ev GROUP BY 1) USING (key)""")
    q["job_report"] = sql(f"""
        SELECT id, id % 9000 AS resolve_ms, size AS size_bytes, container, ext AS extension, CASE WHEN n > 1 THEN 'split' ELSE 'single' END AS kind,
               coalesce(n, 0) AS n_parts, CAST(coalesce(t, 0) AS BIGINT) AS total_size_bytes, coalesce(t, 0) <= {CAP} AS fits_single_upload,
               round(coalesce(t, 0)::DOUBLE / size::DOUBLE, 6) AS size_ratio
        FROM media LEFT JOIN (SELECT job AS id, count(*) AS n, sum(size) AS t FROM parts GROUP BY 1) USING (id)""")
    q["job_report_lines"] = q["job_report"].replace("SELECT id, id % 9000 AS resolve_ms,", "SELECT id, id % 9000 AS resolve_ms, duration_s IS NOT NULL AS has_duration,", 1)
    q["job_report_parts"] = sql(f"""SELECT job, row_number() OVER (PARTITION BY job ORDER BY pos) AS part, size AS size_bytes,
        round(size::DOUBLE / nullif(sum(size) OVER (PARTITION BY job), 0)::DOUBLE, 6) AS share, size <= {CAP} AS fits FROM parts""")

    # ---- text and URLs --------------------------------------------------------
    q["extract_links"] = sql("""
        SELECT request_id, CAST(pos AS INTEGER) AS pos, 'user' || user_id AS "user", CAST(tweet_id AS DECIMAL(20,0)) AS tweet_id,
               'https://' || host || '/user' || user_id || '/status/' || tweet_id AS original_url,
               'https://x.com/user' || user_id || '/status/' || tweet_id AS canonical_url FROM links""")
    q["canonical_link_stats"] = sql("""
        SELECT 'https://x.com/user' || user_id || '/status/' || tweet_id AS canonical_url, count(*) AS n,
               count(DISTINCT host) AS n_hosts, min(us) AS first_us, max(us) AS last_us FROM links GROUP BY 1""")
    q["extension_profile"] = sql("""
        SELECT type AS media_type, CASE suffix WHEN 0 THEN 'mp4' WHEN 1 THEN 'jpg' WHEN 2 THEN 'png' WHEN 4 THEN 'mp4'
               WHEN 5 THEN 'webm' WHEN 6 THEN 'webp'
               ELSE CASE WHEN type = 'gif' THEN 'gif' WHEN type IN ('image', 'photo') THEN 'jpg' ELSE 'mp4' END END AS ext,
               count(*) AS n FROM post_media GROUP BY 1, 2""")
    audit = """SELECT url_id, CASE p WHEN 0 THEN 'video.twimg.com' WHEN 1 THEN 'cdn' || user_id || '.example.com'
               WHEN 2 THEN 'printer' || user_id || '.local' WHEN 3 THEN 'db.internal' WHEN 4 THEN 'localhost'
               WHEN 5 THEN '10.0.0.' || user_id % 256 WHEN 6 THEN '[2001:db8::1]' WHEN 7 THEN 'pbs.twimg.com'
               WHEN 8 THEN 'pbs.twimg.com' WHEN 9 THEN 'video.twimg.com' WHEN 11 THEN 'sub.a.twimg.com'
               WHEN -1 THEN regexp_extract(page, '^https?://([^/?#]+)', 1) END AS host,
               CASE WHEN p IN (4, 8) THEN 8443 WHEN p = 7 THEN 444 WHEN p = 10 THEN NULL WHEN p = 9 THEN 80
                    WHEN p = -1 AND starts_with(page, 'http:') THEN 80 ELSE 443 END AS port,
               CASE WHEN p IN (0, 8, 11) THEN 'ok' WHEN p IN (1, 6) THEN 'host not on allowlist'
                    WHEN p IN (2, 3, 4) THEN 'local hostname rejected' WHEN p = 5 THEN 'ip literal rejected'
                    WHEN p = 7 THEN 'port not allowed' WHEN p = 9 OR starts_with(page, 'http:') THEN 'non-https url'
                    WHEN p = 10 THEN 'parse error' ELSE 'host not on allowlist' END AS reason FROM urls"""
    q["url_policy_audit"] = sql(audit)
    q["url_policy_counts"] = sql(f"SELECT reason, count(*) AS n FROM ({audit}) GROUP BY 1")
    q["resolved_ip_audit"] = sql("""
        SELECT url_id, count(i) AS n_addrs, count(*) FILTER (WHERE i IN (1, 2, 3, 5, 7, 8)) AS n_blocked,
               CASE WHEN count(*) FILTER (WHERE i IN (1, 2, 3, 5, 7, 8)) > 0 THEN 'resolved to blocked ip'
                    WHEN count(i) = 0 THEN 'dns lookup returned no addresses' ELSE 'ok' END AS reason FROM url_ips GROUP BY 1""")
    q["redirect_chain_audit"] = sql("""
        SELECT req, hop + 1 AS n_hops, CASE WHEN v = 'ok' THEN url END AS final_url, v AS reason FROM (
          SELECT *, row_number() OVER (PARTITION BY req ORDER BY hop) AS rn FROM (
            SELECT *, CASE WHEN req % 9 = 0 AND hop = 2 THEN 'local hostname rejected'
                           WHEN req % 25 = 0 AND hop = 0 THEN 'non-https url'
                           WHEN hop = last THEN 'ok' WHEN req % 14 = 0 AND hop = 1 THEN 'redirect missing location header'
                           WHEN hop >= 5 THEN 'too many redirects' END AS v FROM hops) WHERE v IS NOT NULL) WHERE rn = 1""")
    for name, n in (("log_tail", 10), ("log_tail_success", 20)):
        q[name] = sql(f"""
        SELECT proc, string_agg(coalesce(cut, line), chr(10) ORDER BY line_no) FILTER (WHERE back <= {n}) AS tail, count(*) > {n} AS truncated,
               count(cut) FILTER (WHERE back <= {n}) AS cut_lines
        FROM (SELECT *, row_number() OVER (PARTITION BY proc ORDER BY line_no DESC) AS back FROM log_lines LEFT JOIN (
          SELECT proc, line_no, string_agg(c, '' ORDER BY i) FILTER (WHERE bytes <= 4096) ||
                 CASE WHEN max(bytes) FILTER (WHERE bytes <= 4096) < 4096 THEN chr(65533) ELSE '' END AS cut FROM (
            SELECT *, sum(strlen(c)) OVER (PARTITION BY proc, line_no ORDER BY i) AS bytes FROM (
              SELECT proc, line_no, unnest(string_split(line, '')) AS c, unnest(range(len(line))) AS i FROM log_lines WHERE strlen(line) > 4096))
          GROUP BY 1, 2) USING (proc, line_no)) GROUP BY 1""")

    # ---- outcomes ---------------------------------------------------------------
    q["resolve_failure_durability"] = sql("""
        SELECT resolver, kind, durable, count(*) AS n FROM (
          SELECT CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'fallback' END AS resolver,
                 ['http_status','parse_failed','process_failed'][k % 3 + 1] AS kind,
                 CASE k % 3 WHEN 0 THEN event_id % 4 = 0 WHEN 1 THEN event_id % 7 >= 5 ELSE event_id % 13 < 6 END AS durable
          FROM ev) GROUP BY ALL""")
    outcome = f"""SELECT id, outcome, CASE WHEN outcome = 'too_large' THEN received_or_header // {MIB} END AS size_mb,
          CASE WHEN outcome = 'too_large' THEN CAST(500 AS BIGINT) END AS max_mb FROM (
          SELECT *, CASE WHEN header_bytes > {500 * MIB} THEN header_bytes ELSE received_bytes END AS received_or_header,
          CASE WHEN elapsed_ms > 60000 THEN 'timeout' WHEN blocked THEN 'ssrf_blocked'
          WHEN status NOT BETWEEN 200 AND 299 THEN 'http_status'
          WHEN header_bytes > {500 * MIB} OR received_bytes > {500 * MIB} THEN 'too_large'
          WHEN received_bytes = 0 THEN 'empty_response' WHEN declared_bytes <> received_bytes THEN 'download incomplete'
          ELSE 'ok' END AS outcome FROM downloads)"""
    q["download_outcomes"] = sql(outcome)
    q["download_outcome_counts"] = sql(f"SELECT outcome, count(*) AS n FROM ({outcome}) GROUP BY 1")
    q["probe_requirements"] = sql("SELECT id, must_probe, should_probe, memory_only, CAST(reserve_bytes AS BIGINT) AS reserve_bytes FROM probe_flags")
    q["probe_requirement_totals"] = sql("""SELECT must_probe, should_probe, memory_only, count(*) AS n,
          CAST(sum(reserve_bytes) AS BIGINT) AS reserve_bytes FROM probe_flags GROUP BY ALL""")
    q["hw_failure_match"] = sql("SELECT attempt_id, backend, hw AS is_hw_failure FROM attempts")
    q["retry_schedule"] = sql("""
        SELECT req, CASE WHEN stop IS NULL THEN seen ELSE stop + 1 END AS n_attempts, CAST(coalesce(w, 0) AS BIGINT) AS total_delay_ms,
               coalesce(why, 'unfinished') AS final FROM (
          SELECT req, count(*) AS seen, any_value(stop) AS stop, any_value(why) AS why,
                 sum(delay) FILTER (WHERE stop IS NULL OR attempt < stop) AS w FROM (
            SELECT *, min(attempt) FILTER (WHERE fin IS NOT NULL) OVER (PARTITION BY req) AS stop,
                   arg_min(fin, attempt) FILTER (WHERE fin IS NOT NULL) OVER (PARTITION BY req) AS why FROM (
              SELECT *, CASE WHEN c = 0 THEN 'ok' WHEN c = 4 THEN 'not_retryable' WHEN attempt >= 3 THEN 'gave_up' END AS fin,
                     CASE WHEN c = 1 AND retry_after_ms IS NOT NULL THEN retry_after_ms
                          WHEN c = 1 THEN least(1000 * CAST(pow(2, attempt) AS BIGINT), 15000)
                          ELSE least(500 * CAST(pow(2, attempt) AS BIGINT), 8000) END AS delay FROM http_attempts))
          GROUP BY req)""")
    q["error_notifications"] = sql("""
        SELECT message, notify, count(*) AS n FROM (SELECT CASE error_kind WHEN 'duplicate' THEN 'this tweet was already archived recently.'
          WHEN 'resolve_failed' THEN 'could not extract media from tweet. the tweet may be protected, deleted, or contain no media.'
          WHEN 'download_failed' THEN CASE WHEN source_kind = 'ssrf_blocked' THEN 'the media URL was blocked for security reasons.'
               ELSE 'failed to download media. please try again later.' END
          WHEN 'transcode_failed' THEN 'failed to process media for upload.'
          WHEN 'timeout' THEN 'operation timed out. the media may be too large or the service is slow.'
          WHEN 'disk_space' THEN 'not enough disk space to process the media.'
          WHEN 'io' THEN 'an internal error occurred.' ELSE 'failed to upload media to Discord.' END AS message,
          error_kind <> 'duplicate' AS notify FROM jobs WHERE NOT ok) GROUP BY ALL""")

    # ---- joins --------------------------------------------------------------------
    q["resolver_fallback_chain"] = sql("""
        SELECT request_id AS req, CASE WHEN p_ok THEN 'primary' ELSE 'fallback' END AS resolver, p_ok OR f_ok AS ok,
               f_error AS error, CASE WHEN f_durable THEN f_error WHEN f_error IS NOT NULL AND p_durable THEN p_error END AS neg_cached_error
        FROM lookups""")
    q["media_facts_merge"] = sql("""
        SELECT id, size, duration_s, w, h, container, video_codec, audio_codec,
               coalesce(bk, CASE WHEN duration_s > 0.1::DOUBLE AND size > 0
                 THEN CAST(ceil(size::DOUBLE * 8.0::DOUBLE / duration_s / 1000.0::DOUBLE) AS BIGINT) END) AS bitrate_kbps, error FROM (
          SELECT d.id, d.received_bytes AS size, CASE WHEN u THEN coalesce(p.duration_s, m.duration_s) ELSE m.duration_s END AS duration_s,
                 CASE WHEN u AND p.w IS NOT NULL THEN p.w ELSE m.w END AS w, CASE WHEN u AND p.h IS NOT NULL THEN p.h ELSE m.h END AS h,
                 CASE mx WHEN 'mp4' THEN 'mp4' WHEN 'gif' THEN 'gif' ELSE CASE WHEN u THEN p.container ELSE 'unknown' END END AS container,
                 CASE WHEN u THEN p.video_codec ELSE 'other' END AS video_codec, CASE WHEN u THEN p.audio_codec ELSE 'other' END AS audio_codec,
                 CASE WHEN u THEN p.bitrate_kbps END AS bk, CASE WHEN must_probe AND p.id IS NULL THEN 'corrupt download' END AS error
          FROM (SELECT *, ['png','webp','gif','jpeg','jpg','mp4'][o_custkey % 6 + 1] AS mx FROM probe_flags) d
          JOIN media m USING (id) LEFT JOIN probes p USING (id), LATERAL (SELECT should_probe AND p.id IS NOT NULL AS u))""")
    taken = """SELECT channel_id AS c, tweet_id AS t FROM requests, clock WHERE s <= now - 43200 AND end_s > now - 43200 AND channel_id IS NOT NULL
               UNION ALL SELECT scope_id, tweet_id FROM dedup_store, clock WHERE greatest(now - 43200 - ts, 0) <= 86400"""
    for name, op in (("duplicate_requests", "IN"), ("new_requests", "NOT IN")):
        q[name] = sql(f"""SELECT request_id, channel_id, tweet_id FROM requests
            WHERE channel_id IS NOT NULL AND (channel_id, tweet_id) {op} (SELECT (c, t) FROM ({taken}))""")
    q["slow_stage_alerts"] = sql("""
        SELECT stage, count(*) FILTER (WHERE duration_ms > lim) AS n_slow, count(*) AS n, max(duration_ms) AS max_ms,
               round(count(*) FILTER (WHERE duration_ms > lim) / count(*)::DOUBLE, 6) AS share
        FROM (SELECT stage, duration_ms FROM stage_runs UNION ALL SELECT 'job', (end_us - start_us) // 1000 FROM jobs)
        JOIN (VALUES ('resolve', 8000), ('download', 20000), ('optimize', 30000), ('upload', 20000), ('job', 45000)) t(stage, lim)
        USING (stage) GROUP BY 1""")

    # ---- metrics --------------------------------------------------------------------
    q["run_totals"] = sql("""SELECT count(*) AS total_runs, count(*) FILTER (WHERE ok) AS successes,
        count(*) FILTER (WHERE NOT ok) AS failures FROM jobs WHERE error_kind IS DISTINCT FROM 'duplicate'""")
    q["stage_averages"] = sql("""SELECT stage, coalesce(CAST(sum(duration_ms) AS BIGINT) // nullif(count(duration_ms), 0), 0) AS avg_ms,
        count(duration_ms) AS samples FROM (VALUES ('resolve'), ('download'), ('optimize'), ('upload')) t(stage)
        LEFT JOIN stage_runs USING (stage) GROUP BY 1""")
    window = """SELECT s // {w} * {w} AS window_start_s, stage, CAST(sum(duration_ms) AS BIGINT) // count(*) AS avg_ms, count(*) AS samples
        FROM stage_runs GROUP BY 1, 2"""
    q["stage_window"] = sql(window.format(w=3600))
    q["stream_stage_window"] = q["stage_window"]
    q["error_category_counts"] = sql("""SELECT category, count(event_id) AS n FROM (VALUES ('resolve_failed'), ('download_failed'),
        ('ssrf_blocked'), ('optimize_failed'), ('upload_failed'), ('progress_update_errors')) t(category)
        LEFT JOIN failures USING (category) GROUP BY 1""")
    q["job_diagnostics"] = sql("""SELECT count(*) AS completed, count(*) FILTER (WHERE NOT ok) AS failed,
        count(*) FILTER (WHERE error_kind = 'timeout') AS timeouts, count(*) FILTER (WHERE hw) AS hardware_failures FROM jobs""")
    q["job_diagnostics_by_kind"] = sql("""SELECT error_kind, source_kind, count(*) AS n,
        grouping(error_kind, source_kind) AS level FROM jobs WHERE NOT ok GROUP BY ROLLUP (error_kind, source_kind)""")
    enc = """SELECT count(*) FILTER (WHERE backend <> 'none') AS hw_count, count(*) FILTER (WHERE backend = 'none') AS sw_count,
        coalesce(CAST(sum(duration_ms) FILTER (WHERE backend <> 'none') AS BIGINT) // nullif(count(*) FILTER (WHERE backend <> 'none'), 0), 0) AS hw_avg_ms,
        coalesce(CAST(sum(duration_ms) FILTER (WHERE backend = 'none') AS BIGINT) // nullif(count(*) FILTER (WHERE backend = 'none'), 0), 0) AS sw_avg_ms,
        round(count(*) FILTER (WHERE backend <> 'none') * 100.0::DOUBLE / nullif(count(*), 0), 6) AS hw_pct FROM attempts WHERE ok"""
    q["encoder_stats"] = sql(enc)
    timing = """SELECT id, a + b + c + d AS total_ms, CASE m WHEN d THEN 'post_upload_cleanup' WHEN c THEN 'response_parsing'
        WHEN b THEN 'http_send' ELSE 'attachment_preparation' END AS slow_stage, m AS slow_ms,
        CASE WHEN b > 0 THEN round(payload / (b / 1000.0::DOUBLE), 3) END AS bytes_per_s
        FROM (SELECT *, greatest(a, b, c, d) AS m FROM upload_runs)"""
    q["upload_timing"] = sql(timing)
    q["upload_timing_rollup"] = sql(f"""SELECT slow_stage, count(*) AS n, CAST(sum(slow_ms) AS BIGINT) AS slow_ms,
        CAST(sum(total_ms) AS BIGINT) AS total_ms FROM ({timing}) GROUP BY 1""")
    alive = """SELECT cache, count(i) AS n FROM (VALUES ('dedup', 0, 86400), ('resolver_positive', 1, 299), ('resolver_negative', 2, 59)) t(cache, m, keep)
        LEFT JOIN (SELECT k % 3 AS m, now - s AS age, event_id AS i FROM ev, clock) e ON e.m = t.m AND e.age <= t.keep GROUP BY 1"""
    q["live_cache_counts"] = sql(alive)
    depth = """SELECT at_us, seq, S - least(0, min(S) OVER (ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING)) AS depth FROM (
        SELECT *, sum(delta) OVER (ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS S FROM queue_events)"""
    timeline = f"""SELECT at_us, seq, CAST(depth AS BIGINT) AS depth, CAST(max(depth) OVER (ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS peak,
        depth >= 30 AS warn FROM ({depth})"""
    q["queue_depth_timeline"] = sql(timeline)
    q["queue_peak"] = sql(f"SELECT max(depth) AS peak, count(*) FILTER (WHERE warn) AS n_warn, arg_max(depth, (at_us, seq)) AS depth_now FROM ({timeline})")
    q["status_summary"] = sql(f"""SELECT t.*, e.*, c.*, p.*, w.pending_writes FROM ({q['run_totals'][q['run_totals'].index('SELECT count(*) AS total_runs'):]}) t, ({enc}) e,
        (SELECT CAST(sum(n) FILTER (WHERE cache = 'dedup') AS BIGINT) AS live_dedup, CAST(sum(n) FILTER (WHERE cache = 'resolver_positive') AS BIGINT) AS live_resolver_positive,
                CAST(sum(n) FILTER (WHERE cache = 'resolver_negative') AS BIGINT) AS live_resolver_negative FROM ({alive})) c,
        (SELECT max(depth) AS peak, count(*) FILTER (WHERE warn) AS n_warn, arg_max(depth, (at_us, seq)) AS depth_now FROM ({timeline})) p,
        (SELECT count(*) AS pending_writes FROM ev, clock WHERE event_type <> 'error' AND now - s < 60) w""")

    # ---- planning ---------------------------------------------------------------------
    reason = "CASE WHEN NOT usable THEN 'invalid media duration' WHEN bits <= 0 THEN 'video too long to fit' ELSE 'ok' END"
    budget = f"SELECT id, kbps AS video_kbps, CASE WHEN usable THEN CAST(audio AS BIGINT) END AS audio_kbps, {reason} AS reason FROM budget"
    q["bitrate_budget"] = sql(budget)
    q["bitrate_budget_bands"] = sql(f"SELECT reason, audio_kbps, count(*) AS n, min(video_kbps) AS min_kbps, max(video_kbps) AS max_kbps FROM ({budget}) GROUP BY ALL")
    short = "shortd AS (SELECT *, CASE WHEN w IS NOT NULL THEN least(w, h) END AS short FROM budget)"
    for preset in ("fast", "size", "balanced"):
        key = "quality_ladder_demand" if preset == "fast" else f"quality_ladder_demand_{preset}"
        q[key] = sql(f"""SELECT CAST(short AS BIGINT) AS source_edge, CAST(e AS BIGINT) AS target_edge,
            CASE WHEN e IS NOT NULL THEN CASE WHEN coalesce(h > w, false) THEN 'width' ELSE 'height' END END AS axis, count(*) AS n
            FROM (SELECT *, {_edges(preset)} AS e FROM shortd) GROUP BY ALL""", short)
    q["split_plan"] = sql(
        "SELECT id, segments, round(segment_s, 6) AS segment_s, video_kbps, CAST(128 AS BIGINT) AS audio_kbps FROM splits",
        *_splits("(SELECT *, duration_s AS d FROM media)"),
    )
    q["segment_schedule"] = sql(
        """SELECT id, seg, CAST(format('{:.3f}', seg * segment_s) AS DOUBLE) AS start_s, CAST(format('{:.3f}', segment_s) AS DOUBLE) AS dur_s, id || '_seg' || lpad(seg::VARCHAR, CAST(greatest(3, len(seg::VARCHAR)) AS INTEGER), '0') || '.mp4' AS name
           FROM (SELECT *, unnest(range(segments)) AS seg FROM splits)""",
        *_splits("(SELECT *, duration_s AS d FROM media)"),
    )
    filled = "filled AS (SELECT * REPLACE (coalesce(duration_s, 60.0) AS duration_s) FROM media)"
    fbudget = "fbudget AS (" + VIEWS["budget"].replace("FROM media", "FROM filled") + ")"
    plan = f"""SELECT id, media_type, container, CASE WHEN size <= {CAP} THEN 'pass-through' WHEN media_type = 'image' THEN 'image-compress'
        ELSE concat_ws(',', CASE WHEN container NOT IN ('mp4', 'mov') AND ((video_codec = 'h264' AND audio_codec IN ('aac', 'none'))
             OR video_codec = 'other' OR audio_codec = 'other') THEN 'remux' END,
          CASE WHEN kbps >= 400 THEN 'transcode-balanced' END,
          CASE WHEN kbps >= 400 AND ({_edges('size')}) IS DISTINCT FROM ({_edges('fast')}) THEN 'transcode-aggressive' END,
          CASE WHEN segments IS NOT NULL THEN 'split-transcode' END) END AS strategies,
        coalesce(media_type <> 'image' AND size > {CAP} AND segments >= 4, false) AS parallel FROM (
          SELECT f.*, sp.segments, CASE WHEN w IS NOT NULL THEN least(w, h) END AS short FROM fbudget f LEFT JOIN splits sp USING (id))"""
    plan_ctes = [filled, fbudget, *_splits("(SELECT *, duration_s AS d FROM filled)")]
    q["strategy_plan"] = sql(plan, *plan_ctes)
    encoder = "CASE WHEN rate < 400 THEN 'none' ELSE 'qsv' END AS encoder"
    q["strategy_encoder"] = sql(
        plan.replace("AS parallel FROM", f"AS parallel, {encoder} FROM").replace(
            "SELECT f.*, sp.segments,", f"SELECT f.*, sp.segments, CASE WHEN f.media_type <> 'image' AND f.size > {CAP} THEN sp.video_kbps END AS rate,"
        ).replace("SELECT id, media_type, container,", "SELECT id,"), *plan_ctes)
    q["strategy_demand"] = sql(f"""SELECT media_type, container, first, count(*) AS n, grouping(media_type, container, first) AS level FROM (
        SELECT *, CASE WHEN strategies = '' THEN 'exhausted' ELSE split_part(strategies, ',', 1) END AS first FROM ({plan}))
        GROUP BY ROLLUP (media_type, container, first)""", *plan_ctes)
    q["image_attempt_grid"] = sql(f"""
        SELECT id, CAST(a AS INTEGER) AS attempt, scale, quality, out_ext AS ext FROM media JOIN (VALUES
          (0, 0, 1.0::DOUBLE, 85), (0, 1, 1.0, 75),
          (1, 0, 1.0, 75), (1, 1, 1.0, 65), (1, 2, 1.0, 50), (1, 3, 0.85, 75), (1, 4, 0.85, 65), (1, 5, 0.85, 50),
          (2, 0, 0.85, 65), (2, 1, 0.85, 50), (2, 2, 0.85, 35), (2, 3, 0.65, 65), (2, 4, 0.65, 50), (2, 5, 0.65, 35),
          (2, 6, 0.5, 65), (2, 7, 0.5, 50), (2, 8, 0.5, 35)) g(band, a, scale, quality)
        ON band = CASE WHEN size / {CAP}.0::DOUBLE < 1.2::DOUBLE THEN 0 WHEN size / {CAP}.0::DOUBLE < 2.0 THEN 1 ELSE 2 END
        WHERE media_type = 'image' AND size > {CAP}""")

    # ---- sequences and selection ------------------------------------------------------
    q["concurrency_in_use"] = sql("""
        SELECT t.stage, CAST(coalesce(max(lvl), 0) AS BIGINT) AS peak, CAST(t.lim AS BIGINT) AS "limit",
               CAST(coalesce(sum(nxt - at_ms) FILTER (WHERE lvl >= t.lim), 0) AS BIGINT) AS ms_at_limit
        FROM (VALUES ('download', 4), ('upload', 2), ('transcode', 1), ('fallback_resolver', 1), ('pipeline', 8)) t(stage, lim)
        LEFT JOIN (SELECT stage, at_ms, sum(d) OVER (PARTITION BY stage ORDER BY at_ms) AS lvl, lead(at_ms) OVER (PARTITION BY stage ORDER BY at_ms) AS nxt
          FROM (SELECT stage, at_ms, sum(d) AS d FROM (
            SELECT stage, unnest([a, b]) AS at_ms, unnest([1, -1]) AS d FROM (
              SELECT 'pipeline' AS stage, start_us // 1000 AS a, end_us // 1000 AS b FROM jobs
              UNION ALL SELECT CASE stage WHEN 'resolve' THEN 'fallback_resolver' WHEN 'optimize' THEN 'transcode' ELSE stage END,
                     s * 1000, s * 1000 + duration_ms * 60 FROM stage_runs) WHERE b > a) GROUP BY 1, 2)) x ON x.stage = t.stage
        GROUP BY t.stage, t.lim""")
    q["clock_repair"] = sql("""
        SELECT event_id, ts, ts_fixed, ts + 60 < ts_fixed AS skewed FROM (
          SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ts_fixed FROM (
            SELECT event_id, user_id, s - CASE WHEN k % 10 = 0 THEN k * 5000 ELSE 0 END AS ts FROM ev))""")
    q["fallback_latch"] = sql("""
        SELECT attempt_id, CASE WHEN l THEN 'none' ELSE backend END AS active_backend, CASE WHEN l THEN 1 ELSE 2 END AS concurrency,
               CAST(l AS INTEGER) AS transitions FROM (
          SELECT *, coalesce(bool_or(hw) OVER (PARTITION BY src ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS l FROM attempts)""")
    q["failure_streaks"] = sql("""
        SELECT src, seq, streak, CASE WHEN streak > 0 THEN least(CAST(pow(2, least(streak - 1, 8)) AS BIGINT), 300) ELSE 0 END AS backoff_s,
               max(streak) OVER (PARTITION BY src ORDER BY seq ROWS UNBOUNDED PRECEDING) >= 5 AS disabled FROM (
          SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY src, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS streak FROM (
            SELECT *, sum(ok::INT) OVER (PARTITION BY src ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM attempts))""")
    q["best_post_media"] = sql("""
        SELECT id, url, type, coalesce(type IN ('image', 'photo'), NULL) AS is_image, CASE WHEN url IS NULL THEN 'no media' END AS error FROM (
          SELECT o_orderkey AS id, url, type, row_number() OVER (PARTITION BY o_orderkey
             ORDER BY CASE type WHEN 'video' THEN 0 WHEN 'gif' THEN 1 WHEN 'image' THEN 2 WHEN 'photo' THEN 2 ELSE 3 END, pos) AS rn
          FROM orders LEFT JOIN post_media ON id = o_orderkey) WHERE rn = 1""")
    q["best_format"] = sql("""
        SELECT id, CASE WHEN direct THEN 'https://video.twimg.com/direct/' || id WHEN url IS NOT NULL THEN url
                        WHEN id % 2 = 0 THEN 'https://pbs.twimg.com/t/' || id || ['.JPG?x=1','.png','/thumb'][id % 3 + 1] END AS url,
               CASE WHEN direct THEN ['jpg','mp4','webp'][id % 3 + 1] WHEN url IS NOT NULL THEN ext
                    WHEN id % 2 = 0 THEN ['jpg','png','jpg'][id % 3 + 1] END AS ext,
               CASE WHEN direct THEN id % 3 <> 1 WHEN url IS NOT NULL THEN false WHEN id % 2 = 0 THEN true END AS is_image,
               CASE WHEN (direct OR url IS NOT NULL) THEN CASE WHEN NOT direct AND w IS NOT NULL AND h IS NOT NULL THEN w WHEN id % 3 = 0 THEN 640 END END AS w,
               CASE WHEN (direct OR url IS NOT NULL) THEN CASE WHEN NOT direct AND w IS NOT NULL AND h IS NOT NULL THEN h WHEN id % 3 = 0 THEN 360 END END AS h,
               CASE WHEN NOT direct AND url IS NULL AND id % 2 = 1 THEN 'no formats' END AS error FROM (
          SELECT i.id, i.id % 23 = 0 AS direct, b.* EXCLUDE (id) FROM (SELECT DISTINCT id FROM formats) i LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN rf = 'N' AND ls = 'O' THEN 0 ELSE 1 END, tbr DESC, pos DESC) AS rn
            FROM formats WHERE url IS NOT NULL AND rf <> 'A') b ON b.id = i.id AND b.rn = 1)""")
    q["strategy_outcome"] = sql(f"""
        SELECT id, CASE WHEN f THEN strategy END AS winner, CASE WHEN f THEN size END AS size,
               CASE WHEN f THEN 'ok' WHEN strategy IS NULL THEN 'transcode strategy ladder exhausted'
                    WHEN size IS NULL THEN 'split failed' ELSE 'split segment exceeded upload limit' END AS reason FROM (
          SELECT i.id, e.strategy, e.size, coalesce(e.size <= {CAP}, false) AS f FROM (SELECT DISTINCT id FROM strategy_attempts) i LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM strategy_attempts
            WHERE coalesce(size <= {CAP}, false) OR strategy = 'split-transcode') e ON e.id = i.id AND e.rn = 1)""")
    q["split_fit_check"] = sql(f"""
        SELECT o_orderkey AS job, coalesce(mn > 0 AND mx <= {CAP}, false) AS ok, coalesce(n, 0) AS n,
               CASE WHEN mn = 0 THEN 'split produced an empty segment' WHEN n IS NULL THEN 'split produced no segments'
                    WHEN mx > {CAP} THEN 'split segment exceeded upload limit' ELSE 'ok' END AS reason
        FROM orders LEFT JOIN (SELECT job, count(*) AS n, min(size) AS mn, max(size) AS mx FROM parts GROUP BY 1) ON job = o_orderkey""")
    batches = f"""SELECT job, rn AS part, CASE WHEN n > 1 AND total <= {4 * CAP} THEN (rn - 1) // 10 ELSE rn - 1 END AS batch, size,
        CASE WHEN n > 1 THEN 'tweet_' || job || '_part' || rn || '.' || ext ELSE 'tweet_' || job || '.' || ext END AS name,
        CASE WHEN size > {CAP} THEN 'file too large' END AS error FROM (
        SELECT *, row_number() OVER (PARTITION BY job ORDER BY pos) AS rn, count(*) OVER (PARTITION BY job) AS n,
               sum(size) OVER (PARTITION BY job) AS total FROM parts)"""
    q["upload_batches"] = sql(batches)
    q["upload_batch_summary"] = sql(f"""SELECT job, count(*) AS parts, max(batch) + 1 AS messages, CAST(sum(size) AS BIGINT) AS bytes,
        count(error) AS too_large FROM ({batches}) GROUP BY 1""")

    # ---- folds ----------------------------------------------------------------------------
    keyed = "keyed AS (SELECT *, channel_id * 1000000 + tweet_id AS g FROM requests WHERE channel_id IS NOT NULL)"
    cols = "g, s, us, request_id, end_s, ok"
    ttl = """f AS (SELECT g, rn, request_id, s AS anchor, true AS kept FROM b0 WHERE rn = 1 UNION ALL
        SELECT b.g, b.rn, b.request_id, CASE WHEN b.s - f.anchor > 86400 THEN b.s ELSE f.anchor END, b.s - f.anchor > 86400
        FROM f JOIN b0 b ON b.g = f.g AND b.rn = f.rn + 1)"""
    q["ttl_dedup"] = sql("SELECT request_id, kept FROM f", keyed, _numbered("b0", "keyed", "g", cols), ttl, recursive=True)
    q["stream_dedup"] = sql("SELECT request_id FROM f WHERE kept", keyed, _numbered("b0", "keyed", "g", cols), ttl, recursive=True)
    q["inflight_dedup"] = sql(
        "SELECT request_id, accepted FROM f", keyed, _numbered("b0", "keyed", "g", cols),
        _inflight("f", "b0", "g", 86400, 1260), recursive=True,
    )
    for name in ("rate_limit_user", "stream_rate_limit"):
        q[name] = sql(
            "SELECT request_id, allowed FROM f", "u AS (SELECT * FROM requests WHERE author_id IS NOT NULL)",
            _numbered("b0", "u", "author_id", "author_id, s, us, request_id"), _limit("f", "b0", "author_id", 2, 86400), recursive=True,
        )
    q["rate_limit_channel"] = sql(
        "SELECT request_id, allowed FROM f", "u AS (SELECT * FROM requests WHERE channel_id IS NOT NULL)",
        _numbered("b0", "u", "channel_id", "channel_id, s, us, request_id"), _limit("f", "b0", "channel_id", 8, 86400), recursive=True,
    )
    q["sliding_rate_audit"] = sql("""
        SELECT DISTINCT channel_id, s AS ts_s, count(*) OVER (PARTITION BY channel_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n_trailing,
               count(*) OVER (PARTITION BY channel_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) > 8 AS over FROM requests WHERE channel_id IS NOT NULL""".replace(" AS over", ' AS "over"'))
    cascade = [
        "live0 AS (SELECT *, CASE WHEN channel_id IS NULL THEN 'no_channel' WHEN author_id IS NULL THEN 'no_author' END AS d0 FROM requests)",
        "l1 AS (SELECT * FROM live0 WHERE d0 IS NULL)",
        _numbered("n1", "l1", "author_id", "author_id, s, us, request_id"), _limit("f1", "n1", "author_id", 2, 86400),
        "l2 AS (SELECT l1.* FROM l1 JOIN f1 USING (request_id) WHERE allowed)",
        _numbered("n2", "l2", "channel_id", "channel_id, s, us, request_id"), _limit("f2", "n2", "channel_id", 8, 86400),
        "l3 AS (SELECT l2.*, l2.channel_id * 1000000 + tweet_id AS g FROM l2 JOIN f2 USING (request_id) WHERE allowed AND links = 1)",
        _numbered("n3", "l3", "g", "g, s, us, request_id, end_s, ok"), _inflight("f3", "n3", "g", 86400, 1260),
    ]
    decide = """SELECT request_id, CASE WHEN d0 IS NOT NULL THEN d0 WHEN NOT f1.allowed THEN 'user_limited' WHEN NOT f2.allowed THEN 'channel_limited'
        WHEN links = -1 THEN 'missing_url' WHEN links = 0 THEN 'no_link' WHEN links = 2 THEN 'many_links'
        WHEN accepted THEN 'accepted' ELSE 'duplicate' END AS decision
        FROM live0 LEFT JOIN f1 USING (request_id) LEFT JOIN f2 USING (request_id) LEFT JOIN f3 USING (request_id)"""
    q["admission_cascade"] = sql(decide, *cascade, recursive=True)
    q["admission_funnel"] = sql(f"SELECT decision, count(*) AS n FROM ({decide}) GROUP BY 1", *cascade, recursive=True)
    cache = [
        _numbered("b0", "lookups", "tweet_id", "tweet_id, s, us, request_id, CASE WHEN p_ok OR f_ok THEN 'p' WHEN p_durable OR f_durable THEN 'n' END AS st"),
        """f AS (SELECT tweet_id, rn, request_id, s, 'miss' AS label, CASE WHEN st = 'p' THEN s + 86400 END AS pu, CASE WHEN st = 'n' THEN s + 21600 END AS nu
             FROM b0 WHERE rn = 1 UNION ALL
           SELECT tweet_id, rn, request_id, s, lab, CASE WHEN lab = 'miss' AND st = 'p' THEN s + 86400 ELSE pu END,
                  CASE WHEN lab = 'miss' AND st = 'n' THEN s + 21600 ELSE nu END FROM (
             SELECT b.*, f.pu, f.nu, CASE WHEN b.s < f.nu THEN 'negative_hit' WHEN b.s < f.pu THEN 'positive_hit' ELSE 'miss' END AS lab
             FROM f JOIN b0 b ON b.tweet_id = f.tweet_id AND b.rn = f.rn + 1))""",
    ]
    q["resolver_cache_labels"] = sql("SELECT request_id, label FROM f", *cache, recursive=True)
    q["cache_hit_rates"] = sql("""SELECT s // 3600 AS hour, count(*) AS lookups, count(*) FILTER (WHERE label = 'positive_hit') AS positive_hits,
        count(*) FILTER (WHERE label = 'negative_hit') AS negative_hits FROM f GROUP BY 1""", *cache, recursive=True)
    bounce = [
        "b0 AS (SELECT *, coalesce(stage = 'transcoding' AND done < total, false) AS wait, row_number() OVER (PARTITION BY job ORDER BY us, seq) AS rn FROM progress)",
        """f AS (SELECT *, s AS last, true AS shown FROM b0 WHERE rn = 1 UNION ALL
           SELECT b.*, CASE WHEN NOT b.wait OR b.s - f.last >= 3600 THEN b.s ELSE f.last END, NOT b.wait OR b.s - f.last >= 3600
           FROM f JOIN b0 b ON b.job = f.job AND b.rn = f.rn + 1)""",
        """tails AS (SELECT job, max(rn) FILTER (WHERE shown) AS a, max(rn) FILTER (WHERE NOT shown) AS z FROM f GROUP BY 1)""",
    ]
    shown = """SELECT job, seq, stage, done, total, false AS flushed FROM f WHERE shown UNION ALL
        SELECT h.job, h.seq, h.stage, h.done, h.total, true FROM tails t JOIN f h ON h.job = t.job AND h.rn = t.z JOIN f e ON e.job = t.job AND e.rn = t.a
        WHERE t.z > t.a AND (h.stage, h.done, h.total) IS DISTINCT FROM (e.stage, e.done, e.total)"""
    q["progress_debounce"] = sql(shown, *bounce, recursive=True)
    q["stream_progress_debounce"] = q["progress_debounce"]
    # ---- streaming rollups -------------------------------------------------------------------
    q["stream_totals"] = q["run_totals"]
    q["stream_error_counts"] = q["error_category_counts"]
    q["stream_store_upsert"] = q["dedup_store_upsert"]
    return q
