"""Every operator wired to the adapter views: name -> (spark, folder) -> DataFrame.

Times leave as epoch numbers, so any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.config import DEFAULTS
from clipledger.constants import LOG_TAIL_SUCCESS
from clipledger.operators import folds, joins, metrics, outcomes, policy, selection, sequences, text
from clipledger.plans import catalogue
from clipledger.session import scratch_path
from clipledger.sources import ingest, keyed_store, stores, views
from clipledger.streaming import rollups, stateful
from clipledger.streaming.runner import Replay, read_events

Query = Callable[[SparkSession, str], DataFrame]

DAY = 86_400
DEBOUNCE_S = 3_600
QUEUE_WARN = 30
#: The tables' store: few keys over a month, and no prune before its end.
STORE = {"n_parts": 4, "bucket_s": 5 * DAY}


def _now(spark: SparkSession, root: str) -> int:
    """Latest event second: one number."""
    return views.events(spark, root).agg(F.max(F.unix_seconds("ts"))).first()[0]


def _links(spark, root):
    return text.extract_links(views.requests(spark, root), "request_id", "content", "ts")


def _store(spark, root):
    return stores.dedup_store_upsert(None, views.processed_writes(spark, root))


def _on_disk(spark, root):
    store = keyed_store.KeyedStore(spark, scratch_path(spark, "store"), **STORE)
    store.upsert(views.processed_writes(spark, root))
    return store


def _remainder(spark, root):
    store = _on_disk(spark, root)
    store.prune(_now(spark, root))
    return store.read()


def _in_channel(spark, root):
    return views.requests(spark, root).where("channel_id IS NOT NULL")


def _taken(spark, root):
    now = _now(spark, root) - DAY // 2
    running = _in_channel(spark, root).where((F.unix_seconds("ts") <= now) & (F.unix_seconds("end_ts") > now))
    live = stores.dedup_store_hydrate(_store(spark, root), now).withColumnRenamed("scope_id", "channel_id")
    return (
        _in_channel(spark, root).select("request_id", "channel_id", "tweet_id"),
        running, live, ["channel_id", "tweet_id"],
    )


def _reports(spark, root):
    m = views.media(spark, root)
    runs = m.selectExpr("id", "id % 9000 AS resolve_ms", "id % 17000 AS download_ms", "id % 31000 AS optimize_ms")
    return stores.job_report(runs, m, views.parts(spark, root))


def _flat_report(nested, *more):
    return nested.select(
        "id", "report.stages.resolve_ms", "report.downloaded.size_bytes", "report.downloaded.facts.container",
        "report.resolved.extension", "report.output.kind", "report.output.n_parts",
        "report.output.total_size_bytes", "report.output.fits_single_upload",
        F.round("report.output.size_ratio_to_download", 6).alias("size_ratio"), *more,
    )


def _report_lines(spark, root):
    """Reports written as JSON lines and read back; an absent field is left out of its line."""
    made, path = _reports(spark, root), scratch_path(spark, "reports")
    stores.write_reports(made, path)
    lines = spark.read.text(path)
    kinds = T.StructType([made.schema["id"], *made.schema["report"].dataType.fields])
    read = lines.select(F.from_json("value", kinds, {"mode": "FAILFAST"}).alias("r"), F.contains("value", F.lit('"duration_secs"')).alias("has_duration"))
    return _flat_report(read.select("r.id", F.struct(*(f"r.{f.name}" for f in kinds.fields[1:])).alias("report"), "has_duration"), "has_duration")


def _merge(spark, root):
    resolved = views.media(spark, root).select("id", "duration_s", "w", "h", "ext")
    flagged = outcomes.probe_flags(views.downloads(spark, root)).withColumnRenamed("received_bytes", "size")
    return joins.media_facts_merge(resolved, flagged, ingest.ingest_probe_facts(views.raw_probes(spark, root)))


def _fallback(spark, root):
    looked = views.lookups(spark, root).withColumnRenamed("request_id", "req")
    primary = looked.selectExpr("req", "primary_ok AS ok", "primary_kind AS kind", "primary_status AS status", "primary_error AS error")
    fallback = looked.where("NOT primary_ok").selectExpr(
        "req", "fallback_ok AS ok", "fallback_kind AS kind", "cast(NULL AS int) AS status", "fallback_error AS error"
    )
    return joins.resolver_fallback_chain(looked, primary, fallback)


def _alerts(spark, root):
    whole = views.jobs(spark, root).select(
        F.lit("job").alias("stage"),
        F.floor((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000).alias("duration_ms"),
    )
    return joins.slow_stage_alerts(views.stage_runs(spark, root).select("stage", "duration_ms").unionByName(whole))


def _timeline(spark, root):
    return sequences.queue_depth_timeline(views.queue_events(spark, root), warn_at=QUEUE_WARN)


def _intervals(spark, root):
    jobs = views.jobs(spark, root).select(
        F.lit("pipeline").alias("stage"),
        F.floor(F.unix_micros("start_ts") / 1000).alias("start_ms"), F.floor(F.unix_micros("end_ts") / 1000).alias("end_ms"),
    )
    start = F.unix_seconds("ts") * 1000
    runs = views.stage_runs(spark, root).select(
        F.when(F.col("stage") == "resolve", "fallback_resolver").when(F.col("stage") == "optimize", "transcode")
        .otherwise(F.col("stage")).alias("stage"),
        start.alias("start_ms"), (start + F.col("duration_ms") * 60).alias("end_ms"),
    )
    return jobs.unionByName(runs)


def _status(spark, root):
    now = _now(spark, root)
    ev = views.events(spark, root)
    pending = ev.where("event_type <> 'error'").agg(
        F.count_if(F.lit(now) - F.unix_seconds("ts") < 60).alias("pending_writes")
    )
    return metrics.status_summary(
        metrics.run_totals(views.jobs(spark, root)),
        metrics.encoder_stats(views.attempts(spark, root).where("ok")),
        metrics.live_cache_counts(views.cache_entries(spark, root), now),
        sequences.queue_peak(_timeline(spark, root)).drop("scope"),
        pending,
    )


def _clock(spark, root):
    skewed = views.events(spark, root).selectExpr(
        "event_id", "user_id", "unix_seconds(ts) - CASE WHEN k % 10 = 0 THEN k * 5000 ELSE 0 END AS ts"
    )
    fixed = sequences.clock_repair(skewed, source="user_id", arrival="event_id", ts="ts")
    return fixed.select("event_id", "ts", "ts_fixed", "skewed")


def _audited(spark, root):
    return policy.url_policy_audit(views.urls(spark, root))


def _batches(spark, root):
    return sequences.upload_batches(views.parts(spark, root))


def _plans(spark, root):
    return catalogue.strategy_plan(views.media(spark, root), replace(DEFAULTS, transcode_concurrency=2))


def _cascade(spark, root):
    return folds.admission_cascade(
        views.requests(spark, root), user_limit=2, user_window_s=DAY, channel_limit=8, channel_window_s=DAY
    )


def _labels(spark, root):
    return folds.resolver_cache_labels(views.lookups(spark, root), positive_ttl_s=DAY, negative_ttl_s=DAY // 4)


def batch() -> dict[str, Query]:
    v = views
    q: dict[str, Query] = {}
    # sources and stores
    q["ingest_post_media"] = lambda s, r: ingest.ingest_post_media(v.raw_posts(s, r))
    q["post_media_quarantine"] = lambda s, r: ingest.post_media_quarantine(v.raw_posts(s, r)).select("id", "kind")
    q["ingest_formats"] = lambda s, r: ingest.ingest_formats(v.raw_items(s, r))
    q["formats_quarantine"] = lambda s, r: ingest.formats_quarantine(v.raw_items(s, r)).select("id", "kind")
    q["probe_quarantine"] = lambda s, r: ingest.probe_quarantine(v.raw_probes(s, r)).select("id", "kind")
    q["ingest_probe_facts"] = lambda s, r: ingest.ingest_probe_facts(v.raw_probes(s, r))
    q["dedup_store_upsert"] = _store
    q["dedup_store_hydrate"] = lambda s, r: stores.dedup_store_hydrate(_store(s, r), _now(s, r))
    q["dedup_store_prune"] = lambda s, r: _on_disk(s, r).prune(_now(s, r))
    q["dedup_store_remainder"] = _remainder
    q["metrics_store_load"] = lambda s, r: stores.metrics_store_load(v.counters(s, r))
    q["job_report"] = lambda s, r: _flat_report(_reports(s, r))
    q["job_report_lines"] = _report_lines
    # text and URLs
    q["job_report_parts"] = lambda s, r: stores.job_report_parts(v.parts(s, r)).withColumn("share", F.round("share", 6))
    q["extract_links"] = lambda s, r: _links(s, r).drop("ts")
    q["canonical_link_stats"] = lambda s, r: text.canonical_link_stats(_links(s, r)).select(
        "canonical_url", "n", "n_hosts", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us")
    )
    q["extension_profile"] = lambda s, r: text.extension_profile(v.post_media(s, r))
    q["url_policy_audit"] = lambda s, r: _audited(s, r).drop("url")
    q["url_policy_counts"] = lambda s, r: policy.url_policy_counts(_audited(s, r))
    q["resolved_ip_audit"] = lambda s, r: policy.resolved_ip_audit(v.url_ips(s, r))
    q["redirect_chain_audit"] = lambda s, r: policy.redirect_chain_audit(v.hops(s, r))
    q["log_tail"] = lambda s, r: text.log_tail(v.log_lines(s, r))
    q["log_tail_success"] = lambda s, r: text.log_tail(v.log_lines(s, r), LOG_TAIL_SUCCESS)
    # outcomes
    q["resolve_failure_durability"] = lambda s, r: outcomes.resolve_failure_durability(v.resolve_failures(s, r))
    q["download_outcomes"] = lambda s, r: outcomes.download_outcomes(v.downloads(s, r))
    q["download_outcome_counts"] = lambda s, r: outcomes.download_outcome_counts(outcomes.download_outcomes(v.downloads(s, r)))
    q["probe_requirements"] = lambda s, r: outcomes.probe_requirements(v.downloads(s, r))
    q["probe_requirement_totals"] = lambda s, r: outcomes.probe_requirement_totals(outcomes.probe_flags(v.downloads(s, r)))
    q["hw_failure_match"] = lambda s, r: outcomes.hw_failure_match(v.attempts(s, r))
    q["retry_schedule"] = lambda s, r: outcomes.retry_schedule(v.http_attempts(s, r))
    q["error_notifications"] = lambda s, r: outcomes.error_notifications(v.jobs(s, r).where("NOT ok"))
    # joins
    q["resolver_fallback_chain"] = _fallback
    q["media_facts_merge"] = _merge
    q["duplicate_requests"] = lambda s, r: joins.duplicate_requests(*_taken(s, r))
    q["new_requests"] = lambda s, r: joins.new_requests(*_taken(s, r))
    q["slow_stage_alerts"] = _alerts
    # metrics
    q["run_totals"] = lambda s, r: metrics.run_totals(v.jobs(s, r))
    q["stage_averages"] = lambda s, r: metrics.stage_averages(v.stage_runs(s, r))
    q["stage_window"] = lambda s, r: metrics.stage_window(v.stage_runs(s, r), 3600)
    q["error_category_counts"] = lambda s, r: metrics.error_category_counts(v.failures(s, r))
    q["job_diagnostics"] = lambda s, r: metrics.job_diagnostics(v.jobs(s, r))
    q["job_diagnostics_by_kind"] = lambda s, r: metrics.job_diagnostics_by_kind(v.jobs(s, r))
    q["encoder_stats"] = lambda s, r: metrics.encoder_stats(v.attempts(s, r).where("ok"))
    q["upload_timing"] = lambda s, r: metrics.upload_timing(v.upload_runs(s, r))
    q["upload_timing_rollup"] = lambda s, r: metrics.upload_timing_rollup(metrics.upload_timing(v.upload_runs(s, r)))
    q["live_cache_counts"] = lambda s, r: metrics.live_cache_counts(v.cache_entries(s, r), _now(s, r))
    q["status_summary"] = _status
    # planning
    q["bitrate_budget"] = lambda s, r: catalogue.bitrate_budget(v.media(s, r))
    q["bitrate_budget_bands"] = lambda s, r: catalogue.bitrate_budget_bands(v.media(s, r))
    q["quality_ladder_demand"] = lambda s, r: catalogue.quality_ladder_demand(v.media(s, r))
    q["quality_ladder_demand_size"] = lambda s, r: catalogue.quality_ladder_demand(v.media(s, r), "size")
    q["quality_ladder_demand_balanced"] = lambda s, r: catalogue.quality_ladder_demand(v.media(s, r), "balanced")
    q["split_plan"] = lambda s, r: catalogue.split_plan(v.media(s, r)).withColumn("segment_s", F.round("segment_s", 6))
    q["segment_schedule"] = lambda s, r: catalogue.segment_schedule(catalogue.split_plan(v.media(s, r))).selectExpr(
        "id", "seg", "cast(start_s AS double) AS start_s", "cast(dur_s AS double) AS dur_s", "name"
    )
    q["strategy_plan"] = lambda s, r: _plans(s, r).withColumn("strategies", F.array_join("strategies", ",")).drop("encoder")
    q["strategy_encoder"] = lambda s, r: catalogue.strategy_plan(
        v.media(s, r), replace(DEFAULTS, transcode_concurrency=2, backend="qsv")
    ).select("id", F.array_join("strategies", ",").alias("strategies"), "parallel", "encoder")
    q["strategy_demand"] = lambda s, r: catalogue.strategy_demand(_plans(s, r))
    q["image_attempt_grid"] = lambda s, r: catalogue.image_attempt_grid(v.media(s, r))
    # sequences and selection
    q["queue_depth_timeline"] = lambda s, r: _timeline(s, r).select("at_us", "seq", "depth", "peak", "warn")
    q["queue_peak"] = lambda s, r: sequences.queue_peak(_timeline(s, r)).drop("scope")
    q["concurrency_in_use"] = lambda s, r: sequences.concurrency_in_use(_intervals(s, r))
    q["clock_repair"] = _clock
    q["fallback_latch"] = lambda s, r: sequences.fallback_latch(v.attempts(s, r))
    q["failure_streaks"] = lambda s, r: sequences.failure_streaks(v.attempts(s, r))
    q["best_post_media"] = lambda s, r: selection.best_post_media(
        v.post_media(s, r), v.table(s, r, "orders").selectExpr("o_orderkey AS id")
    )
    q["best_format"] = lambda s, r: selection.best_format(v.formats(s, r))
    q["strategy_outcome"] = lambda s, r: selection.strategy_outcome(v.strategy_attempts(s, r))
    q["split_fit_check"] = lambda s, r: selection.split_fit_check(
        v.parts(s, r), jobs=v.table(s, r, "orders").selectExpr("o_orderkey AS job")
    )
    q["upload_batches"] = _batches
    q["upload_batch_summary"] = lambda s, r: sequences.upload_batch_summary(_batches(s, r))
    # folds
    post = ["channel_id", "tweet_id"]
    q["ttl_dedup"] = lambda s, r: folds.ttl_dedup(_in_channel(s, r), post).select("request_id", "kept")
    q["inflight_dedup"] = lambda s, r: folds.inflight_dedup(_in_channel(s, r), post).select("request_id", "accepted")
    q["rate_limit_user"] = lambda s, r: folds.rate_limit(
        v.requests(s, r).where("author_id IS NOT NULL"), ["author_id"], 2, DAY
    ).select("request_id", "allowed")
    q["rate_limit_channel"] = lambda s, r: folds.rate_limit(_in_channel(s, r), ["channel_id"], 8, DAY).select("request_id", "allowed")
    q["sliding_rate_audit"] = lambda s, r: folds.sliding_rate_audit(_in_channel(s, r), ["channel_id"], 8, DAY)
    q["admission_cascade"] = _cascade
    q["admission_funnel"] = lambda s, r: folds.admission_funnel(_cascade(s, r))
    q["resolver_cache_labels"] = lambda s, r: _labels(s, r).select("request_id", "label")
    q["cache_hit_rates"] = lambda s, r: folds.cache_hit_rates(_labels(s, r))
    q["progress_debounce"] = lambda s, r: folds.progress_debounce(v.progress(s, r), DEBOUNCE_S).drop("ts")
    return q


def _stream_channel(spark, root):
    return views.shape_requests(read_events(spark, root)).where("channel_id IS NOT NULL")


def _stream_dedup(spark, root):
    run = Replay(spark)
    return run.drain(stateful.stream_dedup(_stream_channel(spark, root), ["channel_id", "tweet_id"], DAY, ticks=run.ticks))


def _stream_limit(spark, root):
    run, requests = Replay(spark), views.shape_requests(read_events(spark, root)).where("author_id IS NOT NULL")
    return run.drain(stateful.stream_rate_limit(requests, ["author_id"], 2, DAY, ticks=run.ticks))


def _stream_progress(spark, root):
    run, rows = Replay(spark), views.shape_progress(read_events(spark, root))
    # a user is one job, however long nothing is heard of it
    return run.drain(stateful.stream_progress_debounce(rows, DEBOUNCE_S, idle_s=100 * 365 * DAY, ticks=run.ticks))


def streams() -> dict[str, Query]:
    """Each runs over the folder's event files to the end and returns what the stream wrote."""
    v = views
    q: dict[str, Query] = {}
    q["stream_dedup"] = lambda s, r: _stream_dedup(s, r).where("decision = 'kept'").select("request_id")
    q["stream_rate_limit"] = lambda s, r: _stream_limit(s, r).select(
        "request_id", F.when(F.col("decision") != "late", F.col("decision") == "allowed").alias("allowed")
    )
    q["stream_progress_debounce"] = lambda s, r: _stream_progress(s, r).select(
        "job", "seq", "stage", "done", "total", F.when(F.col("decision") != "late", F.col("decision") == "flushed").alias("flushed")
    )
    q["stream_stage_window"] = lambda s, r: rollups.stream_stage_window(v.shape_stage_runs(read_events(s, r)), "1 hour", "2 hours")
    q["stream_totals"] = lambda s, r: rollups.stream_run_totals(v.shape_jobs(read_events(s, r)))
    q["stream_error_counts"] = lambda s, r: rollups.stream_error_counts(v.shape_failures(read_events(s, r)))
    q["stream_store_upsert"] = lambda s, r: rollups.stream_store_upsert(v.shape_processed_writes(read_events(s, r)), **STORE)
    return q


def queries() -> dict[str, Query]:
    return {**batch(), **streams()}
