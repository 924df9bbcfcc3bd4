"""Operators that combine logs by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.constants import CONTAINER_BY_EXTENSION, STAGE_THRESHOLDS_MS
from clipledger.functions.failures import durable_failure


def resolver_fallback_chain(requests: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary result, else fallback result, else the fallback's error; plus the error worth remembering.

    ``primary`` and ``fallback`` hold one row per request: req, ok, kind, status, error.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select("req", *(F.col(c).alias(f"_{p}_{c}") for c in ("ok", "kind", "status", "error")))

    joined = requests.select("req").join(side(primary, "p"), "req", "left").join(side(fallback, "f"), "req", "left")
    p_ok, f_ok = F.coalesce("_p_ok", F.lit(False)), F.coalesce("_f_ok", F.lit(False))
    ok = p_ok | f_ok
    return joined.select(
        "req",
        F.when(p_ok, "primary").otherwise("fallback").alias("resolver"),
        ok.alias("ok"),
        F.when(~ok, F.col("_f_error")).alias("error"),
        F.when(
            ~ok,
            F.when(durable_failure("_f_kind", "_f_status", "_f_error"), F.col("_f_error")).when(
                durable_failure("_p_kind", "_p_status", "_p_error"), F.col("_p_error")
            ),
        ).alias("neg_cached_error"),
    )


def media_facts_merge(resolved: DataFrame, downloads: DataFrame, probes: DataFrame) -> DataFrame:
    """Facts of each downloaded file: probe values where a probe was due, else the resolver's.

    resolved: id, duration_s, w, h, ext; downloads: id, size, must_probe, should_probe;
    probes: the output of ``ingest_probe_facts``, without rows for failed probes.
    """
    p = probes.select("id", *(F.col(c).alias(f"_{c}") for c in
                              ("duration_s", "w", "h", "container", "video_codec", "audio_codec", "bitrate_kbps")),
                      F.lit(True).alias("_probed"))
    due = downloads.select("id", "size", "must_probe", "should_probe")
    joined = resolved.join(due, "id").join(p, "id", "left")
    used = F.col("should_probe") & F.coalesce("_probed", F.lit(False))

    def probed(name: str):
        return F.when(used, F.col(f"_{name}"))

    by_ext = F.lit("unknown")
    for ext, name in CONTAINER_BY_EXTENSION.items():
        by_ext = F.when(F.col("ext") == ext, name).otherwise(by_ext)
    # width and height travel together
    has_res = used & F.col("_w").isNotNull() & F.col("_h").isNotNull()
    merged = joined.select(
        "id",
        "size",
        F.coalesce(probed("duration_s"), "duration_s").alias("duration_s"),
        F.when(has_res, F.col("_w")).otherwise(F.col("w")).alias("w"),
        F.when(has_res, F.col("_h")).otherwise(F.col("h")).alias("h"),
        F.when(by_ext == "unknown", F.coalesce(probed("container"), F.lit("unknown"))).otherwise(by_ext).alias("container"),
        F.coalesce(probed("video_codec"), F.lit("other")).alias("video_codec"),
        F.coalesce(probed("audio_codec"), F.lit("other")).alias("audio_codec"),
        probed("bitrate_kbps").alias("_bitrate"),
        F.when(F.col("must_probe") & F.col("_probed").isNull(), "corrupt download").alias("error"),
    )
    d = F.col("duration_s")
    estimated = F.when(
        (d > 0.1) & (d < float("inf")) & (F.col("size") > 0),
        F.ceil(F.col("size").cast("double") * 8.0 / d / 1000.0),
    )
    estimated = F.when(estimated <= 4_294_967_295, estimated)
    return merged.withColumn("bitrate_kbps", F.coalesce("_bitrate", estimated)).drop("_bitrate")


def _taken(inflight: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    # one row per key: a crowded key then only skews the request side, which AQE can split
    return inflight.select(*keys).unionByName(live.select(*keys)).distinct()


def duplicate_requests(requests: DataFrame, inflight: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose key is running or was processed recently."""
    return requests.join(_taken(inflight, live, keys), keys, "left_semi")


def new_requests(requests: DataFrame, inflight: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose key is neither running nor processed recently."""
    return requests.join(_taken(inflight, live, keys), keys, "left_anti")


def slow_stage_alerts(stage_runs: DataFrame, thresholds=STAGE_THRESHOLDS_MS) -> DataFrame:
    """Runs strictly above their stage's threshold; the threshold table is a fixed five rows."""
    limits = stage_runs.sparkSession.createDataFrame(list(thresholds), "stage string, limit_ms bigint")
    return (
        stage_runs.join(F.broadcast(limits), "stage")
        .groupBy("stage")
        .agg(
            F.count_if(F.col("duration_ms") > F.col("limit_ms")).alias("n_slow"),
            F.count(F.lit(1)).alias("n"),
            F.max("duration_ms").alias("max_ms"),
        )
        .withColumn("share", F.round(F.col("n_slow") / F.col("n"), 6))
    )
