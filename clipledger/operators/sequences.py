"""Running values over ordered logs; a key may hold any share of the rows.

All of them work per chunk (see ``chunks``) and add what earlier chunks of the
same key carry in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS
from clipledger.constants import PERMITS
from clipledger.functions.failures import hardware_failure
from clipledger.operators.chunks import CHUNK, attach, before, inside, numbered, range_chunks, summaries, window_chunks

_ROWS = (Window.unboundedPreceding, Window.currentRow)


def _zero(c):
    return F.coalesce(c, F.lit(0))


def queue_depth_timeline(
    queue_events: DataFrame,
    *,
    scope: str = "scope",
    order: Sequence[str] = ("at_us", "seq"),
    warn_at: int = DEFAULTS.queue_warn,
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds depth, peak and warn after each +1/-1 event; depth never falls below 0.

    With S the running sum and m its running minimum, depth is S - min(0, m).  A chunk
    entered at depth D therefore shows max(D + s, s - m) with its own s and m, and that
    form needs only sum, minimum, maximum and largest s - m of each earlier chunk.
    """
    order = list(order)
    w = inside([scope], order).rowsBetween(*_ROWS)
    rows = window_chunks(queue_events, [scope], order, n_chunks)
    local = rows.withColumn("_s", F.sum("delta").over(w))
    local = local.withColumn("_m", F.min("_s").over(w))
    summary = summaries(
        local, [scope],
        F.sum("delta").alias("_sum"), F.min("_s").alias("_low"), F.max("_s").alias("_high"),
        F.max(F.col("_s") - F.col("_m")).alias("_rise"),
    )
    past = before([scope])
    base = summary.withColumn("_sin", _zero(F.sum("_sum").over(past)))
    base = base.withColumn("_min", F.min(F.col("_sin") + F.col("_low")).over(past))
    base = base.withColumn("_din", F.col("_sin") - F.least(F.lit(0), _zero(F.col("_min"))))
    base = base.withColumn("_pin", F.max(F.greatest(F.col("_din") + F.col("_high"), "_rise")).over(past))
    carry = base.where(F.col("_pin").isNotNull()).select(CHUNK, scope, "_din", "_pin")
    depth = F.greatest(_zero(F.col("_din")) + F.col("_s"), F.col("_s") - F.least(F.col("_m"), F.lit(0)))
    return (
        attach(local, carry, [scope])
        .withColumn("depth", depth)
        .withColumn("peak", F.greatest(_zero(F.col("_pin")), F.max("depth").over(w)))
        .withColumn("warn", F.col("depth") >= warn_at)
        .drop(CHUNK, "_s", "_m", "_din", "_pin")
    )


def queue_peak(timeline: DataFrame, scope: str = "scope") -> DataFrame:
    return timeline.groupBy(scope).agg(
        F.max("depth").alias("peak"),
        F.count_if("warn").alias("n_warn"),
        F.max(F.struct("at_us", "seq", "depth")).getField("depth").alias("depth_now"),
    )


def concurrency_in_use(
    stage_intervals: DataFrame, limits: Sequence[tuple[str, int]] = PERMITS, *, n_chunks: int | None = None
) -> DataFrame:
    """Peak of overlapping executions per stage and milliseconds spent at or over its limit.

    ``stage_intervals``: stage, start_ms, end_ms.  Starts and ends are first netted per
    stage and millisecond.  Time at the limit is summed from the instants where the level
    crosses it, so no row needs its successor.
    """
    spark = stage_intervals.sparkSession
    caps = spark.createDataFrame([(s, max(n, 1)) for s, n in limits], "stage string, limit bigint")
    moves = stage_intervals.where("end_ms > start_ms").select(
        "stage",
        F.explode(
            F.array(
                F.struct(F.col("start_ms").alias("at_ms"), F.lit(1).cast("bigint").alias("delta")),
                F.struct(F.col("end_ms").alias("at_ms"), F.lit(-1).cast("bigint").alias("delta")),
            )
        ).alias("m"),
    ).select("stage", "m.*")
    net = moves.groupBy("stage", "at_ms").agg(F.sum("delta").alias("delta"))
    rows = range_chunks(net, ["stage"], ["at_ms"], n_chunks)
    local = rows.withColumn("_s", F.sum("delta").over(inside(["stage"], ["at_ms"]).rowsBetween(*_ROWS)))
    summary = summaries(rows, ["stage"], F.sum("delta").alias("_sum"))
    carry = (
        summary.withColumn("_in", F.sum("_sum").over(before(["stage"])))
        .where(F.col("_in").isNotNull())
        .select(CHUNK, "stage", "_in")
    )
    level = attach(local, carry, ["stage"]).withColumn("_level", _zero(F.col("_in")) + F.col("_s"))
    at_now = (F.col("_level") >= F.col("limit")).cast("bigint")
    at_before = (F.col("_level") - F.col("delta") >= F.col("limit")).cast("bigint")
    got = (
        level.join(F.broadcast(caps), "stage")
        .groupBy("stage")
        .agg(
            F.max("_level").alias("peak"),
            F.sum(F.col("at_ms") * (at_before - at_now)).alias("ms_at_limit"),
        )
    )
    return caps.join(got, "stage", "left").select(
        "stage", _zero(F.col("peak")).alias("peak"), "limit", _zero(F.col("ms_at_limit")).alias("ms_at_limit")
    )


def clock_repair(
    events: DataFrame,
    *,
    source: str,
    arrival: str,
    ts: str,
    skew: int = DEFAULTS.clock_skew_s,
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds ts_fixed, the latest time seen so far per source, and skewed for rows over ``skew`` behind it.

    ``ts`` is a number of seconds.
    """
    rows = range_chunks(events, [source], [arrival], n_chunks)
    local = rows.withColumn("_max", F.max(ts).over(inside([source], [arrival]).rowsBetween(*_ROWS)))
    carry = (
        summaries(rows, [source], F.max(ts).alias("_top"))
        .withColumn("_in", F.max("_top").over(before([source])))
        .where(F.col("_in").isNotNull())
        .select(CHUNK, source, "_in")
    )
    return (
        attach(local, carry, [source])
        .withColumn("ts_fixed", F.greatest("_max", "_in"))
        .withColumn("skewed", F.col(ts) + skew < F.col("ts_fixed"))
        .drop(CHUNK, "_max", "_in")
    )


def fallback_latch(attempts: DataFrame, *, host: str = "src", order: str = "seq", concurrency: int = 2) -> DataFrame:
    """Per attempt: the backend in use, given that a host's first hardware failure moves it to software.

    Only the first failure matters, so it is one aggregate per host joined back; the
    latch of an attempt covers earlier attempts only.
    """
    flagged = hardware_failure(F.col("backend"), F.col("stderr"))
    first = attempts.where(flagged).groupBy(host).agg(F.min(order).alias("_first"))
    latched = F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return attempts.join(first, host, "left").select(
        "attempt_id",
        F.when(latched, "none").otherwise(F.col("backend")).alias("active_backend"),
        F.when(latched, 1).otherwise(max(concurrency, 1)).alias("concurrency"),
        latched.cast("int").alias("transitions"),
    )


def failure_streaks(
    attempts: DataFrame,
    *,
    source: str = "src",
    order: str = "seq",
    base_s: int = 1,
    max_exponent: int = 8,
    max_backoff_s: int = 300,
    disable_at: int = 5,
    n_chunks: int | None = None,
) -> DataFrame:
    """Consecutive failures per source, the backoff they call for and whether the source is disabled.

    Positions are counted per source; a streak is the distance to the last success.
    Being disabled is permanent, so the longest streak so far is carried as well: of
    a chunk that is either one inside it or its leading failures plus the carried ones.
    """
    k = [source]
    w = inside(k, [order]).rowsBetween(*_ROWS)
    rows = range_chunks(attempts.select(source, order, "ok"), k, [order], n_chunks)
    local = rows.withColumn("_n", F.count(F.lit(1)).over(w))
    local = local.withColumn("_ok_at", F.max(F.when(F.col("ok"), F.col("_n"))).over(w))
    within = F.col("_n") - F.col("_ok_at")
    summary = summaries(
        local, k,
        F.max("_n").alias("_rows"), F.max("_ok_at").alias("_last_ok"), F.min("_ok_at").alias("_first_ok"),
        F.max(within).alias("_inner"),
    )
    past = before(k)
    base = summary.withColumn("_before", _zero(F.sum("_rows").over(past)))
    base = base.withColumn("_ok_pos", F.max(F.col("_before") + F.col("_last_ok")).over(past))
    base = base.withColumn("_run", F.col("_before") - _zero(F.col("_ok_pos")))
    lead = F.coalesce(F.col("_first_ok") - 1, F.col("_rows"))
    base = base.withColumn("_longest", F.max(F.greatest(F.col("_run") + lead, _zero(F.col("_inner")))).over(past))
    carry = base.where(F.col("_longest").isNotNull()).select(CHUNK, source, "_run", "_longest")
    streak = F.coalesce(within, F.col("_n") + _zero(F.col("_run")))
    exponent = F.least(F.col("streak") - 1, F.lit(max_exponent))
    backoff = F.least(base_s * F.pow(F.lit(2.0), exponent).cast("bigint"), F.lit(max_backoff_s).cast("bigint"))
    return (
        attach(local, carry, k)
        .withColumn("streak", streak)
        .withColumn("_peak", F.greatest(F.max("streak").over(w), _zero(F.col("_longest"))))
        .select(
            source, order, "streak",
            F.when(F.col("streak") > 0, backoff).otherwise(0).cast("bigint").alias("backoff_s"),
            (F.col("_peak") >= disable_at).alias("disabled"),
        )
    )


def upload_batches(
    parts: DataFrame,
    *,
    max_bytes: int = DEFAULTS.max_upload_bytes,
    per_request: int = DEFAULTS.parts_per_request,
    prepare_concurrency: int = DEFAULTS.prepare_concurrency,
    window_bytes: int = DEFAULTS.attachment_window_bytes,
    batching: bool = DEFAULTS.batch_uploads,
    n_chunks: int | None = None,
) -> DataFrame:
    """Which request carries each part, and its attachment name.

    ``parts``: job, pos (any order within the job), size, ext.  A job is batched when it has
    several parts that together fit the preparation window.
    """
    budget = min(max(max_bytes * prepare_concurrency, 1), window_bytes)
    rows = numbered(parts, ["job"], ["pos"], "part", {"_bytes": "size"}, n_chunks)
    batched = F.lit(batching) & (F.col("_rows") > 1) & (F.col("_bytes") <= budget)
    rn = F.col("part")
    return rows.select(
        "job",
        "part",
        F.when(batched, F.floor((rn - 1) / per_request)).otherwise(rn - 1).alias("batch"),
        "size",
        F.when(F.col("_rows") > 1, F.format_string("tweet_%d_part%d.%s", "job", "part", "ext"))
        .otherwise(F.format_string("tweet_%d.%s", "job", "ext"))
        .alias("name"),
        F.when(F.col("size") > max_bytes, "file too large").alias("error"),
    )


def upload_batch_summary(batches: DataFrame) -> DataFrame:
    return batches.groupBy("job").agg(
        F.count(F.lit(1)).alias("parts"),
        (F.max("batch") + 1).alias("messages"),
        F.sum("size").alias("bytes"),
        F.count("error").alias("too_large"),
    )
