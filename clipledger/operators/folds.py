"""Decisions that depend on earlier decisions: dedup, rate limits, caches, debounce.

Event time is read in whole seconds, as the limits are.  All of them
first shrink each key to one row per second ("slot") with a
map-side combined aggregate, so the fold sees at most one row per key and
second of clock time whatever the traffic; the per-row answer is then a
comparison with its slot.  The fold itself is ``chunks.ordered_fold``, which
splits a key over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.config import DEFAULTS
from clipledger.functions.failures import durable_failure
from clipledger.functions.links import link_ids
from clipledger.functions.shared import computed_once
from clipledger.operators.chunks import Fold, ordered_fold
from clipledger.session import durable

SEC = "_sec"


class _AnchorFold(Fold):
    """Keeps a slot when the last kept one is more than ``ttl`` seconds old."""

    inputs = (SEC,)
    outputs = (("_open", T.BooleanType()),)

    def __init__(self, ttl: int):
        self.ttl, self.reach = ttl, ttl + 1

    def step(self, kept, sec):
        if kept is None or sec - kept > self.ttl:
            return sec, (True,)
        return kept, (False,)

    def lapse(self, kept):
        return kept + self.ttl + 1

    def closed(self, batch, start, end):
        times = batch.column(SEC).to_numpy()
        return times[end - 1] - times[start] <= self.ttl

    def answers(self, batch, begins):
        return [begins]


class _WindowQuotaFold(Fold):
    """Fixed window opened by its first request; hands out what is left of ``n``."""

    inputs = (SEC, "_asked")
    outputs = (("_granted", T.LongType()),)

    def __init__(self, n: int, window: int):
        self.n, self.window, self.reach = n, window, window

    def step(self, state, sec, asked):
        anchor, used = state if state else (None, 0)
        if anchor is None or sec - anchor >= self.window:
            anchor, used = sec, 0
        granted = min(asked, self.n - used)
        return [anchor, used + granted], (granted,)

    def lapse(self, state):
        return state[0] + self.window

    def weight(self, sec, asked):
        return asked

    def through(self, state, weight):
        return [state[0], min(self.n, state[1] + weight)]

    def closed(self, batch, start, end):
        # no window can hold more than all of an island's requests
        total = np.cumsum(np.r_[0, batch.column("_asked").to_numpy()])
        return (total[end] - total[start] <= self.n) | (end - start == 1)

    def answers(self, batch, begins):
        return [np.minimum(batch.column("_asked").to_numpy(), self.n)]


class _InflightFold(Fold):
    """Running jobs and finished successes block their key; failures free it."""

    inputs = (SEC, "_end", "_ok")
    outputs = (("_open", T.BooleanType()),)
    NO_JOB = -(1 << 62)

    def __init__(self, ttl: int, inflight_ttl: int):
        self.ttl, self.inflight_ttl = ttl, inflight_ttl

    def start(self):
        # in-flight mark lapses at, processed mark lasts through, jobs still to end
        return [None, None, []]

    def step(self, state, sec, end, ok):
        running, done, ends = state
        due = sorted(e for e in ends if e[0] <= sec)
        for at, good in due:
            running = None
            if good:
                done = at + self.ttl
        ends = [e for e in ends if e[0] > sec]
        # marks that have lapsed are forgotten, so that states which act alike are equal
        running = running if running is not None and sec < running else None
        done = done if done is not None and sec <= done else None
        if running is not None or done is not None:
            return [running, done, ends], (False,)
        if end is not None:
            running = sec + self.inflight_ttl
            ends = ends + [[end, ok]]
        return [running, done, ends], (True,)

    # A chunk's table has, for every row, the last row that opens if that row opens and no older job is still
    # to end. Marks and the ends of older jobs only move the first row that opens, which is found by time; where an
    # older job is still to end when a row opens, the way goes on from row to row until none is.

    def _next(self, times, low: int, state: list) -> tuple[int | None, list]:
        """The first row from ``low`` on that opens, with the jobs still to end then; or None and the state after the last row."""
        running, done, ends = state
        ends = sorted(ends)
        while True:
            free = max(running if running is not None else times[0], done + 1 if done is not None else times[0])
            i = max(low, bisect_left(times, free))
            if i < len(times) and not (ends and ends[0][0] <= times[i]):
                return i, ends
            if not ends or ends[0][0] > times[-1]:
                running = running if running is not None and times[-1] < running else None
                done = done if done is not None and times[-1] <= done else None
                return None, [running, done, ends]
            (at, good), ends = ends[0], ends[1:]
            running, done = None, at + self.ttl if good else done
            low = max(low, bisect_left(times, at))

    def answers(self, batch, begins):
        return [np.ones(len(begins), bool)]

    def _opened(self, sec: int, end: int | None, ok: bool, ends: list) -> list:
        return [None, None, ends] if end is None else [sec + self.inflight_ttl, None, [*ends, [end, ok]]]

    def table(self, rows):
        times, last = [r[0] for r in rows], list(range(len(rows)))
        for i in range(len(rows) - 1, -1, -1):
            j, ends = self._next(times, i + 1, self._opened(*rows[i], []))
            if j is not None and not ends:
                last[i] = last[j]
        jobs = [(self.NO_JOB if end is None else end, bool(ok)) for _, end, ok in rows]
        return np.array([times, [e for e, _ in jobs], [k for _, k in jobs], last], np.int64).tobytes()

    def enter(self, table, state):
        times, end, ok, last = np.frombuffer(table, np.int64).reshape(4, -1)
        low = 0
        while True:
            i, after = self._next(times, low, state)
            if i is None:
                running, done, ends = after
                return [running if running is None else int(running), done if done is None else int(done), ends]
            i = i if after else int(last[i])
            job = None if end[i] == self.NO_JOB else int(end[i])
            state, low = self._opened(int(times[i]), job, bool(ok[i]), after), i + 1


class _ResolverCacheFold(Fold):
    """Negative entries are looked up before positive ones; a miss may store either."""

    inputs = (SEC, "_stores")
    outputs = (("_held", T.StringType()),)

    def __init__(self, positive_ttl: int, negative_ttl: int):
        self.positive_ttl, self.negative_ttl = positive_ttl, negative_ttl
        self.reach = max(positive_ttl, negative_ttl)

    def step(self, state, sec, stores):
        positive, negative = state if state else (None, None)
        positive = positive if positive is not None and sec < positive else None
        negative = negative if negative is not None and sec < negative else None
        if negative is not None:
            return [positive, negative], ("negative_hit",)
        if positive is not None:
            return [positive, negative], ("positive_hit",)
        if stores == "positive":
            positive = sec + self.positive_ttl
        elif stores == "negative":
            negative = sec + self.negative_ttl
        return [positive, negative], (None,)

    def lapse(self, state):
        # an entry is stored only where none is live, so at most one of the two is
        return max((x for x in state if x is not None), default=None)

    def answers(self, batch, begins):
        return [[None] * len(begins)]


class _DebounceFold(Fold):
    """A slot is open when the last emission is at least ``wait`` seconds old."""

    inputs = (SEC, "_forced")
    outputs = (("_open", T.BooleanType()),)

    def __init__(self, wait: int):
        self.wait = self.reach = wait

    def step(self, last, sec, forced):
        is_open = last is None or sec - last >= self.wait
        return (sec if is_open or forced else last), (is_open,)

    def lapse(self, last):
        return last + self.wait

    def resets(self, sec, forced):
        return bool(forced)

    def answers(self, batch, begins):
        return [np.ones(len(begins), bool)]


def _ship() -> None:
    import clipledger.operators.folds as here

    cloudpickle.register_pickle_by_value(here)


def _seconds(ts: str) -> Column:
    return F.unix_seconds(ts).alias(SEC)


def _label(rows: DataFrame, slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give every row its slot's answer; rows outside ``slots`` get nulls.

    A crowded slot only makes the left side of this join skewed, which AQE splits.
    """
    return rows.join(slots, [*keys, SEC], "left")


def _position(ts: str, id_col: str) -> Column:
    return F.struct(F.col(ts).alias("at"), F.col(id_col).alias("id"))


def ttl_dedup(
    requests: DataFrame,
    keys: Sequence[str],
    ttl_s: int = DEFAULTS.dedup_ttl_s,
    *,
    id_col: str = "request_id",
    ts: str = "ts",
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds ``kept``: first request per key, then the first one over ``ttl_s`` after the last kept."""
    _ship()
    rows = requests.withColumn(SEC, F.unix_seconds(ts))
    slots = rows.groupBy(*keys, SEC).agg(F.min(_position(ts, id_col)).alias("_first"))
    folded = ordered_fold(slots.select(*keys, SEC, F.col("_first.id").alias("_id")), keys, [SEC], _AnchorFold(ttl_s), n_chunks)
    kept = folded.where("_open").select(F.col("_id").alias(id_col), F.lit(True).alias("kept"))
    return requests.join(kept, id_col, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def rate_limit(
    requests: DataFrame,
    keys: Sequence[str],
    n: int,
    window_s: int,
    *,
    id_col: str = "request_id",
    ts: str = "ts",
    where: Column | None = None,
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds ``allowed``: at most ``n`` per window, which opens at the first request after the last lapsed.

    Denied requests do not extend the window; ``n`` = 0 turns the limit off.  Rows
    failing ``where`` take no part and get null.
    """
    counted = F.lit(True) if where is None else where
    if n == 0:
        return requests.withColumn("allowed", F.when(counted, True))
    _ship()
    rows = requests.withColumn(SEC, F.unix_seconds(ts)).withColumn("_in", F.coalesce(counted, F.lit(False)))
    # no slot can grant more than n, so later rows of a second need not be ranked:
    # the filter is pushed below the shuffle as a per-group limit
    first_n = (
        rows.where("_in")
        .select(*keys, SEC, _position(ts, id_col).alias("_pos"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, SEC).orderBy("_pos")))
        .where(F.col("_rn") <= n)
    )
    slots = first_n.groupBy(*keys, SEC).agg(
        F.count(F.lit(1)).alias("_asked"), F.sort_array(F.collect_list("_pos")).alias("_queue")  # <= n entries
    )
    folded = ordered_fold(slots, keys, [SEC], _WindowQuotaFold(n, window_s), n_chunks)
    cut = folded.where("_granted > 0").select(
        *keys, SEC, F.element_at("_queue", F.col("_granted").cast("int")).alias("_last")
    )
    return (
        _label(rows, cut, keys)
        .withColumn("allowed", F.when(F.col("_in"), F.coalesce(_position(ts, id_col) <= F.col("_last"), F.lit(False))))
        .drop(SEC, "_in", "_last")
    )


def inflight_dedup(
    requests: DataFrame,
    keys: Sequence[str],
    ttl_s: int = DEFAULTS.dedup_ttl_s,
    inflight_ttl_s: int = DEFAULTS.inflight_ttl_s,
    *,
    id_col: str = "request_id",
    ts: str = "ts",
    end: str = "end_ts",
    ok: str = "ok",
    where: Column | None = None,
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds ``accepted``: a key is closed while its job runs and for ``ttl_s`` after it succeeded.

    A job that fails in the second it started closes nothing, so all requests of a
    second up to its first blocking one share the slot's answer.
    """
    _ship()
    counted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = requests.withColumn(SEC, F.unix_seconds(ts)).withColumn("_in", counted)
    end_s = F.greatest(F.unix_seconds(end), F.col(SEC))
    blocking = F.col(ok) | (end_s > F.col(SEC))
    first = F.min(
        F.when(blocking, F.struct(_position(ts, id_col).alias("pos"), end_s.alias("end"), F.col(ok).alias("ok")))
    )
    slots = rows.where("_in").groupBy(*keys, SEC).agg(first.alias("_f")).select(
        *keys, SEC, F.col("_f.pos").alias("_pos"), F.col("_f.end").alias("_end"), F.col("_f.ok").alias("_ok")
    )
    folded = ordered_fold(slots, keys, [SEC], _InflightFold(ttl_s, inflight_ttl_s), n_chunks)
    answer = folded.where("_open").select(*keys, SEC, F.lit(True).alias("_open"), "_pos")
    within = F.col("_pos").isNull() | (_position(ts, id_col) <= F.col("_pos"))
    return (
        _label(rows, answer, keys)
        .withColumn("accepted", F.when(F.col("_in"), F.coalesce(F.col("_open") & within, F.lit(False))))
        .drop(SEC, "_in", "_open", "_pos")
    )


def sliding_rate_audit(
    requests: DataFrame, keys: Sequence[str], n: int, window_s: int, *, ts: str = "ts"
) -> DataFrame:
    """Requests in the trailing window at every second a key was active, and whether they exceed ``n``.

    Counts per second are laid into buckets of eight windows, a day at least. Only seconds less than a
    window before a bucket's end are also rows of the next one, as its context; no group exceeds
    a bucket and a window. A count is added at its second and taken away a window later, so one
    running sum tells what is in the window, however many seconds that holds.
    """
    span = max(8 * window_s, 86_400)
    per_second = requests.groupBy(*keys, _seconds(ts)).agg(F.count(F.lit(1)).alias("_n")).where(F.col(SEC).isNotNull())
    sec, home = F.col(SEC), F.floor(F.col(SEC) / span)
    last = sec > (home + 1) * span - window_s

    def move(bucket: Column, at: Column, delta: Column, own: bool) -> Column:
        return F.struct(bucket.alias("_bucket"), at.alias("_at"), delta.alias("_delta"), F.lit(own).alias("_own"))

    moves = F.array(
        move(home, sec, F.col("_n"), True),
        F.when(last, move(home + 1, sec, F.col("_n"), False)),
        move(F.when(last, home + 1).otherwise(home), sec + window_s, -F.col("_n"), False),
    )
    spread = per_second.select(*keys, F.explode(F.array_compact(moves)).alias("_move")).select(*keys, "_move.*")
    so_far = Window.partitionBy(*keys, "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        spread.withColumn("n_trailing", F.sum("_delta").over(so_far))
        .where("_own")
        .select(*keys, F.col("_at").alias("ts_s"), "n_trailing", (F.col("n_trailing") > n).alias("over"))
    )


def admission_cascade(
    requests: DataFrame,
    *,
    user_limit: int = DEFAULTS.user_limit,
    user_window_s: int = DEFAULTS.user_window_s,
    channel_limit: int = DEFAULTS.channel_limit,
    channel_window_s: int = DEFAULTS.channel_window_s,
    ttl_s: int = DEFAULTS.dedup_ttl_s,
    inflight_ttl_s: int = DEFAULTS.inflight_ttl_s,
    n_chunks: int | None = None,
) -> DataFrame:
    """``decision`` per request: the first gate that turns it away, else ``accepted``.

    Only what passed a gate goes on to the next, with the columns that the later gates
    need; the passing rows are written once between gates instead of recomputing them.
    """
    # an id for each request, not three searches of its text
    searched = computed_once(requests, "_ids", link_ids("content"), "request_id", "ts", "author_id", "channel_id", "end_ts", "ok", "content")
    n_links = F.coalesce(F.size("_ids"), F.lit(0))
    base = durable(searched.select(
        "request_id", "ts", "author_id", "channel_id", "end_ts", "ok",
        F.when(F.col("content").isNull(), "missing_url").when(n_links == 0, "no_link").when(n_links > 1, "many_links").alias("_unfit"),
        F.get("_ids", F.lit(0)).alias("_post"),
        F.when(F.col("channel_id").isNull(), "no_channel").when(F.col("author_id").isNull(), "no_author").alias("decision"),
    ))
    answer = lambda df, decision: df.select("request_id", decision.alias("decision"))

    users = durable(rate_limit(base.where("decision IS NULL").drop("decision"), ["author_id"], user_limit, user_window_s, n_chunks=n_chunks))
    passed = users.where("allowed").drop("allowed", "author_id")
    channels = durable(rate_limit(passed, ["channel_id"], channel_limit, channel_window_s, n_chunks=n_chunks))
    fit = channels.where("allowed AND _unfit IS NULL").drop("allowed", "_unfit")
    last = inflight_dedup(fit, ["channel_id", "_post"], ttl_s, inflight_ttl_s, n_chunks=n_chunks)
    return (
        answer(base.where("decision IS NOT NULL"), F.col("decision"))
        .unionByName(answer(users.where("NOT allowed"), F.lit("user_limited")))
        .unionByName(answer(channels.where("NOT allowed"), F.lit("channel_limited")))
        .unionByName(answer(channels.where("allowed AND _unfit IS NOT NULL"), F.col("_unfit")))
        .unionByName(answer(last, F.when(F.col("accepted"), "accepted").otherwise("duplicate")))
    )


def admission_funnel(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def resolver_cache_labels(
    lookups: DataFrame,
    *,
    positive_ttl_s: int = DEFAULTS.positive_ttl_s,
    negative_ttl_s: int = DEFAULTS.negative_ttl_s,
    n_chunks: int | None = None,
) -> DataFrame:
    """Adds ``label``: negative_hit, positive_hit or miss per lookup of a post."""
    _ship()
    keys = ["tweet_id"]
    stored = (
        F.when(F.col("primary_ok") | F.col("fallback_ok"), "positive")
        .when(
            durable_failure("fallback_kind", F.lit(None), "fallback_error")
            | durable_failure("primary_kind", "primary_status", "primary_error"),
            "negative",
        )
    )
    rows = lookups.withColumn(SEC, F.unix_seconds("ts")).withColumn("_stores", stored)
    first = F.min(
        F.when(
            F.col("_stores").isNotNull(),
            F.struct(_position("ts", "request_id").alias("pos"), F.col("_stores").alias("stores")),
        )
    )
    slots = rows.groupBy(*keys, SEC).agg(first.alias("_f")).select(
        *keys, SEC, F.col("_f.pos").alias("_pos"), F.col("_f.stores").alias("_stores")
    )
    folded = ordered_fold(slots, keys, [SEC], _ResolverCacheFold(positive_ttl_s, negative_ttl_s), n_chunks)
    answer = folded.select(*keys, SEC, "_held", "_pos", F.col("_stores").alias("_set"))
    label = (
        F.when(F.col("_held").isNotNull(), F.col("_held"))
        .when(F.col("_pos").isNull() | (_position("ts", "request_id") <= F.col("_pos")), "miss")
        .otherwise(F.concat("_set", F.lit("_hit")))
    )
    return (
        _label(rows, answer, keys).withColumn("label", label).drop(SEC, "_stores", "_held", "_pos", "_set")
    )


def cache_hit_rates(labelled: DataFrame) -> DataFrame:
    """Lookups and hits per hour."""
    return labelled.groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("hour")).agg(
        F.count(F.lit(1)).alias("lookups"),
        F.count_if(F.col("label") == "positive_hit").alias("positive_hits"),
        F.count_if(F.col("label") == "negative_hit").alias("negative_hits"),
    )


def progress_debounce(
    progress: DataFrame,
    debounce_s: int = DEFAULTS.debounce_s,
    *,
    n_chunks: int | None = None,
) -> DataFrame:
    """Progress rows that are shown, plus per job the last held one when it differs from the last shown.

    Without a wait every row is shown.
    """
    if debounce_s <= 0:
        return progress.select("job", "ts", "seq", "stage", "done", "total", F.lit(False).alias("flushed"))
    _ship()
    keys = ["job"]
    unfinished = F.coalesce((F.col("stage") == "transcoding") & (F.col("done") < F.col("total")), F.lit(False))
    rows = progress.withColumn(SEC, F.unix_seconds("ts")).withColumn("_wait", unfinished)
    slots = rows.groupBy(*keys, SEC).agg(
        F.min(_position("ts", "seq")).alias("_first"), F.bool_or(~F.col("_wait")).alias("_forced")
    )
    folded = ordered_fold(slots, keys, [SEC], _DebounceFold(debounce_s), n_chunks)
    answer = folded.where("_open").select(*keys, SEC, F.col("_first").alias("_lead"))
    shown = _label(rows, answer, keys).withColumn(
        "_shown", ~F.col("_wait") | F.coalesce(_position("ts", "seq") == F.col("_lead"), F.lit(False))
    )
    whole = F.struct("ts", "seq", "stage", "done", "total")
    final = shown.groupBy(*keys).agg(
        F.max(F.when(F.col("_shown"), whole)).alias("_sent"), F.max(F.when(~F.col("_shown"), whole)).alias("_held")
    )

    def said(name: str) -> Column:
        return F.struct(f"{name}.stage", f"{name}.done", f"{name}.total")

    flush = final.where(
        F.col("_held").isNotNull()
        & (F.col("_sent").isNull() | ((F.col("_held") > F.col("_sent")) & ~said("_held").eqNullSafe(said("_sent"))))
    ).select(*keys, "_held.*", F.lit(True).alias("flushed"))
    return (
        shown.where("_shown")
        .select(*keys, "ts", "seq", "stage", "done", "total", F.lit(False).alias("flushed"))
        .unionByName(flush)
    )
