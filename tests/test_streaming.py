"""Streams over several files in several micro-batches give what the batch operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clipledger.operators import folds
from clipledger.sources import views
from clipledger.sources.stores import dedup_store_upsert
from clipledger.streaming import rollups, stateful
from clipledger.streaming.runner import Replay, read_events


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Six event files in time order; one user has most events and seconds repeat."""
    root, rnd = str(tmp_path_factory.mktemp("events")), random.Random(3)
    start, secs = dt.datetime(2024, 1, 1), sorted(rnd.randrange(6000) for _ in range(600))
    rows = [
        (i, start + dt.timedelta(seconds=s, microseconds=i), 1 if rnd.random() < 0.6 else rnd.randrange(2, 6),
         rnd.choice(["view", "click", "purchase", "signup", "error"]), rnd.random() * 400, '{"k": %d}' % rnd.randrange(100))
        for i, s in enumerate(secs)
    ]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    for part in range(6):
        df = spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1)
        df.write.parquet(f"{root}/part{part}")
        import glob, os, shutil, time

        shutil.copy(glob.glob(f"{root}/part{part}/*.parquet")[0], f"{root}/events-{part}.parquet")
        os.utime(f"{root}/events-{part}.parquet", (time.time() - 100 + part,) * 2)
    whole = views.shape_events(spark.read.parquet(*[f"{root}/events-{p}.parquet" for p in range(6)]))
    return root, whole


def stream(spark, files):
    return read_events(spark, files[0], files_per_trigger=1)


def requests_of(ev, key):
    return views.shape_requests(ev).where(f"{key} IS NOT NULL")


def drained(spark, make):
    run = Replay(spark)
    return run.drain(make(run.ticks))


@pytest.fixture(scope="module")
def shuffled(files, tmp_path_factory):
    """The same events: files in another order, rows dealt among neighbouring files."""
    import os
    import shutil
    import time

    root = str(tmp_path_factory.mktemp("shuffled"))
    for place, part in enumerate([2, 0, 1, 5, 3, 4]):
        shutil.copy(f"{files[0]}/events-{part}.parquet", f"{root}/events-{part}.parquet")
        os.utime(f"{root}/events-{part}.parquet", (time.time() - 100 + place,) * 2)
    return root, files[1]


@pytest.fixture(params=["files", "shuffled"])
def feed(request):
    """Files in order and out of order; three files span 50 minutes."""
    return request.getfixturevalue(request.param)


def test_dedup(spark, feed):
    keyed = lambda ev: requests_of(ev, "author_id").select("request_id", "ts", F.col("author_id").alias("who"))
    got = drained(spark, lambda ticks: stateful.stream_dedup(keyed(stream(spark, feed)), ["who"], 40, lateness="1 hour", ticks=ticks))
    want = folds.ttl_dedup(keyed(feed[1]), ["who"], 40).where("kept").select("who", "request_id", "ts", F.lit("kept"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rate_limit(spark, feed):
    keyed = lambda ev: requests_of(ev, "author_id")
    got = drained(spark, lambda ticks: stateful.stream_rate_limit(keyed(stream(spark, feed)), ["author_id"], 2, 60, lateness="1 hour", ticks=ticks))
    want = folds.rate_limit(keyed(feed[1]), ["author_id"], 2, 60)
    assert {tuple(r) for r in got.collect()} == {(r.request_id, "allowed" if r.allowed else "denied") for r in want.collect()}


def test_debounce(spark, feed):
    got = drained(spark, lambda ticks: stateful.stream_progress_debounce(
        views.shape_progress(stream(spark, feed)), 20, idle_s=10_000, lateness="1 hour", ticks=ticks))
    want = folds.progress_debounce(views.shape_progress(feed[1]), 20)
    shape = lambda df: sorted((r.job, r.seq, r.stage, r.done, r.total, r.flushed) for r in df.collect())
    assert shape(got.withColumn("flushed", F.expr("decision = 'flushed'"))) == shape(want)


def write_rows(spark, root, number, rows, schema):
    import glob
    import os
    import shutil
    import time

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/new{number}")
    shutil.copy(glob.glob(f"{root}/new{number}/*.parquet")[0], f"{root}/in-{number}.parquet")
    os.utime(f"{root}/in-{number}.parquet", (time.time() - 100 + number,) * 2)


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def folder_stream(spark, root, schema):
    return spark.readStream.schema(schema).option("pathGlobFilter", "in-*.parquet").option("maxFilesPerTrigger", 1).parquet(root)


def test_late_rows_are_told(spark, tmp_path):
    """What comes after the watermark takes no part and vanishes nowhere; nothing is decided before its time."""
    schema, root = "request_id bigint, who string, ts timestamp", str(tmp_path)
    batches = [[(1, "a", at(100)), (2, "a", at(90)), (3, "b", at(100))], [(4, "a", at(500))], [(5, "a", at(95)), (6, "c", at(100)), (7, "a", at(480))]]
    for number, rows in enumerate(batches):
        write_rows(spark, root, number, rows, schema)
    run = Replay(spark)
    made = stateful.stream_rate_limit(folder_stream(spark, root, schema), ["who"], 1, 60, lateness="60 seconds", ticks=run.ticks)
    early = {tuple(r) for r in run.drain(made, close=False).collect()}
    assert early == {(2, "allowed"), (1, "denied"), (3, "allowed"), (5, "late"), (6, "late")}
    run.tick("2024-01-01 00:09:30")  # time goes on without events: 570 less 60 is beyond 500
    assert {tuple(r) for r in run.drain(made, close=False).collect()} - early == {(7, "allowed"), (4, "denied")}
    assert run.drain(made).count() == 7
    run = Replay(spark)
    kept = run.drain(stateful.stream_dedup(folder_stream(spark, root, schema), ["who"], 50, lateness="60 seconds", ticks=run.ticks))
    assert {(r.request_id, r.decision) for r in kept.collect()} == {(2, "kept"), (3, "kept"), (7, "kept"), (5, "late"), (6, "late")}


def test_ends_and_idle_jobs(spark, tmp_path):
    """A job's end row flushes what is held, a timer does where none comes; later rows begin anew."""
    schema, root = "job bigint, seq bigint, ts timestamp, stage string, done bigint, total bigint, ends boolean", str(tmp_path)
    row = lambda job, seq, sec, done, ends=False: (job, seq, at(sec), "transcoding", done, 9, ends)
    batches = [
        [row(1, 1, 10, 1), row(1, 2, 11, 2), row(2, 3, 10, 1), row(2, 4, 12, 2)],
        [row(1, 5, 13, 3, True), row(1, 6, 14, 4), row(3, 7, 14, 9), row(4, 8, 14, 1), row(4, 9, 15, 1)],
        [row(2, 10, 500, 5), row(2, 11, 501, 6)],
    ]
    want = {
        (1, 1, 1, "shown"), (1, 5, 3, "flushed"), (1, 6, 4, "shown"), (2, 3, 1, "shown"), (2, 4, 2, "flushed"),
        (2, 10, 5, "shown"), (2, 11, 6, "flushed"), (3, 7, 9, "shown"), (4, 8, 1, "shown"),
    }
    for number, rows in enumerate(batches):
        write_rows(spark, root, number, rows, schema)
    for lateness in ("1 second", "1 hour"):  # the timer goes off between batches, or all is decided at the end
        run = Replay(spark)
        made = stateful.stream_progress_debounce(folder_stream(spark, root, schema), 30, idle_s=100, lateness=lateness, ticks=run.ticks)
        if lateness == "1 second":
            assert {r.decision for r in run.drain(made, close=False).where("job = 2 AND seq < 10").collect()} == {"shown", "flushed"}
        assert {(r.job, r.seq, r.done, r.decision) for r in run.drain(made).collect()} == want


def test_rollups(spark, files):
    from clipledger.operators import metrics

    totals = rollups.stream_run_totals(views.shape_jobs(stream(spark, files))).first()
    assert tuple(totals) == tuple(metrics.run_totals(views.shape_jobs(files[1])).first())
    counts = rollups.stream_error_counts(views.shape_failures(stream(spark, files)))
    assert sorted(counts.collect()) == sorted(metrics.error_category_counts(views.shape_failures(files[1])).collect())
    store = rollups.stream_store_upsert(views.shape_processed_writes(stream(spark, files)))
    want = dedup_store_upsert(None, views.shape_processed_writes(files[1]))
    assert sorted(store.collect()) == sorted(want.collect())


def test_stage_window(spark, files):
    from clipledger.operators import metrics

    got = rollups.stream_stage_window(views.shape_stage_runs(stream(spark, files)), "60 seconds", "5 minutes")
    want = metrics.stage_window(views.shape_stage_runs(files[1]), 60)
    key = lambda df: sorted((r.window_start_s, r.stage, r.avg_ms, r.samples) for r in df.collect())
    assert key(got) == key(want)


class CountedState:
    """A key's state that counts calls and the rows handed over in them."""

    def __init__(self):
        self.calls = self.rows = 0

    def getListState(self, name, schema):
        return CountedVariable(self, [])

    def getValueState(self, name, schema):
        return CountedVariable(self, None)

    def registerTimer(self, ms):
        self.calls += 1

    deleteTimer = registerTimer


class CountedVariable:
    def __init__(self, state, empty):
        self.state, self.empty, self.held = state, empty, empty

    def _call(self, rows, held):
        self.state.calls, self.state.rows, self.held = self.state.calls + 1, self.state.rows + rows, held

    def exists(self):
        self._call(0, self.held)
        return self.held != self.empty

    def get(self):
        self._call(len(self.held) if isinstance(self.held, list) else int(self.held is not None), self.held)
        return iter(self.held) if isinstance(self.held, list) else self.held

    def update(self, value):
        self._call(1, value)

    def appendValue(self, value):
        self._call(1, [*self.held, value])

    def appendList(self, values):
        self._call(len(values), [*self.held, *values])

    def put(self, values):
        self._call(len(values), list(values))

    def clear(self):
        self._call(0, self.empty)


def test_rows_reach_the_state_together():
    """However many rows of a job come at once, its state takes them in a few round trips and rows."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import TimerValues

    state, n = CountedState(), 60
    job = stateful._Debounce(["job"], "seq", "bigint", 20, 100)
    job.init(state)
    rows = pd.DataFrame({"job": 7, "seq": range(n), "note": [f"w-{i}" for i in range(n)], "tick": False,
                         "at": [i * 1_000_000 for i in range(n)], "at_sec": range(n)})
    assert not list(job.handleInputRows((7,), iter([rows]), TimerValues(0, 0)))
    (some,) = job.handleExpiredTimer((7,), TimerValues(0, 30_000), None)
    (rest,) = job.handleExpiredTimer((7,), TimerValues(0, 10**9), None)
    assert [tuple(r) for r in some.itertuples(index=False)] == [(7, s, s * 1_000_000, str(s), "shown") for s in (0, 20)]
    told = [(s, "shown") for s in (40,)] + [(n - 1, "flushed")]
    assert [tuple(r) for r in rest.itertuples(index=False)] == [(7, s, s * 1_000_000, str(s), d) for s, d in told]
    assert state.calls <= 15
    assert state.rows <= 8
