"""Ordered operators against plain loops, with one key holding most rows and several chunk counts."""

import copy
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clipledger.config import DEFAULTS, MIB
from clipledger.operators import folds, sequences
from clipledger.operators.chunks import ordinal

T0 = dt.datetime(2024, 1, 1)
CHUNKS = [None, 1, 4, 17]


def log(seed, n=400, span=4000, keys=5):
    """(key, second, id) in time order; key 0 has two thirds of the rows and seconds repeat."""
    rnd = random.Random(seed)
    secs = sorted(rnd.randrange(span) for _ in range(n))
    return [(0 if rnd.random() < 0.66 else rnd.randrange(1, keys), s, i) for i, s in enumerate(secs)]


def frame(spark, rows, extra="", values=()):
    data = [(k, T0 + dt.timedelta(seconds=s), i, *v) for (k, s, i), v in zip(rows, values or [()] * len(rows))]
    df = spark.createDataFrame(data, "key bigint, ts timestamp, request_id bigint" + extra)
    return df.repartition(3)


def result(df, column):
    return {r.request_id: r[column] for r in df.collect()}


@pytest.mark.parametrize("n", CHUNKS)
def test_ttl_dedup(spark, n):
    rows, kept, want = log(1), {}, {}
    for k, s, i in rows:
        want[i] = k not in kept or s - kept[k] > 50
        if want[i]:
            kept[k] = s
    assert result(folds.ttl_dedup(frame(spark, rows), ["key"], 50, n_chunks=n), "kept") == want


@pytest.mark.parametrize("n", CHUNKS)
def test_rate_limit(spark, n):
    rows, state, want = log(2, span=1500), {}, {}
    for k, s, i in rows:
        a, used = state.get(k, (None, 0))
        if a is None or s - a >= 60:
            a, used = s, 0
        want[i] = used < 3
        state[k] = (a, used + want[i])
    assert result(folds.rate_limit(frame(spark, rows), ["key"], 3, 60, n_chunks=n), "allowed") == want


def test_rate_limit_small_cases(spark):
    rows = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 2, 3), (1, 60, 4)]
    assert result(folds.rate_limit(frame(spark, rows), ["key"], 2, 60), "allowed") == {0: True, 1: True, 2: False, 3: True, 4: True}
    assert all(result(folds.rate_limit(frame(spark, rows), ["key"], 0, 60), "allowed").values())


def walk_inflight(rows, ends, ttl, inflight):
    state, want = {}, {}
    for (k, s, i), (e, ok) in zip(rows, ends):
        running, done, todo = state.get(k, (None, None, []))
        for at, good in sorted(x for x in todo if x[0] <= s):
            running = None
            done = at + ttl if good else done
        todo = [x for x in todo if x[0] > s]
        want[i] = not ((running is not None and s < running) or (done is not None and s <= done))
        if want[i]:
            running, todo = s + inflight, [*todo, (e, ok)]
        state[k] = (running, done, todo)
    return want


@pytest.mark.parametrize("n", CHUNKS)
def test_inflight_dedup(spark, n):
    rows, rnd = log(3, span=2500), random.Random(4)
    ends = [(s + rnd.choice([0, 0, 5, 30, 200]), rnd.random() < 0.4) for _, s, _ in rows]
    values = [(T0 + dt.timedelta(seconds=e), ok) for e, ok in ends]
    df = frame(spark, rows, ", end_ts timestamp, ok boolean", values)
    got = result(folds.inflight_dedup(df, ["key"], 40, 60, n_chunks=n), "accepted")
    assert got == walk_inflight(rows, ends, 40, 60)


def test_inflight_ttl():
    from dataclasses import replace

    assert replace(DEFAULTS, download_timeout_s=10, encode_timeout_s=120, upload_timeout_s=20).inflight_ttl_s == 300
    assert replace(DEFAULTS, download_timeout_s=300, encode_timeout_s=120, upload_timeout_s=120).inflight_ttl_s == 600
    assert DEFAULTS.inflight_ttl_s == 1260


@pytest.mark.parametrize("n", [None, 7])
def test_resolver_cache(spark, n):
    rows, rnd, pos, neg, want = log(5, span=3000), random.Random(6), {}, {}, {}
    kinds = [rnd.choice(["ok", "durable", "transient"]) for _ in rows]
    for (k, s, i), kind in zip(rows, kinds):
        if s < neg.get(k, -1):
            want[i] = "negative_hit"
        elif s < pos.get(k, -1):
            want[i] = "positive_hit"
        else:
            want[i] = "miss"
            if kind == "ok":
                pos[k] = s + 30
            elif kind == "durable":
                neg[k] = s + 20
    text = {"ok": None, "durable": "post not found", "transient": "timed out"}
    values = [(kind == "ok", text[kind]) for kind in kinds]
    df = frame(spark, rows, ", primary_ok boolean, fallback_error string", values).withColumnRenamed("key", "tweet_id")
    df = df.select(
        "*", F.lit(False).alias("fallback_ok"), F.lit("process_failed").alias("fallback_kind"),
        F.lit("http_status").alias("primary_kind"), F.lit(503).alias("primary_status"), F.lit("x").alias("primary_error"),
    )
    got = folds.resolver_cache_labels(df, positive_ttl_s=30, negative_ttl_s=20, n_chunks=n)
    assert result(got, "label") == want


def progress_walk(rows, said, wait):
    out, last, sent, held = [], {}, {}, {}
    for (k, s, i), (stage, done, total) in zip(rows, said):
        unfinished = stage == "transcoding" and done < total
        if not unfinished or k not in last or s - last[k] >= wait:
            out.append((k, i, False))
            last[k], sent[k] = s, (stage, done, total)
            held.pop(k, None)
        else:
            held[k] = (i, (stage, done, total))
    return sorted(out + [(k, i, True) for k, (i, what) in held.items() if what != sent[k]])


@pytest.mark.parametrize("n", [None, 9])
def test_progress_debounce(spark, n):
    rows, rnd = log(7), random.Random(8)
    said = [rnd.choice([("transcoding", d, 4) for d in range(5)] * 3 + [("uploading", None, None)]) for _ in rows]
    df = frame(spark, rows, ", stage string, done bigint, total bigint", said)
    df = df.withColumnRenamed("key", "job").withColumnRenamed("request_id", "seq")
    got = sorted((r.job, r.seq, r.flushed) for r in folds.progress_debounce(df, 3, n_chunks=n).collect())
    assert got == progress_walk(rows, said, 3)


def test_sliding_audit(spark):
    rows = log(10, span=200_000)
    got = {(r.key, r.ts_s): (r.n_trailing, r.over) for r in folds.sliding_rate_audit(frame(spark, rows), ["key"], 30, 7200).collect()}
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    for k, s, _ in rows:
        n = sum(1 for k2, s2, _ in rows if k2 == k and s - 7200 < s2 <= s)
        assert got[(k, base + s)] == (n, n > 30)


@pytest.mark.parametrize("n", CHUNKS)
def test_ordinal(spark, n):
    rows = log(11)
    got = ordinal(frame(spark, rows), ["key"], ["request_id"], n_chunks=n).collect()
    seen = {}
    for k, _, i in rows:
        seen[k] = seen.get(k, 0) + 1
        assert next(r.rn for r in got if r.request_id == i) == seen[k]


@pytest.mark.parametrize("n", CHUNKS)
def test_queue_depth(spark, n):
    rnd = random.Random(12)
    moves = [(i // 3, i, rnd.choice([1, 1, -1, -1, -1] if i % 100 < 50 else [1, 1, 1, -1])) for i in range(400)]
    df = spark.createDataFrame([("all", *m) for m in moves], "scope string, at_us bigint, seq bigint, delta bigint")
    got = {r.seq: (r.depth, r.peak, r.warn) for r in sequences.queue_depth_timeline(df.repartition(3), warn_at=20, n_chunks=n).collect()}
    depth = peak = 0
    for _, seq, delta in moves:
        depth = max(depth + delta, 0)
        peak = max(peak, depth)
        assert got[seq] == (depth, peak, depth >= 20)


def test_queue_cancel(spark):
    df = spark.createDataFrame([("all", 1, 1, 1), ("all", 2, 2, -1)], "scope string, at_us bigint, seq bigint, delta bigint")
    last = sequences.queue_peak(sequences.queue_depth_timeline(df)).first()
    assert (last.depth_now, last.peak) == (0, 1)


@pytest.mark.parametrize("n", CHUNKS)
def test_streaks(spark, n):
    rnd = random.Random(13)
    rows = [(0 if rnd.random() < 0.7 else 1, i, rnd.random() < 0.35) for i in range(400)]
    df = spark.createDataFrame(rows, "src bigint, seq bigint, ok boolean").repartition(3)
    got = {r.seq: (r.streak, r.backoff_s, r.disabled) for r in sequences.failure_streaks(df, disable_at=9, n_chunks=n).collect()}
    run, off = {}, {}
    for src, seq, ok in rows:
        run[src] = 0 if ok else run.get(src, 0) + 1
        off[src] = off.get(src, False) or run[src] >= 9
        assert got[seq] == (run[src], min(2 ** min(run[src] - 1, 8), 300) if run[src] else 0, off[src])


@pytest.mark.parametrize("n", [None, 6])
def test_clock_repair(spark, n):
    rnd = random.Random(14)
    rows = [(rnd.choice([0, 0, 0, 1]), i, i * 10 - rnd.choice([0, 0, 30, 200])) for i in range(300)]
    df = spark.createDataFrame(rows, "src bigint, arrival bigint, ts bigint").repartition(3)
    got = {r.arrival: (r.ts_fixed, r.skewed) for r in sequences.clock_repair(df, source="src", arrival="arrival", ts="ts", n_chunks=n).collect()}
    top = {}
    for src, arrival, ts in rows:
        top[src] = max(top.get(src, ts), ts)
        assert got[arrival] == (top[src], ts + 60 < top[src])


@pytest.mark.parametrize("n", [None, 5])
def test_concurrency(spark, n):
    rnd = random.Random(15)
    spans = [("upload", s, s + rnd.randrange(1, 40)) for s in (rnd.randrange(1000) for _ in range(100))]
    df = spark.createDataFrame(spans, "stage string, start_ms bigint, end_ms bigint")
    got = {r.stage: r for r in sequences.concurrency_in_use(df, n_chunks=n).collect()}
    level = [sum(1 for _, a, b in spans if a <= t < b) for t in range(1100)]
    assert (got["upload"].peak, got["upload"].ms_at_limit) == (max(level), sum(x >= 2 for x in level))
    assert (got["pipeline"].peak, got["pipeline"].limit) == (0, 8)


def test_fallback_latch(spark):
    rows = [(0, "a", 0, "nvenc", None), (1, "a", 1, "nvenc", "CUDA lost"), (2, "a", 2, "nvenc", "cuda again"), (3, "a", 3, "nvenc", None),
            (4, "b", 0, "none", "nvenc"), (5, "b", 1, "none", None), (6, "c", 0, "vaapi", "muxer"), (7, "c", 1, "vaapi", None)]
    df = spark.createDataFrame(rows, "attempt_id int, src string, seq int, backend string, stderr string")
    got = {r.attempt_id: (r.active_backend, r.concurrency, r.transitions) for r in sequences.fallback_latch(df).collect()}
    assert got[1] == ("nvenc", 2, 0) and got[2] == got[3] == ("none", 1, 1)
    assert got[5] == ("none", 2, 0) and got[7] == ("vaapi", 2, 0)


@pytest.mark.parametrize("parts,size,messages", [(1, MIB, 1), (10, MIB, 1), (11, MIB, 2), (23, MIB, 3), (5, 8 * MIB, 5), (2, 9 * MIB, 1)])
def test_upload_batches(spark, parts, size, messages):
    df = spark.createDataFrame([(7, p * 10, size, "mp4") for p in range(parts)], "job bigint, pos bigint, size bigint, ext string")
    batches = sequences.upload_batches(df)
    got = sequences.upload_batch_summary(batches).first()
    assert (got.parts, got.messages, got.too_large) == (parts, messages, parts if size > 8 * MIB else 0)
    names = {r.name for r in batches.collect()}
    assert ("tweet_7.mp4" in names) == (parts == 1) and ("tweet_7_part1.mp4" in names) == (parts > 1)


@pytest.mark.parametrize("fold", [
    folds._AnchorFold(7), folds._WindowQuotaFold(3, 9), folds._ResolverCacheFold(8, 3), folds._DebounceFold(5), folds._DebounceFold(0),
], ids=lambda f: type(f).__name__)
def test_exit_tables_are_the_fold(fold):
    """Entering a chunk with any state a fold can be in gives what running the rows gives."""
    import json

    from clipledger.operators.chunks import exit_state, exit_table

    rnd = random.Random(3)
    rows, sec = [], 0
    for _ in range(1500):
        sec += rnd.choice([1, 1, 2, 3, 12])
        rows.append({
            folds._AnchorFold: (sec,), folds._WindowQuotaFold: (sec, rnd.randrange(1, 4)),
            folds._ResolverCacheFold: (sec, rnd.choice(["positive", "negative", None])), folds._DebounceFold: (sec, rnd.random() < 0.1),
        }[type(fold)])
    for size in (1, 2, 5, 40):
        state, k = fold.start(), 0
        while k < len(rows):
            chunk = rows[k : k + size]
            table = json.loads(json.dumps(exit_table(fold, chunk)))
            want = state
            for r in chunk:
                want, _ = fold.step(want, *r)
            got = exit_state(fold, table, state)
            alike = lambda s: None if s is None or fold.lapse(s) is None or fold.lapse(s) <= chunk[-1][0] + 1 else s  # noqa: E731, B023
            assert alike(got) == alike(want) or list(filter(None, got)) == list(filter(None, want))
            state, k = want, k + size


@pytest.mark.parametrize("fold,row", [
    (folds._AnchorFold(7), lambda t: (t,)), (folds._WindowQuotaFold(3, 9), lambda t: (t, 1)),
    (folds._ResolverCacheFold(8, 3), lambda t: (t, "positive")), (folds._DebounceFold(5), lambda t: (t, False)),
], ids=lambda x: type(x).__name__)
def test_exit_tables_end_where_no_state_reaches(fold, row):
    from clipledger.operators.chunks import exit_table

    assert len(exit_table(fold, [row(t) for t in range(5000)])["times"]) <= fold.reach + 1


@pytest.mark.parametrize("ttl", [20, 100_000])
def test_driver_gets_one_state_a_chunk(spark, monkeypatch, ttl):
    """Whatever the time to live, tables of a hot key's chunks stay in Spark."""
    df = spark.range(4000).selectExpr("id AS request_id", "1L AS k", "timestamp_seconds(id * 3) AS ts")
    seen, kind = [], type(df)
    collect = kind.collect

    def spied(self):
        got = collect(self)
        seen.extend(len(str(r)) for r in got)
        return got

    with monkeypatch.context() as m:
        m.setattr(kind, "collect", spied)
        out = folds.ttl_dedup(df, ["k"], ttl, n_chunks=10)
    kept, anchor, want = {r.request_id for r in out.where("kept").collect()}, None, set()
    for i in range(4000):
        if anchor is None or 3 * i - anchor > ttl:
            anchor, want = 3 * i, want | {i}
    assert kept == want and seen and max(seen) < 200


def test_inflight_tables_are_the_fold():
    """Any chunk, entered with any jobs still to end, leaves a state that acts like that of running its rows."""
    rnd = random.Random(3)

    def settled(fold, state, last):
        running, done, ends = state
        for at, good in sorted(map(tuple, ends)):
            if at <= last:
                running, done = None, at + fold.ttl if good else done
        return (running if running is not None and last < running else None, done if done is not None and last <= done else None,
                sorted(tuple(e) for e in ends if e[0] > last))

    for _ in range(4000):
        fold = folds._InflightFold(rnd.choice([0, 3, 10]), rnd.choice([1, 4, 8]))
        secs = sorted(rnd.sample(range(60), rnd.randrange(2, 14)))
        rows = [(s, None if rnd.random() < 0.15 else s + rnd.choice([1, 2, 5, 20, 50]), rnd.random() < 0.5) for s in secs]
        cut, state = rnd.randrange(1, len(rows)), fold.start()
        for r in rows[:cut]:
            state, _ = fold.step(state, *r)
        want = state
        for r in rows[cut:]:
            want, _ = fold.step(want, *r)
        got = fold.enter(fold.table(rows[cut:]), state)
        assert settled(fold, got, rows[-1][0]) == settled(fold, want, rows[-1][0]), rows


def test_inflight_jobs_do_not_grow_with_chunks(spark):
    """Jobs that outlive their mark and hold a key over many chunks take no extra rounds."""
    rnd, tracker, seen = random.Random(8), spark.sparkContext.statusTracker(), []
    rows = [(1, 2 * i, i) for i in range(1500)]
    ends = [(s + rnd.choice([1, 30, 900]), rnd.random() < 0.3) for _, s, _ in rows]
    df = frame(spark, rows, ", end_ts timestamp, ok boolean", [(T0 + dt.timedelta(seconds=e), ok) for e, ok in ends])
    for n in (10, 40):
        spark.sparkContext.setJobGroup(f"inflight-{n}", "")
        assert result(folds.inflight_dedup(df, ["key"], 40, 60, n_chunks=n), "accepted") == walk_inflight(rows, ends, 40, 60)
        seen.append(len(tracker.getJobIdsForGroup(f"inflight-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(set(seen)) == 1


def test_short_keys_are_answered_in_columns():
    """Only islands that carry a state are stepped through; the answers are those of stepping through all."""
    import pyarrow as pa

    from clipledger.operators.chunks import CHUNK, _fold_task

    rnd = random.Random(6)
    for base, extra in [
        (folds._AnchorFold(50), {}), (folds._WindowQuotaFold(3, 50), {"_asked": lambda: rnd.randrange(1, 3)}),
        (folds._InflightFold(40, 50), {"_end": lambda: None, "_ok": lambda: None}),
        (folds._ResolverCacheFold(50, 30), {"_stores": lambda: rnd.choice(["positive", "negative", None])}),
        (folds._DebounceFold(50), {"_forced": lambda: rnd.random() < 0.3}),
    ]:
        rows = []
        for key in range(3000):
            sec, size = rnd.randrange(10_000), rnd.choice([1] * 150 + [2, 7])
            for _ in range(size):
                rows.append((key, sec))
                sec += rnd.choice([1, 20, 60, 500])
        columns = {"k": [k for k, _ in rows], folds.SEC: [t for _, t in rows], CHUNK: pa.array([4] * len(rows), pa.int32())}
        types = {"_asked": pa.int64(), "_end": pa.int64(), "_ok": pa.bool_(), "_stores": pa.string(), "_forced": pa.bool_()}
        columns |= {c: pa.array([make() for _ in rows], types[c]) for c, make in extra.items()}
        whole = pa.RecordBatch.from_pydict(columns)
        name, kind = base.outputs[0]
        arrow = {"boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string()}[kind.simpleString()]
        want, state, last = [], None, None
        for i, (key, _) in enumerate(rows):
            state = base.start() if key != last else state
            state, out = base.step(state, *(whole.column(c)[i].as_py() for c in base.inputs))
            want.append(out[0])
            last = key
        for size in (len(rows), 7, 1):
            steps, real = [0], type(base).step

            def step(self, *a, real=real, steps=steps):
                steps[0] += 1
                return real(self, *a)

            fold = copy.copy(base)
            fold.__class__ = type("Counted", (type(base),), {"step": step})
            parts = [whole.slice(a, size) for a in range(0, len(rows), size)]
            got = [x for b in _fold_task(fold, ["k"], {}, [arrow])(iter(parts)) for x in b.column(b.schema.get_field_index(name)).to_pylist()]
            assert got == want, type(base).__name__
            if size == len(rows):
                assert steps[0] < 0.1 * len(rows), (type(base).__name__, steps)


def test_jobs_do_not_grow_with_chunks(spark):
    df = spark.range(4000).selectExpr("id AS request_id", "1L AS k", "timestamp_seconds(id * 3) AS ts")
    seen, tracker = [], spark.sparkContext.statusTracker()
    for n in (10, 20, 40):
        spark.sparkContext.setJobGroup(f"fold-{n}", "")
        kept = {r.request_id for r in folds.ttl_dedup(df, ["k"], 1000, n_chunks=n).where("kept").collect()}
        seen.append(len(tracker.getJobIdsForGroup(f"fold-{n}")))
        anchor, want = None, set()
        for i in range(4000):
            if anchor is None or i * 3 - anchor > 1000:
                anchor = i * 3
                want.add(i)
        assert kept == want
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(set(seen)) == 1


def test_no_wait_shows_every_row(spark):
    rows = [(1, i, T0, "transcoding", i, 9) for i in range(4)]
    df = spark.createDataFrame(rows, "job long, seq long, ts timestamp, stage string, done long, total long")
    got = folds.progress_debounce(df, 0).collect()
    assert sorted(r.seq for r in got) == [0, 1, 2, 3] and not any(r.flushed for r in got)
