"""Operators whose cost must not grow faster than their input."""

import datetime as dt
import re

from pyspark.sql import functions as F

from clipledger.operators import chunks, folds, sequences

T0 = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sliding_audit_adds_each_count_once(spark):
    """A frame that slides is summed anew at every row; rows at the edges of buckets, repeats and nulls are counted alike."""
    secs = [0, 0, 1, 3600, 3601, 82_800, 82_801, 86_399, 86_400, 86_401, 90_000, 172_800, 176_400]
    rows = [(key, T0 + dt.timedelta(seconds=s)) for key in ("a", None) for s in secs] + [("a", None)]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    made = folds.sliding_rate_audit(df, ["key"], 2, 3600)
    frames = re.findall(r"specifiedwindowframe\((\w+), ([^,]+),", plan_of(made))
    assert frames and all(low.strip() == "unboundedpreceding$()" for _, low in frames)
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = {(r.key, r.ts_s - base): (r.n_trailing, r.over) for r in made.collect()}
    counts = {s: sum(1 for x in secs if s - 3600 < x <= s) for s in secs}
    assert got == {(key, s): (n, n > 2) for key in ("a", None) for s, n in counts.items()}


def test_window_chunks_follow_the_rows(spark, monkeypatch):
    """No task holds more than one chunk, and chunks do not grow with the input."""
    monkeypatch.setattr(chunks, "CHUNK_ROWS", 50)
    rows = [("all", i // 3, i, 1 if i % 3 else -1) for i in range(400)]
    df = spark.createDataFrame(rows, "scope string, at_us bigint, seq bigint, delta bigint")
    made = sequences.queue_depth_timeline(df)
    held = made.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(held) > 4 and max(r["count"] for r in held) < 200
    assert "hashpartitioning(_chunk" not in made._jdf.queryExecution().executedPlan().toString()
    depth, want = 0, {}
    for _, _, seq, delta in rows:
        want[seq] = depth = max(depth + delta, 0)
    assert {r.seq: r.depth for r in made.collect()} == want


def test_cascade_searches_a_text_once(spark, monkeypatch):
    plans = []

    def noted(df):
        plans.append(plan_of(df))
        return df

    monkeypatch.setattr(folds, "durable", noted)
    link = "https://x.com/u/status/"
    texts = [None, "", link + "1", f"{link}2 {link}3", f"{link}99999999999999999999 {link}4", link + "٣"]
    rows = [(i, T0, i, i, T0, True, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id bigint, ts timestamp, author_id bigint, channel_id bigint, end_ts timestamp, ok boolean, content string")
    got = {r.request_id: r.decision for r in folds.admission_cascade(df).collect()}
    assert [got[i] for i in range(len(texts))] == ["missing_url", "no_link", "accepted", "many_links", "accepted", "no_link"]
    assert plans[0].count("regexp_extract_all") == 1
