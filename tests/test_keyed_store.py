"""The store on disk against a plain dictionary, and what an update reads and writes."""

import random

import pytest

from clipledger.sources.keyed_store import KeyedStore
from clipledger.sources.stores import dedup_store_prune, dedup_store_upsert

SCHEMA = "scope_id bigint, tweet_id bigint, ts bigint, batch_no bigint"
HOUR = 3600


def writes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(store):
    return {(r.scope_id, r.tweet_id): r.ts for r in store.read().collect()}


def fresh(spark, path, **layout):
    return KeyedStore(spark, str(path), **({"n_parts": 8, "bucket_s": HOUR} | layout))


def test_random_updates(spark, tmp_path):
    rnd, plain, store = random.Random(1), {}, fresh(spark, tmp_path)
    for step in range(6):
        rows = [(rnd.randrange(4), rnd.choice([None, *range(12)]), rnd.randrange(12) * 1000, b) for b in range(rnd.randrange(1, 25))]
        store.upsert(writes(spark, rows))
        for scope, tweet, ts, _ in rows:
            plain[scope, tweet] = ts
        assert content(store) == plain
        if step % 3 == 2:
            now, ttl, n = 10_000, 4_000, 5
            dead = sorted((k for k, ts in plain.items() if now - ts > ttl), key=lambda k: (k[0], k[1] is not None, k[1]))[:n]
            assert {tuple(r) for r in store.prune(now, ttl, n).collect()} == set(dead)
            for k in dead:
                del plain[k]
            assert content(store) == plain == content(KeyedStore(spark, str(tmp_path)))
            assert {tuple(r) for r in store.live(now, ttl).collect()} == {k for k, ts in plain.items() if now - ts <= ttl}


def test_one_key_rewrites_one_part(spark, tmp_path):
    store = fresh(spark, tmp_path)
    store.upsert(writes(spark, [(1, i, i * 60, 0) for i in range(300)]))
    before = store.cells(store.last())
    store.upsert(writes(spark, [(1, 7, 100 * HOUR, 1)]))
    after = store.cells(store.last())
    moved = {c for c in before.keys() | after.keys() if before.get(c) != after.get(c)}
    assert len({part for part, _ in moved}) == 1 and len(moved) == 2  # the cell the key left and the one it entered
    assert content(store)[1, 7] == 100 * HOUR and len(content(store)) == 300


def test_repeated_batch(spark, tmp_path):
    """A batch that is run again, after its cells were written or after its manifest was, changes nothing."""
    store = fresh(spark, tmp_path)
    store.upsert(writes(spark, [(1, 1, 10, 0), (1, 2, 20, 0)]), 0)
    for _ in range(2):
        store.upsert(writes(spark, [(1, 1, 5 * HOUR, 1)]), 1)
        assert content(store) == {(1, 1): 5 * HOUR, (1, 2): 20}
    real, store._commit = store._commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        store.upsert(writes(spark, [(1, 2, 7 * HOUR, 2)]), 2)
    assert content(store) == {(1, 1): 5 * HOUR, (1, 2): 20}  # readers see nothing of half an update
    store._commit = real
    store.upsert(writes(spark, [(1, 2, 7 * HOUR, 2)]), 2)
    assert content(store) == {(1, 1): 5 * HOUR, (1, 2): 7 * HOUR}


def test_prune_reads_expired_buckets(spark, tmp_path):
    store = fresh(spark, tmp_path, n_parts=2)
    rows = [(i % 3, i, i * 100, 0) for i in range(1000)]  # 28 hours
    store.upsert(writes(spark, rows))
    now, ttl = 100_000, 100_000 - 2 * HOUR - 500
    read = store.expired(now, ttl).inputFiles()
    assert read and {f.split("bucket=")[1].split("/")[0] for f in read} == {"0", "1", "2"}
    flat = dedup_store_upsert(None, writes(spark, rows))
    want = {tuple(r) for r in dedup_store_prune(flat, now, ttl, 20).collect()}
    before = store.cells(store.last())
    assert {tuple(r) for r in store.prune(now, ttl, 20).collect()} == want and len(want) == 20
    after = store.cells(store.last())
    assert all(b <= 2 for (_, b) in before if before[_, b] != after.get((_, b)))


def test_vacuum(spark, tmp_path):
    store = fresh(spark, tmp_path, n_parts=1, bucket_s=10**9)
    for i in range(5):
        store.upsert(writes(spark, [(1, i, i, 0)]))
    assert store.vacuum(2) == [0, 1, 2] and store.versions() == [3, 4]
    assert len(content(store)) == 5
