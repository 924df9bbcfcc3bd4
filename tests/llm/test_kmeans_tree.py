import math
import random

import numpy as np

from clipledger.llm import kmeans_tree as K


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for i in ids:
        if i % 20 == 0:
            s = x @ good[i]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got(df, k):
    out = {}
    for r in sorted(K.nearest(df, "vec_id % 20 = 0", k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def check(rows, found, k, least):
    want = brute(rows, k)
    assert set(found) <= set(want)
    hit = n = 0
    for q, near in want.items():
        mine = dict(found.get(q, []))
        hit, n = hit + len(set(mine) & {i for i, _ in near}), n + len(near)
        exact = dict(near)
        assert all(abs(s - exact[i]) < 1e-9 for i, s in mine.items() if i in exact)
        scores = [s for _, s in found.get(q, [])]
        assert scores == sorted(scores, reverse=True)
    assert hit >= least * n


def test_tables(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    check([tuple(r)[:2] for r in df.collect()], got(df, 20), 20, 0.95)


def test_odd_rows(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) * (1 + 3 * (rng.random() < 0.1)) for _ in range(8)]
    same = [9 * x for x in vec()]
    rows = [(i, vec()) for i in range(200)] + [(i, same) for i in range(200, 320)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [float("inf")] * 8), (420, [None] + [1.0] * 7), (None, same), (440, [])]
    df = spark.createDataFrame([(i, v, i, 1) for i, v in rows], "vec_id long, embedding array<double>, score long, k int").unionByName(
        spark.createDataFrame([(5, rows[5][1], 5, 1)], "vec_id long, embedding array<double>, score long, k int"))
    found = got(df, 20)
    check(rows, found, 20, 0.95)
    alike = [i for i, _ in found[220] if i >= 200]  # ties go to smaller ids
    assert alike and alike == list(range(200, 200 + len(alike)))
    few = df.where("vec_id IN (0, 1, 2)")
    assert [i for i, _ in got(few, 20)[0]] == [i for i, _ in brute(rows[:3], 20)[0]]
    assert K.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert K.nearest(df.where("vec_id = 7"), "vec_id % 20 = 0").count() == 0


def test_lengths_have_lists_of_their_own(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6 if i % 3 else 4)]) for i in range(130)]
    found = got(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5)
    short, long = [r for r in rows if len(r[1]) == 4], [r for r in rows if len(r[1]) == 6]
    assert set(found) == {i for i, _ in rows if i % 20 == 0}
    for own in (short, long):
        check(own, {i: found[i] for i, _ in own if i in found}, 5, 0.95)


def test_best_bin_first_widens_to_all_leaves():
    x = np.random.default_rng(1).normal(size=(3000, 16))
    tree = K.fit(x, float((x**2).sum(1).max()))
    order = tree.visits(x[0], tree.leaves)
    assert sorted(order) == list(range(tree.leaves)) and tree.visits(x[0], 5) == order[:5]
    assert set(tree.assign(x)) <= set(order)


def test_a_query_goes_once_to_each_cell(spark, monkeypatch):
    """Rows of queries grow with cells, not with leaves; leaves of several cells and blocks of queries lose nothing."""
    rng = np.random.default_rng(8)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1200, 12)))] + [(1200 + i, (5 + x / 50).tolist()) for i, x in enumerate(rng.normal(size=(300, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole, seen, real = got(df, 20), {}, K.written

    def counted(frame, name):
        out = real(frame, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(K, "written", counted)
    check(rows, got(df, 20), 20, 0.95)
    assert seen["ann-visits"] <= 75 * (1500 // K.SMALL + 2)
    monkeypatch.setattr(K, "SMALL", 2)
    monkeypatch.setattr(K, "CELLS", 100)
    monkeypatch.setattr(K, "BLOCK", 16)
    parts = got(df, 20)
    assert {q: [i for i, _ in x] for q, x in parts.items()} == {q: [i for i, _ in x] for q, x in whole.items()}
