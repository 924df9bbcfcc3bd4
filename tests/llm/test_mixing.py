import random
from collections import Counter

import numpy as np
import pytest

from clipledger.llm import mixing as M

from . import odd


def sequence(blocks, weights, cycle=M.CYCLE):
    """The source of every slot, from the closed form; every slot is taken once and blocks go in order."""
    plan, out = M.schedule(blocks, weights, cycle), {}
    for s, n in blocks.items():
        slots = M.slots_of(plan[s], np.arange(n)) if n else np.zeros(0, int)
        assert (np.diff(slots) > 0).all()
        for t in slots.tolist():
            assert out.setdefault(t, s) == s
    assert sorted(out) == list(range(sum(blocks.values())))
    return [out[t] for t in sorted(out)]


@pytest.mark.parametrize("seed", range(12))
def test_less_than_one_block_of_deviation(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.random() + 0.01 for i in range(rng.randrange(1, 12))}
    blocks = {s: rng.randrange(1, 4000) for s in weights}
    order = sequence(blocks, weights)
    left, t0, sent = dict(blocks), 0, Counter()
    active = M.shares(weights, M.CYCLE)
    for t, s in enumerate(order):
        sent[s] += 1
        left[s] -= 1
        for x, n in active.items():
            assert abs(sent[x] - (t + 1 - t0) * n / sum(active.values())) < 1
        if not left[s]:  # the next phase starts where a source has run out
            break


def test_shares():
    assert M.shares({"a": 1, "b": 1, "c": 2}, 1000) == {"a": 250, "b": 250, "c": 500}
    assert sum(M.shares({i: 1e-9 if i else 1 for i in range(50)}, 60).values()) == 60


@pytest.mark.parametrize(("sizes", "cycle"), [
    ({"hot": 4_000_000} | {f"t{i}": 1 for i in range(10)}, 1000),
    ({f"h{i}": 25_600 for i in range(100)} | {f"t{i}": 100 for i in range(1900)}, 2000),
])
def test_hot_source_with_a_long_tail(sizes, cycle):
    """Rounding takes no slot from a source that has a single one."""
    weights = M.tempered_weights(sizes)
    slots = M.shares(weights, cycle)
    assert sum(slots.values()) == cycle and min(slots.values()) > 0
    blocks = {s: -(-min(n, 40_000) // M.BLOCK_ROWS) for s, n in sizes.items()}
    assert Counter(sequence(blocks, weights)) == blocks


@pytest.mark.parametrize("weights", [
    {"a": 1, "b": 1, "c": 1},
    {"hot": 9970, "rare": 15, "rarer": 7, "x": 8},
    {f"s{i}": i * i + 1 for i in range(40)},
])
def test_true_weights_over_many_cycles(weights):
    """Against the weights themselves, in whole numbers: less than one block however long the run."""
    n, total = 300_000, sum(weights.values())
    plan = M.schedule({s: n * w // total for s, w in weights.items()}, weights)
    end = min(int(x[-1]) + 1 for x in plan.values())  # the first source has run out
    assert end > 200 * M.CYCLE
    t = np.arange(1, end + 1)
    for s, w in weights.items():
        sent = np.searchsorted(M.slots_of(plan[s], np.arange(n * w // total)), t)
        assert np.abs(sent * total - t * w).max() < total


def test_unweighted_go_last():
    order = sequence({"a": 5, "b": 7, "c": 3}, {"a": 1.0})
    assert order[:5] == ["a"] * 5 and Counter(order[5:]) == {"b": 7, "c": 3}
    assert sequence({}, {}) == []


def test_tables(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = M.interleaved(df, block_rows=4).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.select("doc_id").collect())
    assert sorted(r.place for r in rows) == list(range(len(rows)))
    sizes = Counter(r.source for r in df.select("source").collect())
    order = sequence({s: -(-n // 4) for s, n in sizes.items()}, M.tempered_weights(sizes))
    assert all(order[r.slot] == r.source for r in rows)
    size = Counter((r.source, r.block) for r in rows)
    assert all(n == (4 if b < sizes[s] // 4 else sizes[s] % 4) for (s, b), n in size.items())
    by_place = sorted(rows, key=lambda r: r.place)
    assert [r.slot for r in by_place] == sorted(r.slot for r in rows)


def test_odd_rows(spark):
    df = odd.frame(spark).selectExpr("*", "1 AS block", "2 AS slot", "3 AS place")
    rows = M.interleaved(df).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r[0], r[3]) for r in odd.rows())
    mixed = M.mixed_documents(df)
    assert mixed.columns == df.columns and Counter(mixed.collect()) == Counter(df.collect())
    assert M.interleaved(odd.empty(spark)).count() == 0 == M.mixed_documents(odd.empty(spark)).count()
