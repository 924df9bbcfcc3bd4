import math
import random
import re
from collections import Counter

import numpy as np

from clipledger.llm import queries as Q
from clipledger.llm import ranked_search as R

from . import odd

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(words(t))) for i, t in docs if i is not None]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    N, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * N) // total
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_terms():
    text = "".join(map(chr, range(0x2ff))) + "Ünï ÇODE İx 日本語-ab_c9\x7fz"
    assert [t.decode() for t in R.terms_of(text)] == words(text) and R.terms_of(None) == []


def make(rnd, n_docs, n_words, longest):
    word = lambda: f"w{min(int(rnd.expovariate(0.08)), n_words)}"
    return [(i, " ".join(word() for _ in range(rnd.randrange(longest)))) for i in range(n_docs)]


def shard_of(docs, vocabulary):
    """A shard, and its weights, straight from texts."""
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    df = Counter(t for _, c, _ in held for t in c)
    weight = np.array([0] + [math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) for t in vocabulary], np.int64)
    rows = [sorted((vocabulary[t], x) for t, x in c.items() if t in vocabulary) for _, c, _ in held]
    parts = [(np.array([i for i, _, _ in held]), np.array([n for _, _, n in held]), np.array([len(r) for r in rows]),
              np.array([t for r in rows for t, _ in r], np.int64), np.array([x for r in rows for _, x in r], np.int64))]
    return R.Shard(parts, weight, len(held), sum(n for _, _, n in held))


def test_shard():
    """Whatever k and the least score, the same as all scores; ties at the k-th place go by id."""
    rnd = random.Random(2)
    for trial in range(30):
        docs = make(rnd, rnd.randrange(1, 300), 60, 25)
        docs += [(1000 + i, t) for i, t in docs[:50]]  # the same texts again: equal scores
        vocabulary = {f"w{i}": i + 1 for i in range(61)}
        shard = shard_of(docs, vocabulary)
        for _ in range(6):
            asked = rnd.sample(sorted(vocabulary), rnd.randrange(0, 9))
            k, least = rnd.choice([1, 3, 10]), 1
            want = [(r[2], r[3]) for r in brute(docs, [(0, " ".join(asked))], k)]
            for least in (1, want[-1][1] if want else 1):
                ids, scores = shard.best(np.array([vocabulary[t] for t in asked], np.int64), k, least)
                found = sorted(zip((-scores).tolist(), ids.tolist()))[:k]
                assert [(i, -s) for s, i in found if -s >= least] == [w for w in want if w[1] >= least], trial
            assert not shard.seen.any() and not shard.wanted.any()


def test_stops_early():
    """Far fewer documents are looked up than the lists hold, where impacts fall steeply; positions seen by lookups count."""
    docs = [(i, "rare common " + "filler " * (i + 1)) for i in range(5000)]
    shard = shard_of(docs + [(9000 + i, "filler") for i in range(20_000)], {"rare": 1, "common": 2})
    ids, _ = shard.best(np.array([1, 2]), 10, 1)
    assert sorted(ids.tolist()) == list(range(10)) and shard.accessed < 200


def test_search(spark, monkeypatch):
    rnd = random.Random(4)
    docs = make(rnd, 400, 80, 40) + [(500, None), (501, "..."), (None, "w1 w2 w3"), (3, "w1 w1 w2"), (3, "w1 w1 w2")]
    items = [(i, t) for i, t in make(rnd, 12, 80, 9)] + [(None, "w1"), (20, None), (21, "w2 w3"), (21, "W3 w4 zzz"), (22, "zzz")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(R.search(df, asked)) == want
    monkeypatch.setattr(R, "BLOCK_TERMS", 7)
    assert got(R.search(df, asked)) == want
    assert got(R.search(df, asked.limit(0))) == [] == got(R.search(df.limit(0), asked.limit(3)))


def test_odd_rows(spark):
    df = odd.frame(spark)
    items = df.withColumn("item_id", df.doc_id + 100)
    docs = [(r[0], r[1]) for r in odd.rows()]
    want = brute(docs, [(None if i is None else i + 100, t) for i, t in docs])
    assert got(R.search(df, items)) == want


def test_query(spark, small):
    rows = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{small}/{name}.parquet").select(key, "text").collect()]
    assert got(Q.op11_best_position_search(spark, small)) == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"))
