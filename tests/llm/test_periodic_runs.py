import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from clipledger.llm import periodic_runs as P
from clipledger.llm import queries as Q

from . import odd


def brute(words, least, times):
    """Every stretch that one period holds for, at every period; the smallest period of a stretch counts."""
    n, best = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i:
                best.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in best.items() if n >= max(least, times * p))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("least,times", [(6, 4), (1, 3), (12, 3)])
def test_diagonals(least, times):
    rnd = random.Random(least * times)
    for k in range(1500):
        n, letters = rnd.randrange(0, 70), rnd.choice([1, 2, 2, 3, 8])
        words = [rnd.randrange(letters) for _ in range(n)]
        if k % 2 and n:
            a, p = rnd.randrange(n), rnd.randrange(1, 9)
            words[a:] = [words[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
            if k % 4 == 1:
                words[rnd.randrange(n)] = 99
        got = P.diagonals(np.array(words, np.int64), least, times, n)
        assert list(zip(*(x.tolist() for x in got))) == brute(words, least, times), words


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        P.diagonals(np.zeros(4, np.int64), 1, 2, 4)


def operator(rows):
    out = Counter()
    for row in rows:
        if row[0] is not None:
            words = words_of(row[1])
            runs = brute(words, 6, 4)
            out[row[0], len(words), tuple(runs), collapsed(words, runs)] += 1
    return out


def test_odd_rows(spark):
    texts = ["one two " * 9, "a " * 400, "x y z " * 4 + "x y", "a a b " * 5 + "a a c", "\x1ca \x1c a\x85b é é é é é é", "q " * 5]
    extra = [(100 + i, t, None, None, None) for i, t in enumerate(texts)]
    df = odd.frame(spark).unionByName(spark.createDataFrame(extra, odd.SCHEMA), allowMissingColumns=True)
    small = df.where("length(text) < 5000 OR text IS NULL")
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in P.periodic_runs(small).collect())
    assert got == operator([r for r in [*odd.rows(), *extra] if len(r[1] or "") < 5000])
    long = P.periodic_runs(odd.frame(spark).where("length(text) >= 5000"))
    assert {(r.n_words, len(r.runs)) for r in long.collect()} == {(30_000, 0), (30_001, 0)}
    assert P.periodic_runs(odd.empty(spark)).count() == 0
    assert P.digests(P.periodic_runs(P.with_planted_runs(odd.empty(spark)))).count() == 0


def test_one_long_run(spark):
    df = spark.createDataFrame([(1, "z " * 200_000), (2, "u v w " * 60_000), (3, "z u")], "doc_id long, text string")
    got = {r.doc_id: (list(map(tuple, r.runs)), r.collapsed) for r in P.periodic_runs(df).collect()}
    assert got == {1: ([(0, 200_000, 1)], "z"), 2: ([(0, 180_000, 3)], "u v w"), 3: ([], "z u")}


def planted(doc_id, text):
    words, h = words_of(text), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_planted(spark):
    rows = [(i, " ".join(f"w{k % 7}" for k in range(i % 23))) for i in range(-40, 400)] + [(i, None) for i in range(900, 990)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, *words_of(r.text)) for r in P.with_planted_runs(df).collect()} == {(i, *planted(i, t)) for i, t in rows}


def test_query(spark, small):
    """Every document of the smallest table, against the plain search; the longest texts by their words' matches at each lag."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda x: sha256(x.encode()).hexdigest()
    want = set()
    for doc_id, text in docs:
        words = planted(doc_id, text)
        codes = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, np.int64)
        best = {}
        for p in range(1, len(words) // 4 + 1):
            match = np.flatnonzero(np.diff(np.r_[0, codes[p:] == codes[:-p], 0]))
            for i, j in match.reshape(-1, 2).tolist():
                best.setdefault((i, j + p - i), p)
        runs = sorted((s, n, p) for (s, n), p in best.items() if n >= max(6, 4 * p))
        most = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        milli = 1000 * most[1] // most[2] if runs else None
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        want.add((doc_id, len(runs), *most, milli, digest(lines), digest(collapsed(words, runs))))
    assert {tuple(r) for r in Q.op13_sparse_diagonal_runs(spark, small).collect()} == want
    assert sum(r[1] > 0 for r in want) > 10
