import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from clipledger.llm import bottom_k
from clipledger.llm.bottom_k import near_duplicates
from clipledger.llm.spans import text_bytes, word_names

from . import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, width, at_least):
    sets, root = {}, {}
    for doc_id, text in docs.items():
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        w = WORD.findall(low)
        sets[doc_id] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        root[doc_id] = doc_id

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= at_least * max(len(x), len(y)):
                both = len(x & y)
                if both >= at_least * (len(x) + len(y) - both):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def got(df, width, at_least):
    return {r[0]: tuple(r)[1:4] for r in near_duplicates(df, width, at_least).collect()}


@pytest.mark.parametrize("width,at_least", [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_tables(spark, small, width, at_least):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert got(df, width, at_least) == brute(dict(df.select("doc_id", "text").collect()), width, at_least)


def test_odd_rows(spark):
    want = brute({r[0]: r[1] for r in odd.rows() if r[0] is not None}, 3, Fraction(85, 100))
    assert got(odd.frame(spark), 3, Fraction(85, 100)) == want
    assert near_duplicates(odd.empty(spark)).count() == 0


def test_chains_and_hot_passages(spark):
    """Links that only a chain joins, and a passage that unlike texts share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    docs, n = {}, 0
    passage = [word() for _ in range(60)]
    for size in (12, 40, 90, 300):
        for _ in range(4):
            text = [word() for _ in range(size)]
            for _ in range(9):
                docs[n] = " ".join(text)
                n += 1
                for _ in range(max(1, size // 60)):
                    text[rng.randrange(size)] = word()
        for _ in range(25):
            docs[n] = " ".join([word() for _ in range(size // 2)] + passage + [word() for _ in range(size // 4)])
            n += 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert got(df, 3, Fraction(85, 100)) == brute(docs, 3, Fraction(85, 100))


def test_rows_that_share_an_id(spark):
    """One row out for each row in; the document is linked with what any of its texts is linked with."""
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, a), (1, b), (1, a), (2, b), (3, a + " x"), (4, None), (4, "c d e f"), (5, "c d e f"), (9, "lone words here"), (9, "quite another text")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(85, 100)).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in out) == Counter(
        {(1, 1, True): 3, (2, 1, False): 1, (3, 1, False): 1, (4, 4, True): 2, (5, 4, False): 1, (9, 9, True): 2})


def test_variants_that_are_not_alike(spark):
    """Many variants of one original, all too far from each other: what meets stays near their number, not its square."""
    rng = random.Random(9)
    original = [f"w{i}" for i in range(150)]
    docs = {0: " ".join(original)}
    for n in range(1, 400):
        text = list(original)
        for i in rng.sample(range(150), 7):  # each takes three shingles out
            text[i] = f"v{n}x{i}"
        docs[n] = " ".join(text)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    seen, real = {}, bottom_k.written

    def counted(frame, name):
        out = real(frame, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(bottom_k, "written", counted)
        assert got(df, 3, Fraction(85, 100)) == brute(docs, 3, Fraction(85, 100))
    assert seen["near-met"] < 4 * len(docs)


def test_word_names():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB \n\té") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "x" * 600_000 + " Y z", odd.LONG * 3]
    names, at = word_names(*text_bytes(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        words = [w.lower() for w in (t or "").encode().split()]
        own = names[at[i] : at[i + 1]]
        assert len(own) == len(words)
        for w, x in zip(words, own.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert np.all(np.diff(at) >= 0)


def test_trees_stop_when_flat(spark):
    """Links that are stars already are written once; chains and circles end at the smallest node."""
    from clipledger.llm import common

    names, real = [], common.written
    with pytest.MonkeyPatch.context() as m:
        m.setattr(common, "written", lambda frame, name: names.append(name) or real(frame, name))
        stars = spark.createDataFrame([(n, n % 3) for n in range(3, 40)] + [(2, 2)], "a long, b long")
        assert dict(map(tuple, common.trees(stars, "near-stars").collect())) == {n: n % 3 for n in range(3, 40)}
        assert len(names) == 1
        chain = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101), (102, 101), (102, 100)], "a long, b long")
        want = {n: 0 for n in range(1, 61)} | {101: 100, 102: 100}
        assert dict(map(tuple, common.trees(chain, "near-stars").collect())) == want
