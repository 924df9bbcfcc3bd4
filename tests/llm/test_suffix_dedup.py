import hashlib
import random

from clipledger.llm.suffix_dedup import cut_documents

from . import odd

T = 100


def brute(docs):
    seen, out = {}, {}
    for doc_id, text in sorted(docs.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - T + 1):
            if data[p : p + T] in seen:
                gone[p : p + T] = b"\1" * T
            else:
                seen[data[p : p + T]] = 1
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r[0]: tuple(r)[1:5] for r in cut_documents(df).collect()}


def test_tables(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert got(df) == brute(dict(df.select("doc_id", "text").collect()))


def test_odd_rows(spark):
    df = odd.frame(spark)
    want = brute({r[0]: r[1] for r in odd.rows() if r[0] is not None})
    assert got(df) == want
    kept = {r.doc_id: r.kept for r in cut_documents(df, keep_text=True).collect()}
    assert all(hashlib.sha256(kept[k]).hexdigest() == v[3] for k, v in want.items())
    assert cut_documents(odd.empty(spark)).count() == 0


def test_random_copies(spark):
    """Passages around the threshold, moved about, in texts of few letters."""
    rng = random.Random(5)
    base = ["".join(rng.choice("ab ") for _ in range(rng.choice([90, 99, 100, 101, 140, 400]))) for _ in range(12)]
    docs = {}
    for i in range(120):
        parts = [rng.choice(base)[rng.randrange(3) :] if rng.random() < 0.6 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(200))) for _ in range(rng.randrange(1, 5))]
        docs[i] = "".join(parts)
    docs[200], docs[201] = "z" * 5000, "zy" * 2500
    assert got(spark.createDataFrame(list(docs.items()), "doc_id long, text string")) == brute(docs)
