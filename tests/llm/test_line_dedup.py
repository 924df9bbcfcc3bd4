import random
import re

from pyspark.sql import functions as F

from clipledger.llm import line_dedup as L

from . import odd

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def brute(held, asked, least=10):
    """held: documents of the index; asked: rows to cut."""
    owners = {}
    for doc_id, text in held:
        if doc_id is not None:
            for line in (text or "").split("\n"):
                if len(key_of(line)) >= least:
                    owners.setdefault(key_of(line), set()).add(doc_id)
    out = []
    for doc_id, text in asked:
        if doc_id is not None:
            lines = (text or "").split("\n")
            kept = [x for x in lines if len(owners.get(key_of(x), ())) < 2 or min(owners[key_of(x)]) == doc_id]
            out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def got(index, df):
    return sorted(tuple(r) for r in index.kept(df).collect())


def test_cuckoo():
    rnd = random.Random(1)
    keys = [rnd.randbytes(16) for _ in range(6000)]
    f = L.Cuckoo(expected=100)  # has to grow several times
    for k in keys:
        f.add(k)
    assert len(f.layers) > 2 and all(k in f for k in keys)
    f = L.Cuckoo(f.dump())
    strangers = [rnd.randbytes(16) for _ in range(20_000)]
    assert sum(k in f for k in strangers) < 100
    rnd.shuffle(keys)
    assert all(f.discard(k) for k in keys[:3000])
    assert all(k in f for k in keys[3000:]) and sum(k in f for k in keys[:3000]) < 30
    assert all(f.discard(k) for k in keys[3000:]) and not any(any(x) for x in f.layers)
    # keys that differ outside fingerprint and place: as many copies as keys
    same = [bytes([i]) + b"abcde" + b"01234567" + b"xy" for i in range(30)]
    for k in same:
        f.add(k)
    for k in same[1:]:
        assert f.discard(k) and same[0] in f
    assert f.discard(same[0]) and same[0] not in f and not f.discard(same[0])


def test_updates(spark, monkeypatch):
    """Random insertions, replacements and removals, with small shards, against the whole recomputed."""
    monkeypatch.setattr(L, "SHARD_KEYS", 4)
    rnd = random.Random(5)
    lines = [f"  Line number {i} of a page\t" for i in range(12)] + ["short", "", "éééééééééé", "ééééééééé", "UPPER É CASE LINE", "upper É case line\x0b"]
    text = lambda: rnd.choice([None, "", "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 9)))])
    held, index = {}, L.LineIndex(spark)
    for step in range(6):
        if step in (2, 4):
            gone = rnd.sample(sorted(held), 5) + [12345]
            index.remove(frame(spark, [(i, None) for i in [*gone, None]]))
            held = {k: v for k, v in held.items() if k not in gone}
        else:
            batch = {rnd.randrange(30): text() for _ in range(9)}
            index.insert(frame(spark, list(batch.items())))
            held |= batch
        if step == 4:
            index = L.LineIndex(spark, index.folder)  # as another session opens it
        if step == 5:
            index.compact()
        if step > 1:
            assert got(index, frame(spark, list(held.items()))) == brute(held.items(), held.items()), step
        counts = {}
        for doc_id, t in held.items():
            for k in {k for k in L.line_keys(t) if k}:
                counts[k] = counts.get(k, 0) + 1
        assert {bytes(r.key): r.n_docs for r in index.states().collect()} == counts
        assert index.now.n_keys == len(counts)


def test_filters_forget(spark):
    """False positives are found out by the counts, and an emptied index has empty filters."""
    index = L.LineIndex(spark)
    index.insert(frame(spark, [(i, f"one line {i} of many\nand a common line") for i in range(300)]))
    index.remove(frame(spark, [(i, None) for i in range(300)]))
    rows = index._read([index.now.filters], "key binary, " + L.FILTER).where("key IS NULL").collect()
    assert index.now.n_keys == 0 and not any(any(x) for r in rows for x in L.Cuckoo(r.layers).layers)
    index.insert(frame(spark, [(7, "and a common line"), (9, "And a common line ")]))
    assert got(index, frame(spark, [(7, "and a common line"), (9, "And a common line ")])) == [(7, 1, 0, "and a common line"), (9, 1, 1, "")]


def test_false_positives(spark):
    """Filters that claim to know keys which no document holds cost a join, never a result."""
    rows = [(i, f"line {i % 40} of the text\nline {i % 7} of the rest") for i in range(90)]
    index = L.LineIndex(spark)
    claimed = [(k, None, None, "add") for k in {k for _, t in rows for k in L.line_keys(t)}]
    index.now.filters = index._passed(spark.createDataFrame(claimed, "key binary, n_docs long, keeper long, what string"), None, 0)
    index.insert(frame(spark, rows))
    assert index._asked(index.now.filters).where("NOT known").isEmpty()
    assert got(index, frame(spark, rows)) == brute(rows, rows)


def test_odd_rows(spark):
    df, rows = odd.frame(spark), [(r[0], r[1]) for r in odd.rows()]
    index = L.LineIndex(spark)
    index.insert(df)
    assert got(index, df) == brute(rows, rows)
    # one id, two texts: one document, which keeps what it shares with itself
    pair = [(1, "a line that is shared"), (1, "a line that is shared\nb"), (2, "a line that is shared")]
    index = L.LineIndex(spark)
    index.insert(frame(spark, pair))
    assert got(index, frame(spark, pair)) == brute(pair, pair)
    empty = L.LineIndex(spark)
    empty.insert(odd.empty(spark))
    assert got(empty, odd.empty(spark)) == []


def test_hot_line(spark):
    """A line that all documents have is one row of the counts and of its shard."""
    rows = [(i, f"the line that everybody has\nown line number {i}") for i in range(3000)]
    index = L.LineIndex(spark)
    index.insert(frame(spark, rows))
    assert index.states().where("n_docs > 1").collect()[0].n_docs == 3000
    assert index.kept(frame(spark, rows)).agg(F.sum("n_dropped")).first()[0] == 2999
