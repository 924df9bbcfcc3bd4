import math
import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np

from clipledger.llm import pitman_yor as P
from clipledger.llm import seating as S

from . import odd

HELD = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")), None]


def brute(rows):
    """All but the model's score."""
    count, out = Counter(), {}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    for i, text in rows:
        if not held(i):
            count.update(tokens(text))
    n, v = sum(count.values()), len(count)
    by = defaultdict(list)
    for i, text in rows:
        by[i] += tokens(text)
    for i, w in by.items():
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out[i] = (held(i), len(w), sum(count[x] > 0 for x in w), n, base)
    return out


def check(df, rows):
    got = {r.doc_id: r for r in P.scored(df, HELD).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, w in want.items():
        assert tuple(got[i])[1:5] == w[:4] and math.isclose(got[i].base_score, w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(got[i].score) and got[i].score <= 1e-9
    return got


def test_tables(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    got = check(df, [tuple(r) for r in df.select("doc_id", "text").collect()])
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in P.scored(df, HELD).collect()}
    assert all(math.isclose(again[i], r.score, rel_tol=1e-9, abs_tol=1e-9) for i, r in got.items())


def test_odd_rows(spark):
    check(odd.frame(spark), [(r[0], r[1]) for r in odd.rows() if r[0] is not None])
    assert P.scored(odd.empty(spark), HELD).count() == 0
    check(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), [(1, "a b")])


def zipf_rows(n=60, seed=2):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 60) % 40)) for i in range(n)]


def test_probabilities_add_up(spark):
    """Over all known words and an unknown one, after a context; with sums by list and by messages."""
    rows = zipf_rows()
    known = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split()})
    for head, context in ((P.HEAD, "w1"), (4, "w1"), (4, "w17")):
        assert abs(_chances(spark, rows, known, context, head) - 1) < 1e-9


def _chances(spark, rows, known, context, head):
    """Sum over words of P(w | context), from the model itself."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.expr(f"NOT ({HELD})").alias("train"), "text")
    parts, model = P.dealt_parts(docs, head)
    found = reduce(lambda a, b: a.unionByName(b), P.learned(parts, model)).collect()
    name = lambda w: P.word_names(*P.text_bytes(pa.array([w])))[0][0]
    codes = {w: int(name(w)) for w in known} | {None: int(P.END)}
    ids = {w: int(model.words.id_of(np.array([c], np.uint64))[0]) for w, c in codes.items()}
    code = ids[context] if ids[context] >= 0 else codes[context]
    last = model.burn + model.keep
    seats, total, seen, below = model.history[last], 0.0, set(), None
    roots = {}
    for r in parts.collect():
        got = P._by_part([pa.RecordBatch.from_pylist([f.asDict() for f in found if f.part == r.part])]) if any(f.part == r.part for f in found) else {r.part: {}}
        own = P.PartSeats(model, r.part, r.train)
        own.take_answers(0, got[r.part].get(P.ANSWER, []))
        own.take_state(dict(got[r.part][P.STATE])[last])
        own.take_answers(last, got[r.part].get(P.ANSWER + last, []))
        root, chance = own.root(seats), own.chances(last)
        key = own.key[np.unique(own.word, return_index=True)[1]] if own.n_words else []
        for k, w in enumerate(key):
            roots[(bool(own.is_rare[k]), int(w))] = float(root[k])
        for k in np.flatnonzero(own.context == code):
            total += float(chance[k])
            seen.add((bool(own.rare[k]), int(own.key[k])))
            counts, tables = own.of_contexts(model.context_counts, own.far_counts)[k], own.of_contexts(seats.tables, own.far_first + own.far_more)[k]
            assert below in (None, (counts, tables))
            below = (counts, tables)
    rest = (P.STRENGTH + model.discount * below[1]) / (P.STRENGTH + below[0])
    words = {(ids[w] < 0, ids[w] if ids[w] >= 0 else codes[w]) for w in codes}
    unknown = model.root(np.zeros(1), np.zeros(1), seats)[0]
    return total + rest * (sum(roots[w] for w in words - seen) + unknown)


def sampled(rows, d, d_root, sweeps, rng):
    """Average predictive probability of each (context, word), by seating and seating again one customer at a time."""
    places = [(u, w) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for u, w in zip(["start", *t.split()], tokens(t), strict=True)]
    kinds = len({w for _, w in places})
    dishes, tables, count, root = defaultdict(list), Counter(), Counter(), defaultdict(list)
    totals = Counter()

    def root_chance(w):
        sizes = root[w]
        return (sum(sizes) - d_root * len(sizes) + (P.STRENGTH + d_root * totals["tables"]) / (kinds + 1)) / (P.STRENGTH + totals["guests"])

    def pick(sizes, cut, new):
        weight = np.array([x - cut for x in sizes] + [new])
        return int(rng.choice(len(weight), p=weight / weight.sum()))

    def seat(u, w):
        k = pick(dishes[u, w], d, (P.STRENGTH + d * tables[u]) * root_chance(w))
        count[u] += 1
        if k < len(dishes[u, w]):
            dishes[u, w][k] += 1
            return
        dishes[u, w].append(1)
        tables[u] += 1
        k = pick(root[w], d_root, (P.STRENGTH + d_root * totals["tables"]) / (kinds + 1))
        totals["guests"] += 1
        if k < len(root[w]):
            root[w][k] += 1
        else:
            root[w].append(1)
            totals["tables"] += 1

    def leave(sizes):
        k = int(rng.choice(len(sizes), p=np.array(sizes) / sum(sizes)))
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    chance, kept = Counter(), 0
    for u, w in places:
        seat(u, w)
    for k in range(sweeps):
        for u, w in places:
            count[u] -= 1
            if leave(dishes[u, w]):
                tables[u] -= 1
                totals["guests"] -= 1
                totals["tables"] -= leave(root[w])
            seat(u, w)
        if k >= sweeps // 4:
            kept += 1
            for u, w in set(places):
                sizes = dishes[u, w]
                chance[u, w] += (sum(sizes) - d * len(sizes) + (P.STRENGTH + d * tables[u]) * root_chance(w)) / (P.STRENGTH + count[u])
    return {k: v / kept for k, v in chance.items()}


def test_scores_against_a_plain_sampler(spark):
    """Training texts scored with many kept sweeps; every context by list, few, none."""
    rows = [(i, " ".join(t.split()[:25])) for i, t in zipf_rows(14, 5)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    n = Counter(p for _, t in train for p in zip(["start", *t.split()], tokens(t), strict=True))
    words = Counter(w for _, t in train for w in tokens(t))
    ones = lambda c: (sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values()))
    want = sampled(rows, P.discount(*ones(n)), P.discount(*ones(words)), 400, np.random.default_rng(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for head in (P.HEAD, 3):
        got = {r.doc_id: r.score for r in P.scored(df, HELD, head=head, burn=4, keep=12).collect()}
        for i, t in train:
            plain = sum(math.log10(want[p]) for p in zip(["start", *t.split()], tokens(t), strict=True))
            assert abs(got[i] - plain) < 0.02 * abs(plain), (head, i, got[i], plain)


def test_tables_are_drawn_from_the_seating_distribution():
    """Against customers seated and seated again one by one."""
    rng, d, others, parent = np.random.default_rng(1), 0.6, 40.0, 0.05
    for c in (2, 5, 12):
        drawn = S.drawn_tables(np.full(40_000, c), np.full(40_000, P.STRENGTH + d * others), np.full(40_000, parent), d, S.stirling(d), rng)
        sizes, seen = [c], Counter()
        for step in range(30_000):
            k = rng.choice(len(sizes), p=np.array(sizes) / c)
            sizes[k] -= 1
            if not sizes[k]:
                sizes.pop(k)
            weight = np.array([x - d for x in sizes] + [(P.STRENGTH + d * (others + len(sizes))) * parent])
            k = rng.choice(len(weight), p=weight / weight.sum())
            if k == len(sizes):
                sizes.append(1)
            else:
                sizes[k] += 1
            seen[len(sizes)] += step > 500
        mean = sum(k * n for k, n in seen.items()) / sum(seen.values())
        assert abs(mean - drawn.mean()) < 0.08 * mean


def test_stirling_numbers_of_any_size():
    """The integral against the recursion."""
    for d in (0.05, 0.6, 0.95):
        exact = S.stirling(d, 700)
        for c in (129, 300, 700):
            t = np.arange(1, c + 1)
            assert np.abs(S.log_stirling(c, t, d) - exact[c, 1 : c + 1])[:-8].max() < 1e-3
            assert np.abs(S.log_stirling(c, t, d) - exact[c, 1 : c + 1]).max() < 0.02


def test_many_customers_are_drawn_from_the_same_distribution():
    """Beyond the tables of the recursion: mean and spread against the whole distribution."""
    rng = np.random.default_rng(4)
    for d in (0.3, 0.8):
        exact = S.stirling(d, 600)
        for c in (129, 600):
            for start, parent in ((1.0, 0.5), (1.0, 1e-6), (50.0, 0.05), (1e4, 0.1), (1e6, 0.01)):
                t = np.arange(1, c + 1)
                log_p = np.cumsum(np.log(start + d * (t - 1)) + np.log(parent)) + exact[c, 1 : c + 1]
                p = np.exp(log_p - log_p.max())
                p /= p.sum()
                mean = p @ t
                spread = math.sqrt(p @ (t - mean) ** 2)
                drawn = S.drawn_tables(np.full(3000, c), np.full(3000, start), np.full(3000, parent), d, S.stirling(d), rng)
                assert abs(drawn.mean() - mean) < 5 * spread / math.sqrt(3000) + 0.01
                assert abs(drawn.std() - spread) < 0.1 * spread + 0.02
    hot = S.drawn_tables(np.full(3, 30_000_000), np.full(3, 1e6), np.full(3, 0.05), 0.7, S.stirling(0.7), rng)
    assert (hot > 70_000).all() and (hot < 80_000).all()
