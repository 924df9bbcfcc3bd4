from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from clipledger.llm import quality_rules, secret_scan
from clipledger.llm.common import written

from . import odd
from .test_bottom_k import brute as near
from .test_mixing import M, sequence
from .test_secret_scan import brute as spans
from .test_tokens import check_packing, ids_of


def test_stages(spark, small):
    """Every stage against a plain version, on what the one before it wrote."""
    import corpus_pipeline as P

    root = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in P.STAGES]
    out = {}
    for name, stage in P.STAGES:
        before = docs
        docs = written(stage(spark, before, root), "t")
        out[name] = (before, docs)
        assert name == names[-1] or docs.columns == columns
    rows = {n: ([r for r in a.collect()], [r for r in b.collect()]) for n, (a, b) in out.items()}

    before, after = rows["quality_rules"]
    kept = {r.doc_id for r in quality_rules.judged(out["quality_rules"][0], spark.read.parquet(f"{root}/labels.parquet"))[0].where("kept").collect()}
    assert Counter(after) == Counter(r for r in before if r.doc_id in kept)
    good = {r.doc_id for r in spark.read.parquet(f"{root}/labels.parquet").where("quality = 1").collect()}
    long = [r for r in before if r.doc_id in good and len((r.text or "").split()) >= 60]
    assert sum(r.doc_id in kept for r in long) >= 0.97 * len(long)

    before, after = rows["near_dedup"]
    own = near({r.doc_id: r.text for r in before}, 5, Fraction(4, 5))
    assert Counter(after) == Counter(r for r in before if own[r.doc_id][2])

    before, after = rows["secret_scan"]
    models = secret_scan.trained_on(out["secret_scan"][0])
    changed = {r.doc_id: r for r in after}
    assert len(after) == len(before)
    for r in before:
        found = spans(r.text, models)[1]
        assert (changed[r.doc_id].text == r.text) == (not found) and changed[r.doc_id].text.count("[SECRET]") >= bool(found)

    before, after = rows["source_mix"]
    assert Counter(before) == Counter(after)
    sizes = Counter(r.source for r in before)
    order = sequence({s: -(-n // M.BLOCK_ROWS) for s, n in sizes.items()}, M.tempered_weights(sizes))
    place = {r.doc_id: r.place for r in M.interleaved(out["source_mix"][0]).collect()}
    by_place = sorted(before, key=lambda r: place[r.doc_id])
    seen, t = Counter(), 0
    for s in order:
        n = min(M.BLOCK_ROWS, sizes[s] - seen[s])
        assert all(r.source == s for r in by_place[t : t + n])
        seen[s], t = seen[s] + n, t + n

    before, after = rows["best_fit_packing"]
    check_packing([tuple(r) for r in after], [(r.doc_id, ids_of(r.text, 0)) for r in before], 2048)


def test_weights_reach_the_sequences(spark, small, monkeypatch):
    """Sequences are numbered in the order of the mix, so other weights give other rows."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted(set(source.values()))

    def run(weights):
        mixed = lambda spark, docs, root: M.mixed_documents(docs, weights)
        monkeypatch.setattr(P, "STAGES", [("source_mix", mixed), P.STAGES[-1]])
        place = {r.doc_id: r.place for r in M.interleaved(docs.select("doc_id", "source", F.xxhash64("doc_id", "source").alias("k")), weights, key="k")
                 .join(docs.select("doc_id", F.xxhash64("doc_id", "source").alias("k")), "k").collect()}
        return P.run(spark, small).collect(), place

    seen = []
    for weights in ({names[0]: 1}, {names[-1]: 1}):
        rows, place = run(weights)
        first = {}
        for r in rows:
            first[r.sequence_id] = min(first.get(r.sequence_id, len(place)), place[r.doc_id])
        assert [first[s] for s in sorted(first)] == sorted(first.values()) and sorted(first) == list(range(len(first)))
        seen.append({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows})
        lead = next(r.doc_id for r in rows if place[r.doc_id] == 0)
        assert source[lead] in weights and any(r.doc_id == lead and r.sequence_id == 0 for r in rows)
    assert seen[0] != seen[1]


def test_odd_rows(spark, small):
    import corpus_pipeline as P

    for docs in (odd.frame(spark, extra=False), odd.empty(spark)):
        for _, stage in P.STAGES:
            docs = written(stage(spark, docs, small), "t")
