"""Near-duplicates by bottom-k sketches of one hash function.

A document's set are the hashes of its distinct word shingles; its sketch keeps the k smallest.
Equal sets are one class from the start, so copies cost one row. Inverted lists of retained values
then propose pairs, the sketch of the union estimates their similarity, and full sets decide.

Lists. Two sets with at least 64/t values share, at similarity t, a run of 4 neighbours among their
64 smallest with a probability of over 1 - 1e-6, so every run of 4 retained values is a list. Smaller
sets use single values: of n values the n - ceil(t n) + 1 smallest, of which two such sets always share
one. Common passages seldom fill a run, so lists stay short unless documents are alike.

Pairs. A list is first compared with the one member that shares most lists, as an original does with
its variants, and links make components. Of lists whose members are then in different components, all
pairs across components that could be links are found by prefixes of the full sets, rarest shingles
first. Many variants of one original still meet there, so what meets is held against two bounds before it
becomes a row: how many shingles can be common at all, from the places of the one that met, and how many
must differ, from parity vectors: every shingle of one set alone turns one bit, so as many bits as
two vectors differ in, at least, the sets differ in. A group of n alike documents so makes about n rows. No link
that a list proposes is left out: pairs that only an estimate let go are tried again.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import forget, keyed, trees, written
from clipledger.llm.spans import mixed, pair, shingle_sets, slices, text_bytes, word_names

KEPT = 64
RUN = 4
#: Words of 64 bits of a parity vector.
PARITY = 8
#: Standard deviations of the estimate that a pair may lie below the threshold before it is let go.
SLACK = 5.5


def _prefix(n: int, at_least: Fraction) -> int:
    return n - -(-at_least.numerator * n // at_least.denominator) + 1


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), x, y (fingerprint of the set), sketch (its smallest values, ascending), parity (of how many values turn each bit)."""

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for s in shingle_sets(*word_names(*text_bytes(batch.column(1))), width):
                x, y = mixed(s ^ np.uint64(1)).sum(dtype=np.uint64), mixed(s ^ np.uint64(2)).sum(dtype=np.uint64)
                bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
                turned = np.packbits(bits.astype(np.uint8)).view(np.int64)
                rows.append((len(s), int(x.view(np.int64)), int(y.view(np.int64)), s[:KEPT].tobytes(), turned.tolist()))
            names = ("n", "x", "y", "sketch", "parity")
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {c: [r[k] for r in rows] for k, c in enumerate(names)})

    return docs.mapInArrow(build, "doc_id long, n long, x long, y long, sketch binary, parity array<long>")


def _lists(classes: DataFrame, at_least: Fraction) -> DataFrame:
    """value, doc_id: the inverted lists."""

    def post(batches):
        import pyarrow as pa

        for batch in batches:
            values, docs = [], []
            for doc_id, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                kept = np.frombuffer(raw, np.uint64)
                if n * at_least <= KEPT:
                    values.append(kept[: _prefix(n, at_least)])
                    docs.append(np.full(len(values[-1]), doc_id))
                if n > KEPT:
                    run = kept
                    for k in range(1, RUN):
                        run = pair(run[: KEPT - k], kept[k:], 50 + k)
                    values.append(mixed(run))
                    docs.append(np.full(len(run), doc_id))
            if values:
                yield pa.RecordBatch.from_pydict(
                    {"value": np.concatenate(values).view(np.int64), "doc_id": np.concatenate(docs).astype(np.int64)}
                )

    return classes.select("doc_id", "n", "sketch").mapInArrow(post, "value long, doc_id long")


def _estimated(pairs: DataFrame, classes: DataFrame, at_least: Fraction) -> DataFrame:
    """a, b, sure: pairs that may be similar enough; `sure` where the sketches are the sets, so that they decide."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    low = float(at_least) - SLACK * (float(at_least * (1 - at_least)) / KEPT) ** 0.5

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(k).to_pylist() for k in range(6))
            keep = []
            for i in range(len(a)):
                x, y = np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64)
                both = np.intersect1d(x, y, assume_unique=True)
                if max(na[i], nb[i]) <= KEPT:
                    if len(both) >= at_least * (len(x) + len(y) - len(both)):
                        keep.append((a[i], b[i], True))
                    continue
                union = np.union1d(x, y)[:KEPT]
                if len(np.intersect1d(union, both, assume_unique=True)) >= low * len(union):
                    keep.append((a[i], b[i], False))
            yield pa.RecordBatch.from_pydict(
                {c: pa.array([r[k] for r in keep], t) for k, (c, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())))}
            )

    fits = f"na * {at_least.denominator} >= nb * {at_least.numerator} AND nb * {at_least.denominator} >= na * {at_least.numerator}"
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
    return joined.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(judge, "a long, b long, sure boolean")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, at_least: Fraction) -> tuple[DataFrame, DataFrame]:
    """Of pairs a, b those whose full sets are similar enough, and the written sets they are read from."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(*word_names(*text_bytes(batch.column(1))), width)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "full": pa.array(found, pa.binary())})

    once = docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    full = written(once.mapInArrow(build, "doc_id long, full binary"), "near-sets")

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= at_least * (len(x) + len(y) - both):
                    keep.append((a, b))
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in keep], pa.int64()) for k, c in enumerate("ab")})

    side = lambda c: full.select(F.col("doc_id").alias(c), F.col("full").alias(f"s{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long"), full


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds the root of doc_id, which is doc_id itself where roots (node, root) has none."""
    joined = df.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.withColumn("root", F.coalesce("root", "doc_id"))


def _apart(wanted: DataFrame, docs: DataFrame, classes: DataFrame, roots: DataFrame, width: int, at_least: Fraction) -> DataFrame:
    """a, b: pairs of the wanted documents (a written table, deleted here) of different components that could be similar enough.

    Shingles are put in order, those of fewest documents first. Every set keeps its first
    p = n - ceil(t n) + 1. Sets of n and m with a link have o = ceil(t / (1 + t) (n + m)) shingles in
    common, so each misses n - o in the other, and of the kept ones at least the smaller of p - (n - o)
    on either side meet. Shingles that one document alone has take places but make no pairs. Texts that
    share a common passage, or many variants of one, have few such pairs.
    """
    def post(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            sets = list(shingle_sets(*word_names(*text_bytes(batch.column(1))), width))
            size = [len(s) for s in sets]
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), size)
            x = np.repeat(np.array([mixed(s ^ np.uint64(1)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64), size)
            full = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"value": full.view(np.int64), "doc_id": doc.astype(np.int64), "x": x})

    once = docs.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    own = written(once.mapInArrow(post, "value long, doc_id long, x long"), "near-open-sets")
    often = own.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    least = lambda n: f"(({n}) * {at_least.numerator} + {at_least.denominator - 1}) DIV {at_least.denominator}"
    by_set = Window.partitionBy("doc_id", "x")
    sizes = _rooted(classes.select("doc_id", "x", "n", "parity"), roots)
    first = (
        own.join(often, "value")
        .withColumn("k", F.row_number().over(by_set.orderBy("often", "value"))).withColumn("shared", F.count("*").over(by_set))
        .join(sizes, ["doc_id", "x"]).withColumn("p", F.expr(f"n - {least('n')} + 1")).where("n - shared + k <= p")
        .select("value", "doc_id", "n", "root", "p", "k", F.col("shared").alias("s"), "parity")
    )
    first = written(first, "near-first")
    forget(own, wanted)
    other = first.select("value", *(F.col(c).alias(f"{c}1") for c in ("doc_id", "n", "root", "p", "k", "s", "parity")))
    whole = at_least.numerator + at_least.denominator
    common = f"(((n + n1) * {at_least.numerator} + {whole - 1}) DIV {whole})"
    fits = f"n * {at_least.denominator} >= n1 * {at_least.numerator} AND n1 * {at_least.denominator} >= n * {at_least.numerator}"
    # shared so far, and from here on
    can = f"least(k, k1) + least(s - k, s1 - k1) >= {common}"
    differ = " + ".join(f"bit_count(parity[{i}] ^ parity1[{i}])" for i in range(PARITY))
    met = first.join(other, "value").where(f"doc_id < doc_id1 AND root <> root1 AND {fits} AND {can} AND {differ} <= n + n1 - 2 * {common}")
    pairs = met.groupBy(F.col("doc_id").alias("a"), F.col("doc_id1").alias("b")).agg(
        F.count("*").alias("met"), F.min(F.expr(f"least(p - n + {common}, p1 - n1 + {common})")).alias("least")
    )
    found = written(pairs.where("met >= least").select("a", "b"), "near-met")
    forget(first)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, at_least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document with an id.

    Linked are documents whose sets have a similarity of `at_least`; component_id is the smallest id
    that links reach, kept tells whether it is the document's own. Texts without words (null, empty)
    have no shingles and stay alone. Every row comes out once. Rows that share an id are one
    document, linked with all that any of its texts is linked with.
    """
    docs = keyed(docs, "doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    every = written(sketches(docs, width), "near-sketches")
    classes = written(
        every.where("n > 0").groupBy("x", "y").agg(F.min(F.struct("doc_id", "n", "sketch", "parity")).alias("first"))
        .select("x", "y", "first.*"),
        "near-classes",
    )
    own = written(
        every.select("doc_id", "n", "x", "y").join(classes.select("x", "y", F.col("doc_id").alias("node")), ["x", "y"], "left").select("doc_id", "n", "node"),
        "near-own",
    )
    forget(every)
    lists = written(_lists(classes, at_least), "near-lists")
    shared = lists.groupBy("value").agg(F.count("*").alias("size")).where("size > 1")
    members = written(lists.join(shared, "value"), "near-members")
    forget(lists)
    hubs = members.groupBy("doc_id").agg(F.sum("size").alias("support"))
    heads = members.join(hubs, "doc_id").groupBy("value").agg(F.max_by("doc_id", F.struct("support", -F.col("doc_id"))).alias("head"))
    star = members.join(heads, "value").where("doc_id <> head")
    proposed = star.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b")).distinct()
    close = written(_estimated(proposed, classes, at_least), "near-close")
    confirmed, full = _confirmed(close.where("NOT sure").select("a", "b"), docs, width, at_least)
    # classes of rows that share an id belong together
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    several = own.join(several, "doc_id").select("a", F.col("node").alias("b"))
    links = close.where("sure").select("a", "b").unionByName(confirmed).unionByName(several)
    roots = trees(links, "near-stars")
    forget(full)
    split = (
        _rooted(members.select("value", "doc_id"), roots)
        .groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("value")
    )
    wanted = written(members.join(split, "value", "left_semi").select("doc_id").distinct(), "near-open")
    forget(members)
    fresh = _apart(wanted, docs, classes, roots, width, at_least).join(close.select("a", "b"), ["a", "b"], "left_anti")
    fresh = written(fresh, "near-fresh")
    root = F.coalesce("root", "node", "doc_id")
    named = own.join(roots, "node", "left").select("doc_id", "n", root.alias("root"))
    if not fresh.isEmpty():
        # links between components: only their roots are joined anew
        confirmed, full = _confirmed(fresh, docs, width, at_least)
        for c in ("a", "b"):
            confirmed = _rooted(confirmed.withColumnRenamed(c, "doc_id"), roots).drop("doc_id").withColumnRenamed("root", c)
        above = trees(confirmed, "near-stars").select(F.col("node").alias("root"), F.col("root").alias("top"))
        forget(full)
        named = named.join(above, "root", "left").withColumn("root", F.coalesce("top", "root"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), (F.col("doc_id") == F.col("root")).alias("kept"))
