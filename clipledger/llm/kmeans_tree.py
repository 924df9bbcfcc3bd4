"""Approximate nearest neighbours with a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then sorted into a leaf. Largest inner
products are nearest neighbours after one more component brings all vectors to the same norm. A query
walks the tree with a priority queue, always into the bin whose centre is nearest, and visits a number
of leaves that is widened on calibration queries until their recall, against brute force, is reached.

Equal vectors are one from the start and keep only as many ids as a query can return. Neighbouring
leaves share a cell, a large leaf has several; a query goes once to each cell that holds leaves it visits
and looks at these alone. So what is dealt out grows with queries and cells, and no leaf has to fit into a task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import keyed, partitions, written

#: Rows that fit the tree and that calibrate it, children of a node, sampled rows of a leaf, queries of a block.
SAMPLE, CALIBRATION, BRANCH, LEAF, BLOCK = 20_000, 128, 8, 24, 4096
RECALL = 0.97
#: Cells for each shuffle partition, and vectors that a cell has room for at least and at most.
CELLS, SMALL, LARGE = 4, 256, 16_384


@dataclass
class Tree:
    """centres[i], children[i]: of node i; leaf[i]: its leaf number or -1; lift: squared norm all vectors are brought to."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    lift: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.lift - np.einsum("ij,ij->i", vectors, vectors), 0.0)
        return np.column_stack([vectors, np.sqrt(rest)])

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centre at every level."""
        x, out = self.lifted(vectors), np.full(len(vectors), -1, np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            nearest = _nearest(x[rows], self.centres[self.children[node]])
            todo += [(c, rows[nearest == k]) for k, c in enumerate(self.children[node]) if (nearest == k).any()]
        return out

    def visits(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first leaves of a query, best bin first."""
        q = np.append(query, 0.0)
        queue, out = [(0.0, 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
                continue
            kids = self.children[node]
            far = ((self.centres[kids] - q) ** 2).sum(1)
            for d, c in zip(far.tolist(), kids, strict=True):
                heapq.heappush(queue, (d, c))
        return out

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def fit(vectors: np.ndarray, lift: float, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, 0)), [], [], lift)
    x = tree.lifted(vectors)
    centres, todo = [x.mean(0)], [(0, np.arange(len(x)))]
    tree.children.append([])
    tree.leaf.append(-1)
    n_leaves = 0
    while todo:
        node, rows = todo.pop(0)
        groups = []
        if len(rows) > LEAF:
            c = x[rng.choice(rows, BRANCH, replace=False)]
            for _ in range(8):
                near = _nearest(x[rows], c)
                c = np.array([x[rows[near == k]].mean(0) if (near == k).any() else c[k] for k in range(BRANCH)])
            near = _nearest(x[rows], c)
            groups = [(c[k], rows[near == k]) for k in range(BRANCH) if (near == k).any()]
        if len(groups) < 2:
            tree.leaf[node] = n_leaves
            n_leaves += 1
            continue
        for centre, members in groups:
            tree.children[node].append(len(centres))
            todo.append((len(centres), members))
            centres.append(centre)
            tree.children.append([])
            tree.leaf.append(-1)
    tree.centres = np.array(centres)
    return tree


#: Queries that walk the tree at once in a task.
WALKED = 32
OUT = "query_id long, rank int, vec_id long, score double"


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): without null, zero or non-finite vectors."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = keyed(vectors, "vec_id", v="embedding").select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("v")).where(
        v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    )
    return good


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """For each row of scores the k best, ties to smaller ids: row, id, score. Scores of -inf are none."""
    k = min(k, scores.shape[1])
    if (np.diff(ids) < 0).any():
        by_id = np.argsort(ids, kind="stable")
        scores, ids = scores[:, by_id], ids[by_id]
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if k else np.zeros(len(scores))
    row, at = np.nonzero(~(scores < least[:, None]) & (scores != -np.inf))
    order = np.lexsort((-scores[row, at], row))  # stable, so equal scores stay by id
    row, at = row[order], at[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[keep], at[keep]
    return row, ids[at], scores[row, at]


def _exact(index: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """q, score, leaf: the k best distinct vectors of each query of a bounded set, by brute force in blocks."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            rep, leaf = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            row, ids, score = _best(shared.value @ _matrix(batch.column(2)).T, rep, k)
            at = dict(zip(rep.tolist(), leaf.tolist(), strict=True))
            yield pa.RecordBatch.from_pydict({"q": row, "rep": ids, "score": score, "leaf": np.array([at[i] for i in ids.tolist()], np.int64)})

    found = index.select("rep", "leaf", "v").mapInArrow(search, "q long, rep long, score double, leaf long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return found.withColumn("k", F.row_number().over(best)).where(f"k <= {k}")


def calibrated_leaves(tree: Tree, index: DataFrame, queries: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Leaves to visit, so that of the exact neighbours of the calibration queries a share of `recall` is found."""
    places = []
    order = {}
    for q, leaf in ((r.q, r.leaf) for r in _exact(index, queries, k).select("q", "leaf").collect()):
        if q not in order:
            order[q] = {x: i for i, x in enumerate(tree.visits(queries[q], tree.leaves))}
        places.append(order[q][leaf])
    return int(np.quantile(places, recall, method="higher")) + 1 if places else 1


def _cells(counts: list[int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first cell of each leaf and how many it has; leaves that follow each other share one, up to `size` vectors."""
    first, blocks = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    cell = held = 0
    for leaf, n in enumerate(counts):
        if held and held + n > size:
            cell, held = cell + 1, 0
        first[leaf], held = cell, held + n
        if n > size:
            blocks[leaf] = -(-n // size)
            cell, held = cell + int(blocks[leaf]), 0
    return first, blocks


def _searched(index: DataFrame, queries: DataFrame, tree: Tree, leaves: int, k: int) -> DataFrame:
    """q, rep, score: the k best distinct vectors in the leaves that each query (q, v) visits."""
    spark = index.sparkSession
    # one number for each leaf; the tree bounds their count
    held = dict(index.groupBy("leaf").count().collect())
    room = min(max(sum(held.values()) // (CELLS * partitions(spark)), SMALL), LARGE)
    first, blocks = _cells([held.get(i, 0) for i in range(tree.leaves)], room)
    shared = spark.sparkContext.broadcast((tree, first, blocks))

    def walk(batches):
        import pyarrow as pa

        tree, first, blocks = shared.value
        for whole in batches:
            for at in range(0, len(whole), WALKED):  # a row for each cell of each query, so few at once
                batch = whole.slice(at, WALKED)
                row, cells, lists = [], [], []
                for i, q in enumerate(_matrix(batch.column(1))):
                    into: dict[int, list[int]] = {}
                    for leaf in tree.visits(q, leaves):
                        for cell in range(first[leaf], first[leaf] + blocks[leaf]):
                            into.setdefault(cell, []).append(leaf)
                    row += [i] * len(into)
                    cells += into.keys()
                    lists += into.values()
                taken = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_pydict({
                    "cell": pa.array(cells, pa.int64()), "q": taken.column(0), "leaves": pa.array(lists, pa.list_(pa.int64())), "v": taken.column(1),
                })

    visits = written(
        queries.select("q", "v").repartition(partitions(spark), "q").mapInArrow(walk, "cell long, q long, leaves array<long>, v array<double>"),
        "ann-visits",
    )
    places = spark.createDataFrame(list(enumerate(zip(first.tolist(), blocks.tolist(), strict=True))), "leaf long, at struct<first: long, n: long>")
    dealt = F.col("at.first") + F.pmod(F.xxhash64("rep"), F.col("at.n"))
    placed = index.join(F.broadcast(places), "leaf").select(dealt.alias("cell"), "leaf", "rep", "v")
    # queries of a cell in blocks; a cell that no query visits drops out
    asked = visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("nq"))
    left = visits.join(F.broadcast(asked), "cell").select("cell", F.pmod(F.xxhash64("q"), F.col("nq")).alias("qb"), "q", "leaves", "v")
    right = placed.join(F.broadcast(asked), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq") - 1)).alias("qb"), "leaf", "rep", "v"
    )

    def meet(a, b):
        import pyarrow as pa

        if not len(a) or not len(b):
            return pa.table({"q": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = a.combine_chunks(), b.combine_chunks().sort_by("rep")
        ids, rep, v, parts = a["q"].to_numpy(), b["rep"].to_numpy(), _matrix(b["v"].combine_chunks()), []
        own, leaf = np.unique(b["leaf"].to_numpy(), return_inverse=True)
        q, lists = _matrix(a["v"].combine_chunks()), a["leaves"].combine_chunks()
        for i in range(0, len(q), 256):
            scores, few = q[i : i + 256] @ v.T, lists.slice(i, 256)
            wanted = few.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(few)), few.value_lengths().to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            there = own[at] == wanted
            seen = np.zeros((len(few), len(own)), bool)
            seen[row[there], at[there]] = True
            scores[~seen[:, leaf]] = -np.inf
            row, found, score = _best(scores, rep, k)
            parts.append((ids[i + row], found, score))
        return pa.table(dict(zip(("q", "rep", "score"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True)))

    keys = ("cell", "qb")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return met.withColumn("k", F.row_number().over(best)).where(f"k <= {k}").select("q", "rep", "score")


def nearest(vectors: DataFrame, is_query: str, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows for which `is_query` (SQL over vec_id) holds.

    Vectors that are null, zero or hold null or non-finite components take no part. Vectors of another
    length have no product with a query, so each length has an index and lists of its own.
    Of rows that share an id and a vector one counts; ids with two vectors count with both.
    """
    rows = written(clean(vectors).distinct(), "ann-rows")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # as a rule one
    if not lengths:
        return vectors.sparkSession.createDataFrame([], OUT)
    lists = [_of_one_length(rows.where(F.size("v") == n) if len(lengths) > 1 else rows, is_query, k, recall) for n in lengths]
    return reduce(DataFrame.unionByName, lists)


def _of_one_length(rows: DataFrame, is_query: str, k: int, recall: float) -> DataFrame:
    """The lists of vectors of one length."""
    spark = rows.sparkSession
    least = Window.partitionBy("v").orderBy("vec_id")
    same = (
        rows.withColumn("k", F.row_number().over(least)).where(f"k <= {k + 1}")
        .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "ids", "v")
    )
    distinct = written(same, "ann-distinct")
    sample = np.array([r.v for r in distinct.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").collect()])
    if not len(sample):
        return spark.createDataFrame([], OUT)
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    tree = fit(sample, distinct.agg(F.max(square(F.col("v")))).first()[0])
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            leaf = shared.value.assign(_matrix(batch.column(2))) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "rep", "ids", "v"])

    index = written(distinct.mapInArrow(place, "leaf long, rep long, ids array<long>, v array<double>"), "ann-index")
    asked = rows.where(is_query)
    queries = written(asked.groupBy("v").agg(F.min("vec_id").alias("q")).select("q", "v"), "ann-queries")
    own = written(asked.join(queries, "v").select("vec_id", "q"), "ann-asked")
    trial = np.array([r.v for r in queries.orderBy(F.xxhash64("q")).limit(CALIBRATION).select("v").collect()])
    if not len(trial):
        return spark.createDataFrame([], OUT)
    leaves = calibrated_leaves(tree, index, trial, k + 1, recall)
    found = _searched(index, queries, tree, leaves, k + 1).join(index.select("rep", "ids"), "rep")
    every = found.select("q", "score", F.explode("ids").alias("near"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "near")
    lists = written(
        every.withColumn("k", F.row_number().over(best)).where(f"k <= {k + 1}")
        .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("k", "near", "score"))).alias("list")),
        "ann-lists",
    )
    # without the query itself, the first k of at most k + 1
    others = F.slice(F.filter("list", lambda x: x["near"] != F.col("vec_id")), 1, k)
    return own.join(lists, "q").select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.near").alias("vec_id"), F.col("x.score").alias("score")
    )
