"""Ranked lexical search by the Best Position Algorithm over impact lists.

One pass over the texts keeps what the items' terms need: for each document its number of terms and the
occurrences of terms that some item has. Counts over all documents make the weights. A task then turns its
documents into shards; in a shard every term has an impact list, the documents by falling impact. An item's
lists are read downwards together. A document met for the first time is looked up in all lists
(direct access), which gives its score and marks its positions as seen. The best position of a list is the
last one up to which all have been seen, whether read or looked up; an unseen document can reach no more than
the impacts just after the best positions. When that is strictly below the k-th score, reading stops: an equal
score could still win by its id. The k-th score of a task's earlier shards holds in its later ones.

A task returns at most k documents for each item, however many it has, and these are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import written
from clipledger.llm.spans import slices

#: Items are taken in blocks of about so many of their terms, which every task gets.
BLOCK_TERMS = 1 << 18
#: A shard is closed when it has so many documents or occurrences of terms.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 21
FIRST_READ, LONGEST_READ = 4, 1024
PACKED = "doc_id long, n long, terms array<int>, counts array<int>"

#: Bytes that are no part of a term become spaces, A-Z become a-z; all bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """item_id, term: the distinct terms of every item."""

    def split(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            found = [(i, t) for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms_of(s))]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([x[0] for x in found], pa.int64()), "term": pa.array([x[1] for x in found], pa.binary())})

    own = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL")
    return own.mapInArrow(split, "item_id long, term binary").distinct()


def packed(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """PACKED rows of documents with at least one term: all their terms are counted in n, those of the vocabulary (numbers from 1) one by one."""
    known, base = vocabulary.get, len(vocabulary) + 1

    def count(batches):
        import pyarrow as pa

        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            n, own = np.zeros(len(texts), np.int64), []
            for k, text in enumerate(texts):
                words = terms_of(text)
                n[k] = len(words)
                own.append(np.fromiter(filter(None, map(known, words)), np.int64))
            doc = np.repeat(np.arange(len(texts)), [len(x) for x in own])
            cell, times = np.unique(doc * base + np.concatenate(own), return_counts=True)
            held = np.flatnonzero(n)
            at = np.searchsorted(cell, np.r_[held, len(texts)] * base)
            lists = lambda values: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).take(pa.array(held)), "n": pa.array(n[held]), "terms": lists(cell % base), "counts": lists(times),
            })

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return own.mapInArrow(count, PACKED)


class Shard:
    """Impact lists of some documents; doc-major arrays serve direct accesses."""

    def __init__(self, parts: list[tuple], weight: np.ndarray, n_docs: int, n_terms: int):
        self.ids, n, size, self.term, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.begin = np.cumsum(np.r_[0, size])
        length = np.array([100 - 90 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)  # Python's integers do not overflow
        doc = np.repeat(np.arange(len(self.ids)), size)
        self.impact = weight[self.term] * ((1_000_000_000 * count) // (1000 * count + 8 * length[doc]))
        # by term, then falling impact, then document
        order = np.lexsort((-self.impact, self.term))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.doc_at, self.impact_at = doc[order], self.impact[order]
        self.list = np.cumsum(np.r_[0, np.bincount(self.term, minlength=len(weight))])
        self.wanted, self.seen = np.zeros(len(weight), bool), np.zeros(len(order), bool)
        self.accessed = 0

    def _score(self, docs: np.ndarray) -> np.ndarray:
        """Direct accesses: the scores of documents, whose positions are marked in all lists that are wanted."""
        size = self.begin[docs + 1] - self.begin[docs]
        at = np.repeat(self.begin[docs] - np.cumsum(np.r_[0, size[:-1]]), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(docs)), size)
        here = self.wanted[self.term[at]]
        at = at[here]
        self.seen[self.place[at]] = True
        self.accessed += len(docs)
        # sums stay far below 2 ** 53
        return np.bincount(owner[here], self.impact[at], len(docs)).astype(np.int64)

    def best(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents for the terms, of those that score at least `least`, and maybe more."""
        first, end = self.list[terms], self.list[terms + 1]
        lists = [(a, b) for a, b in zip(first.tolist(), end.tolist(), strict=True) if a < b]
        self.wanted[terms] = True
        met = np.zeros(len(self.ids), bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best = [a for a, _ in lists]  # the first position of each list that has not been seen
        depth, step = 0, FIRST_READ
        while True:
            read = np.concatenate([self.doc_at[a + depth : min(b, a + depth + step)] for a, b in lists] or [ids])
            new = np.unique(read[~met[read]])
            if len(new):
                met[new] = True
                found = self._score(new)
                good = found >= least
                ids, scores = np.r_[ids, self.ids[new[good]]], np.r_[scores, found[good]]
                if len(ids) > k:
                    top = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[top], scores[top]
                if len(ids) == k:
                    least = max(least, int(scores.min()))
            bound = 0
            for t, (_, b) in enumerate(lists):
                ahead = self.seen[best[t] : b]
                if len(ahead) and ahead[0]:
                    stop = int(ahead.argmin())
                    best[t] = b if ahead[stop] else best[t] + stop
                bound += int(self.impact_at[best[t]]) if best[t] < b else 0
            if bound < least:
                break
            depth, step = depth + step, min(2 * step, LONGEST_READ)
        for a, b in lists:
            self.seen[a:b] = False
        self.wanted[terms] = False
        return ids, scores


def _shards(batches) -> Iterator[list[tuple]]:
    """Arrays of the documents of a task, a shard's worth at a time."""
    parts, docs, postings = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            terms, counts = part.column(2), part.column(3)
            size = np.diff(terms.offsets.to_numpy())
            parts.append((
                part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), size,
                terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            ))
            docs, postings = docs + part.num_rows, postings + int(size.sum())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield parts
                parts, docs, postings = [], 0, 0
    if parts:
        yield parts


def _block(docs: DataFrame, items: dict[int, list[bytes]], k: int) -> DataFrame:
    """item_id, doc_id, score: the best documents of every task for a block of items."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in items.values() for t in own}), 1)}
    rows = written(packed(docs, vocabulary), "search-postings")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = len(vocabulary) + 1

    def holders(batches):
        import pyarrow as pa

        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        term = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term), "df": pa.array(held[term])})

    found = rows.select("terms").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df")).collect()  # a row for each term of the block
    weight = np.zeros(size, np.int64)
    for term, df in found:
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    # a term that weighs nothing changes no score
    asked = {i: np.array([x for x in sorted(vocabulary[t] for t in own) if weight[x] > 0], np.int64) for i, own in items.items()}

    def search(batches):
        import pyarrow as pa

        top: dict[int, list[tuple[int, int]]] = {}
        for parts in _shards(batches):
            shard = Shard(parts, weight, n_docs, n_terms)
            for item, terms in asked.items():
                own = top.get(item, [])
                ids, scores = shard.best(terms, k, own[-1][0] if len(own) == k else 1)
                if len(ids):
                    own = own + list(zip(scores.tolist(), ids.tolist(), strict=True))
                    top[item] = sorted(own, key=lambda x: (-x[0], x[1]))[:k]
        flat = [(item, doc, score) for item, own in top.items() for score, doc in own]
        yield pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in flat], pa.int64()) for i, c in enumerate(("item_id", "doc_id", "score"))})

    return rows.mapInArrow(search, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score highest for each item, above 0, equal scores by id.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. Rows
    that share an item_id are one item with the terms of all; rows without an id, and items without
    terms, give nothing. Documents without an id do not count; rows that share a doc_id are documents
    of their own. A null text has no terms, and a document without terms does not count.
    """
    pairs = written(item_terms(items, key, text), "search-items")
    n_blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    found = []
    for b in range(n_blocks):
        own: dict[int, list[bytes]] = {}
        for item, term in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).toLocalIterator():
            own.setdefault(item, []).append(bytes(term))
        if own:
            found.append(written(_block(docs, dict(sorted(own.items())), k), "search-best"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
