"""Scores texts with a hierarchical Pitman-Yor model: restaurants of one word of context over a shared parent.

Every word has a restaurant for the words after it; all share one parent, the root. Customers of a
context are its training tokens, customers of the root are the tables of the contexts. Gibbs sweeps
draw, for every context and word, at how many tables the customers sit, from the exact distribution
given the tables of the sweep before (generalised Stirling numbers, see `seating`); a text's score
averages the predictive probabilities of the kept sweeps.

Layout. Tokens are dealt out once: a rare word lies in one part with all its contexts, so its share of
the root is known there; a frequent word lies with its context if that is rare, else where the pair of
both falls. What is left to be told after a sweep are sums: of the frequent words, a list of fixed length
that every task gets; of every rare context, from the parts that hold some of it to the context's home and
back, as one packed row for two parts. Which words are frequent decides how sums travel, not what they are.
Seats, messages and answers are written, so a sweep that loses an executor starts from the one before.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import forget, keyed, partitions, written
from clipledger.llm.seating import drawn_tables, stirling
from clipledger.llm.spans import mixed, slices, text_bytes, word_names

#: Frequent words: at most so many, whose sums every task gets as lists. A rare word's name is above.
HEAD = 65_535
#: Name of the end of a text.
END = np.uint64(0x5EED0F7E57000001)
#: Tokens that a task gathers before it hands them on, and that a part holds on average.
GATHERED, PART_TOKENS = 500_000, 4_000_000
STRENGTH = 1.0
BURN, KEEP = 2, 2


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes."""
    import zstandard

    press, out = zstandard.ZstdCompressor(level=1), [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = press.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
        out.append(struct.pack("<4sQQ", a.dtype.str[1:].encode(), len(a), len(raw)) + raw)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    press, out, at = zstandard.ZstdDecompressor(), [], 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        kind, n, size = struct.unpack_from("<4sQQ", data, at)
        at += 20
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        raw = np.frombuffer(press.decompress(data[at : at + size]), np.uint8) if n else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += size
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _undeltas(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens of the texts, each text's end included, and where texts start."""
    names, at = word_names(*text_bytes(column))
    return np.insert(names, at[1:], END), at + np.arange(len(at))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(keys, return_inverse=True)
    return own, np.bincount(back, n, len(own)).astype(np.int64)


def vocabulary(train: DataFrame) -> DataFrame:
    """word (name), n: of all training tokens; counts are added up within tasks first."""

    def count(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            word, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            for i in range(0, len(word), 100_000):
                yield pa.RecordBatch.from_pydict({"word": word[i : i + 100_000].view(np.int64), "n": n[i : i + 100_000]})

        for batch in slices(batches, 0):
            names, _ = _tokens(batch.column(0))
            held.append(np.unique(names, return_counts=True))
            size += len(held[-1][0])
            if size > 2 * GATHERED:
                held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > GATHERED:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return train.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """Counts of the training tokens: of all, of the frequent words (by id), and what the discount needs."""

    total: int
    kinds: int
    discount: float
    names: np.ndarray  # of frequent words, ascending
    ids: np.ndarray  # their ids
    counts: np.ndarray  # by id
    head: int  # frequent words at most; as a context, the start of a text

    def id_of(self, names: np.ndarray) -> np.ndarray:
        """Ids of frequent words, -1 for others."""
        if not len(self.names):
            return np.full(len(names), -1, np.int64)
        k = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[k] == names, self.ids[k], -1)


def discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.05


def counted(words: DataFrame, head: int = HEAD) -> Words:
    total, kinds, ones, twos = words.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = words.orderBy(F.desc("n"), "word").limit(head).toPandas()
    names, counts = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(names)
    return Words(total or 0, kinds, discount(ones, twos), names[order], order.astype(np.int64), counts, head)


def _dealt(docs: DataFrame, words, parts: int) -> DataFrame:
    """part, data: token counts by (word, context, document) of (doc_id, train, text)."""

    def deal(batches):
        import pyarrow as pa

        w = words.value
        held, size = [], 0

        def flush():
            name, context, doc, train = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            own = w.id_of(name)
            key = np.where(own >= 0, own.astype(np.uint64), name)
            pair = np.where(context > w.head, context, own.astype(np.uint64) << np.uint64(20) | context)
            part = mixed(np.where(own >= 0, pair, name)) % np.uint64(parts)
            docs, doc = np.unique(doc, return_inverse=True)
            learn = np.zeros(len(docs), np.uint8)
            learn[doc] = train
            order = np.lexsort((doc, context, key, own < 0, part))
            part, key, rare, context, doc = (x[order] for x in (part, key, own < 0, context, doc))
            new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (rare[1:] != rare[:-1]) | (context[1:] != context[:-1]) | (doc[1:] != doc[:-1])]
            at = np.flatnonzero(new)
            n = np.diff(np.r_[at, len(part)]).astype(np.uint32)
            part, key, rare, context, doc = (x[at] for x in (part, key, rare, context, doc))
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(edge, np.r_[edge[1:], len(part)], strict=True):
                seen, local = np.unique(doc[a:b], return_inverse=True)
                data = packed(
                    _deltas(docs[seen]), learn[seen], _deltas(key[a:b]), rare[a:b].astype(np.uint8),
                    context[a:b], local.astype(np.uint32), n[a:b],
                )
                yield pa.RecordBatch.from_pydict({"part": pa.array([int(part[a])], pa.int32()), "data": pa.array([data], pa.binary())})

        for batch in slices(batches, 2):
            names, at = _tokens(batch.column(2))
            own = w.id_of(names)
            context = np.where(own >= 0, own.astype(np.uint64), names)
            context = np.r_[np.uint64(0), context[:-1]]
            context[at[:-1]] = w.head
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            ids, train = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            held.append((names, context, ids[row], train[row]))
            size += len(names)
            if size >= GATHERED:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return docs.select("doc_id", "train", "text").mapInArrow(deal, "part int, data binary")


_PART = "part int, tokens binary, train binary, ones long, twos long"


def _merged(dealt: DataFrame, parts: int) -> DataFrame:
    """One row for each part: its tokens, its training counts, and what the discount needs."""

    def merge(batches):
        import pyarrow as pa

        got: dict[int, list] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got.setdefault(part, []).append(data)
        for part, blobs in got.items():
            columns, docs, flags, base = [], [], [], 0
            while blobs:
                ids, learn, key, rare, context, local, n = unpacked(blobs.pop())
                columns.append((_undeltas(key), rare, context, local + np.uint32(base), n))
                docs.append(_undeltas(ids))
                flags.append(learn)
                base += len(ids)
            key, rare, context, doc, n = (np.concatenate(x) for x in zip(*columns, strict=True))
            columns.clear()
            learn = np.concatenate(flags).astype(bool)
            order = np.lexsort((context, key, rare))
            key, rare, context, doc, n = (x[order] for x in (key, rare, context, doc, n))
            new = np.r_[True, (key[1:] != key[:-1]) | (rare[1:] != rare[:-1]) | (context[1:] != context[:-1])]
            at = np.flatnonzero(new)
            size = np.diff(np.r_[at, len(key)])
            c = np.add.reduceat(np.where(learn[doc], n, 0).astype(np.int64), at)
            key, rare, context = key[at], rare[at], context[at]
            tokens = packed(_deltas(np.concatenate(docs)), size.astype(np.uint32), doc.astype(np.uint32), n)
            train = packed(_deltas(key), rare, context, c)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "tokens": pa.array([tokens], pa.binary()), "train": pa.array([train], pa.binary()),
                "ones": pa.array([int((c == 1).sum())]), "twos": pa.array([int((c == 2).sum())]),
            })

    return dealt.repartitionById(parts, "part").mapInArrow(merge, _PART)


#: A row that parts read or write: what it is, the part it is for, the part or round it is from.
_ROW = "kind int, part int, sender int, data binary"
TRAIN, TOKENS, STATE, TOLD, SUMS, ANSWER = range(6)


def _row(kind: int, part: int, sender: int, *arrays: np.ndarray):
    import pyarrow as pa

    values = [kind, part, sender]
    columns = [pa.array([x], pa.int32()) for x in values] + [pa.array([packed(*arrays)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "sender", "data"])


def _added(rows: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The sums of the parts' lists, added up in Spark by place; what comes back has the lists' fixed length."""

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                for kind, values in enumerate(unpacked(blob)):
                    at = np.flatnonzero(values)
                    yield pa.RecordBatch.from_pydict({"kind": np.full(len(at), kind, np.int32), "at": at, "n": values[at]})

    out = [np.zeros(n, np.int64) for n in sizes]
    total = rows.select("data").mapInArrow(spread, "kind int, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).toPandas()
    for kind in range(len(sizes)):
        own = total[total["kind"] == kind]
        out[kind][own["at"].to_numpy()] = own["n"].to_numpy()
    return out


def _answered(told: DataFrame, parts: int, round_: int) -> DataFrame:
    """Homes add up what parts tell of each rare context and answer every part in the order of its own list."""

    def answer(batches):
        senders: dict[int, list] = {}
        for batch in batches:
            for home, sender, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                senders.setdefault(home, []).append((sender, unpacked(data)))
        for home, got in senders.items():
            names, back = np.unique(np.concatenate([_undeltas(x[0]) for _, x in got]), return_inverse=True)
            sums = [np.bincount(back, np.concatenate(v), len(names)).astype(np.int64) for v in zip(*(x[1:] for _, x in got), strict=True)]
            at = 0
            for sender, lists in got:
                own = back[at : at + len(lists[0])]
                at += len(own)
                yield _row(ANSWER + round_, sender, home, *(x[own] for x in sums))

    return written(told.repartitionById(parts, "part").mapInArrow(answer, _ROW), "lm-answers")


@dataclass
class Seats:
    """What all parts know after a sweep: tables of frequent contexts, customers and tables of frequent words, the root's totals."""

    tables: np.ndarray
    guests: np.ndarray
    root_tables: np.ndarray
    all_guests: int
    all_tables: int


@dataclass
class Model:
    words: Words
    discount: float
    parts: int
    burn: int
    keep: int
    context_counts: np.ndarray | None = None
    history: dict[int, Seats] = field(default_factory=dict)

    def every(self, round_: int) -> bool:
        """In the first round and the kept ones parts ask for all their rare contexts, in others for those they draw tables in."""
        return round_ == 0 or round_ > self.burn

    def root(self, guests: np.ndarray, tables: np.ndarray, seats: Seats) -> np.ndarray:
        """The root's probability of words with so many customers and tables; of an unknown word with none."""
        d = self.words.discount
        rest = (STRENGTH + d * seats.all_tables) / (self.words.kinds + 1)
        return (guests - d * tables + rest) / (STRENGTH + seats.all_guests)

    def root_draw(self, guests: np.ndarray, tables: np.ndarray, seats: Seats, rng) -> np.ndarray:
        base = np.full(len(guests), 1.0 / (self.words.kinds + 1))
        d = self.words.discount
        others = STRENGTH + d * np.maximum(seats.all_tables - tables, 0)
        return drawn_tables(guests, others, base, d, stirling(d), rng)


class PartSeats:
    """The seats of one part."""

    def __init__(self, model: Model, part: int, train: bytes):
        key, self.rare, self.context, self.c = unpacked(train)
        self.key, self.model, self.part = _undeltas(key), model, part
        new = np.r_[True, (self.key[1:] != self.key[:-1]) | (self.rare[1:] != self.rare[:-1])] if len(self.key) else np.zeros(0, bool)
        self.word = np.cumsum(new) - 1  # the part's words, in order
        self.n_words, self.is_rare = int(new.sum()), self.rare[new] == 1
        self.head = self.key[new].astype(np.int64) * ~self.is_rare
        self.free = np.flatnonzero(self.c > 1)
        self.t = np.minimum(self.c, 1)
        self.guests = self._guests()
        self.root_tables = np.minimum(self.guests, 1)
        # rare contexts by home, then name; each pair's place among them
        self.far = np.flatnonzero(self.context > model.words.head)
        names, back = np.unique(self.context[self.far], return_inverse=True)
        home = (mixed(names) % np.uint64(model.parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.names, self.home, self.far_at = names[order], home[order], place[back]
        self.near_at = np.where(self.context > model.words.head, model.words.head, self.context).astype(np.int64)
        drawn = np.zeros(len(names), bool)
        drawn[self.far_at[self.c[self.far] > 1]] = True
        self.drawn = drawn
        self.far_counts = self.far_first = self.far_more = np.zeros(len(names), np.int64)

    def _guests(self) -> np.ndarray:
        return np.bincount(self.word, self.t, self.n_words).astype(np.int64)

    def _asked(self, round_: int) -> np.ndarray:
        return np.flatnonzero(self.drawn | self.model.every(round_))

    def take_state(self, data: bytes) -> None:
        self.t = np.minimum(self.c, 1)
        self.t[self.free], tables = unpacked(data)
        self.guests = self._guests()
        self.root_tables = np.minimum(self.guests, 1)
        self.root_tables[self.is_rare] = tables

    def take_answers(self, round_: int, answers: list[tuple[int, bytes]]) -> None:
        """Answers of all homes: counts and first tables of contexts, or tables beyond the first ones."""
        asked = self._asked(round_)
        lists = [unpacked(data) for _, data in sorted(answers)]
        sums = []
        for values in zip(*lists, strict=True):
            whole = np.zeros(len(self.names), np.int64)
            whole[asked] = np.concatenate(values)
            sums.append(whole)
        if sums and round_ == 0:
            self.far_counts, self.far_first = sums
        elif sums:
            self.far_more = sums[0]

    def tell(self, round_: int):
        """Messages to the homes of rare contexts."""
        asked, first = self._asked(round_), np.minimum(self.c, 1)
        values = [self.c, first] if round_ == 0 else [self.t - first]
        sums = [np.bincount(self.far_at, v[self.far], len(self.names)).astype(np.int64)[asked] for v in values]
        edge = np.flatnonzero(np.diff(self.home[asked], prepend=-1))
        for a, b in zip(edge, np.append(edge, len(asked))[1:], strict=True):
            yield _row(TOLD, int(self.home[asked[a]]), self.part, _deltas(self.names[asked[a:b]]), *(x[a:b] for x in sums))

    def state(self):
        return _row(STATE, self.part, 0, self.t[self.free], self.root_tables[self.is_rare])

    def sums(self):
        """Tables and customers of frequent contexts, customers of frequent words, and what rare words add to the root's totals."""
        near = self.context <= self.model.words.head
        size = self.model.words.head
        lists = [np.bincount(self.near_at[near], x[near], size + 1) for x in (self.t, self.c)]
        own = ~self.is_rare
        lists.append(np.bincount(self.head[own], self.guests[own], size))
        lists.append(np.array([self.guests[self.is_rare].sum(), self.root_tables[self.is_rare].sum()]))
        return _row(SUMS, -1, self.part, *(x.astype(np.int64) for x in lists))

    def of_contexts(self, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """For each pair the value of its context."""
        out = near[self.near_at]
        out[self.far] = far[self.far_at]
        return out

    def root(self, seats: Seats) -> np.ndarray:
        """The root's probability of each word of the part."""
        guests = np.where(self.is_rare, self.guests, seats.guests[self.head])
        tables = np.where(self.is_rare, self.root_tables, seats.root_tables[self.head])
        return self.model.root(guests, tables, seats)

    def sweep(self, round_: int) -> None:
        """Draws the tables of a round from the seats and answers of the one before."""
        seats, rng, f = self.model.history[round_ - 1], np.random.default_rng((11, self.part, round_)), self.free
        d = self.model.discount
        if len(f):
            all_tables = self.of_contexts(seats.tables, self.far_first + self.far_more)[f]
            others = STRENGTH + d * np.maximum(all_tables - self.t[f], 0)
            self.t[f] = drawn_tables(self.c[f], others, self.root(seats)[self.word[f]], d, stirling(d), rng)
        self.guests = self._guests()
        rare = self.is_rare & (self.guests > 0)
        self.root_tables[rare] = self.model.root_draw(self.guests[rare], self.root_tables[rare], seats, rng)

    def chances(self, round_: int) -> np.ndarray:
        """The predictive probability of each pair after a round."""
        seats, d = self.model.history[round_], self.model.discount
        rest = STRENGTH + d * self.of_contexts(seats.tables, self.far_first + self.far_more)
        count = self.of_contexts(self.model.context_counts, self.far_counts)
        return (self.c - d * self.t + rest * self.root(seats)[self.word]) / (STRENGTH + count)


def _by_part(batches) -> dict[int, dict[int, list]]:
    """A task's rows: for each part, for each kind, (sender, data)."""
    out: dict[int, dict[int, list]] = {}
    for batch in batches:
        for kind, part, sender, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            out.setdefault(part, {}).setdefault(kind, []).append((sender, data))
    return out


def _as_rows(parts: DataFrame, kind: int, column: str) -> DataFrame:
    return parts.select(F.lit(kind).alias("kind"), "part", F.lit(0).alias("sender"), F.col(column).alias("data"))


def _together(frames: list[DataFrame], parts: int) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).repartitionById(parts, "part")


def _root_tables(model: Model, round_: int, guests: np.ndarray, tables: np.ndarray, spark) -> np.ndarray:
    """Tables of the frequent words in the root, drawn in tasks."""
    shared = spark.sparkContext.broadcast((model, guests, tables))

    def draw(batches):
        import pyarrow as pa

        own, guests, tables = shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            if len(at):
                rng = np.random.default_rng((13, round_, int(at[0])))
                n = own.root_draw(guests[at], tables[at], own.history[round_ - 1], rng)
                yield pa.RecordBatch.from_pydict({"at": at, "n": n.astype(np.int64)})

    found = spark.range(0, len(guests), 1, partitions(spark)).mapInArrow(draw, "at long, n long").toPandas()
    out = np.zeros(len(guests), np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out


def learned(parts: DataFrame, model: Model) -> list[DataFrame]:
    """Gibbs sweeps, each a job over the parts; fills the model and returns the rows that scoring needs beside the parts."""
    spark, head = parts.sparkSession, model.words.head
    train = _as_rows(parts, TRAIN, "train")
    state, answers, before, kept = None, None, [], []
    for k in range(model.burn + model.keep + 1):  # round 0 seats all at one table a dish
        shared = spark.sparkContext.broadcast(model)

        def run(batches, k=k, shared=shared):
            for part, got in _by_part(batches).items():
                own = PartSeats(shared.value, part, got[TRAIN][0][1])
                if k:
                    if k > 1:
                        own.take_state(got[STATE][0][1])
                    for r in {0, k - 1}:
                        own.take_answers(r, got.get(ANSWER + r, []))
                    own.sweep(k)
                yield own.state()
                yield own.sums()
                yield from own.tell(k)

        frames = [train, *before, *([state] if k > 1 else []), *([answers] if k > 1 else [])]
        done = written(_together(frames, model.parts).mapInArrow(run, _ROW), "lm-sweep")
        tables, counts, guests, rare = _added(done.where(F.col("kind") == SUMS), [head + 1, head + 1, head, 2])
        after = _answered(done.where(F.col("kind") == TOLD), model.parts, k)
        if k == 0:
            model.context_counts, root_tables, before = counts, np.minimum(guests, 1), [after]
        else:
            root_tables = _root_tables(model, k, guests, root_tables, spark)
        model.history[k] = Seats(tables, guests, root_tables, int(guests.sum() + rare[0]), int(root_tables.sum() + rare[1]))
        state, answers = done.where(F.col("kind") == STATE), after
        if k > model.burn:
            kept += [state.withColumn("sender", F.lit(k)), after]
    return before + kept


def part_scores(model: Model, part: int, got: dict[int, list]) -> tuple[np.ndarray, ...]:
    """doc_id, n_tokens, n_known, base, score: a part's share of each document."""
    own, words = PartSeats(model, part, got[TRAIN][0][1]), model.words
    ids, size, doc, n = unpacked(got[TOKENS][0][1])
    docs, n, doc = _undeltas(ids), n.astype(np.int64), doc.astype(np.int64)
    seen = np.bincount(own.word, own.c, own.n_words).astype(np.int64)
    known = np.where(own.is_rare, seen, words.counts[np.minimum(own.head, max(0, len(words.counts) - 1))] if len(words.counts) else 0)
    base = np.log10((known + 0.5) / (words.total + 0.5 * (words.kinds + 1)))
    chance, states = np.zeros(len(own.key)), dict(got[STATE])
    own.take_answers(0, got.get(ANSWER, []))
    for k in range(model.burn + 1, model.burn + model.keep + 1):
        own.take_state(states[k])
        own.take_answers(k, got.get(ANSWER + k, []))
        chance += own.chances(k) / model.keep
    group = np.repeat(np.arange(len(size)), size)
    w = own.word[group]
    ids, back = np.unique(docs, return_inverse=True)
    doc = back[doc]
    sums = [np.bincount(doc, x, len(ids)) for x in (n, n * (known[w] > 0), n * base[w], n * np.log10(chance[group]))]
    return ids, sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], sums[3]


def dealt_parts(docs: DataFrame, head: int = HEAD, burn: int = BURN, keep: int = KEEP) -> tuple[DataFrame, Model]:
    """The parts of (doc_id, train, text), written, and a model without sweeps. The number of parts grows with the tokens."""
    spark = docs.sparkSession
    counts = written(vocabulary(docs.where("train")), "lm-words")
    words = counted(counts, head)
    forget(counts)
    n_parts = max(partitions(spark), -(-words.total // PART_TOKENS))
    parts = written(_merged(_dealt(docs, spark.sparkContext.broadcast(words), n_parts), n_parts), "lm-parts")
    ones, twos = parts.agg(F.sum("ones"), F.sum("twos")).first()
    return parts, Model(words, discount(ones or 0, twos or 0), n_parts, burn, keep)


def scored(docs: DataFrame, held_out: str, head: int = HEAD, burn: int = BURN, keep: int = KEEP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document with an id.

    held_out: SQL over doc_id; the model learns from the others. A null text has its end alone. Rows
    that share an id count as one document. With nothing to learn from, every token is unknown.
    `burn` sweeps are dropped, `keep` averaged.
    """
    docs = keyed(docs, "doc_id", text="text").select(F.col("doc_id").cast("long"), F.expr(f"NOT ({held_out})").alias("train"), "text")
    parts, model = dealt_parts(docs, head, burn, keep)
    spark, n_parts, words = docs.sparkSession, model.parts, model.words
    known = learned(parts, model)
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        import pyarrow as pa

        for part, got in _by_part(batches).items():
            found = part_scores(shared.value, part, got)
            bucket = (mixed(found[0].view(np.uint64)) % np.uint64(n_parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = [order[a:b] for a, b in zip(edge, np.r_[edge[1:], len(order)], strict=True)]
            data = [packed(*(x[r] for x in found)) for r in rows]
            yield pa.RecordBatch.from_pydict({"bucket": bucket[order][edge], "data": pa.array(data, pa.binary())})

    def total(batches):
        import pyarrow as pa

        held = [unpacked(x) for batch in batches for x in batch.column(1).to_pylist()]
        if held:
            ids, *sums = (np.concatenate(x) for x in zip(*held, strict=True))
            own, back = np.unique(ids, return_inverse=True)
            sums = [np.bincount(back, x, len(own)).astype(x.dtype) for x in sums]
            yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), (own, *sums), strict=True)))

    # a part's shares of many documents travel as one row
    rows = _together([_as_rows(parts, TRAIN, "train"), _as_rows(parts, TOKENS, "tokens"), *known], n_parts)
    shares = rows.mapInArrow(score, "bucket int, data binary").repartitionById(n_parts, "bucket")
    summed = shares.mapInArrow(total, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return summed.select(
        "doc_id", F.expr(held_out).alias("held_out"), "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
