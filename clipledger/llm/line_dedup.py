"""Reversible line dedup: cuckoo filters in shards, backed by exact reference counts.

The key of a line is the line without white space at its ends, A-Z as a-z, named by 128 bits of
blake2b. An index keeps three kinds of tables:

* postings (key, doc_id): which documents hold a key;
* states (key, n_docs, keeper): how many documents count on a key and the smallest of them; the newest
  row of a key counts;
* filters: for each shard of keys a cuckoo filter with one fingerprint for each key in use. A key that a
  filter does not know is new, so it is counted without a look at the states; what a filter seems
  to know is joined with them. When the last document of a key goes, so does its fingerprint.

Every update appends tables of its own and then a manifest, which names the tables in force; an update
that dies half way leaves the index as it was. A hot key is one row in the states and in its
shard; its postings are dealt by key and document, so no task holds them all.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
from array import array
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.llm.common import DROP_SHUFFLES
from clipledger.llm.spans import slices
from clipledger.session import scratch_path, setting

#: Keys that a shard is meant for; slots of a bucket; how full a layer may be; moves before a layer counts as full.
SHARD_KEYS, SLOTS, FULL, KICKS = 1 << 13, 4, 0.9, 200
#: A batch goes in as so many lots, one after another.
LOTS = 2
LEAST_CHARS = 10
POSTING = "key binary, doc_id long, lot int, gen long"
STATE = "key binary, n_docs long, keeper long, gen long"
FILTER = "shard long, n_keys long, layers array<binary>"


def line_keys(text: str | None, least: int = LEAST_CHARS) -> list[bytes | None]:
    """The key of every line of a text; null where it has fewer than `least` code points."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        own = line.strip().lower()  # of bytes: white space and letters of ASCII alone
        short = len(own) < least or (len(own) < 4 * least and len(own.decode()) < least)
        out.append(None if short else hashlib.blake2b(own, digest_size=16).digest())
    return out


class Cuckoo:
    """Cuckoo filter over 128-bit keys, as many copies of a fingerprint as keys that have it.

    A full layer is closed and one of twice its size goes on. Copies are taken out of the newest
    layer that has one: a bucket of a larger layer lies within one of every smaller layer, so what is
    left still stands for the other keys with that fingerprint.
    """

    def __init__(self, layers: Iterable[bytes] = (), expected: int = 0):
        self.layers = [array("H", raw) for raw in layers]
        if sys.byteorder == "big":
            for x in self.layers:
                x.byteswap()
        self.used = sum(1 for x in self.layers[-1] if x) if self.layers else 0
        self.expected = max(expected, 8)

    def dump(self) -> list[bytes]:
        out = [array("H", x) for x in self.layers]
        if sys.byteorder == "big":
            for x in out:
                x.byteswap()
        return [x.tobytes() for x in out]

    @staticmethod
    def _print(key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[14:16], "little") or 1
        return mark, int.from_bytes(key[6:14], "little"), mark * 0x9E3779B1 >> 8

    def _homes(self, layer: array, place: int, turn: int) -> tuple[int, int]:
        mask = len(layer) // SLOTS - 1
        return place & mask, (place ^ turn) & mask

    def __contains__(self, key: bytes) -> bool:
        mark, place, turn = self._print(key)
        for layer in self.layers:
            a, b = self._homes(layer, place, turn)
            if mark in layer[SLOTS * a : SLOTS * a + SLOTS] or mark in layer[SLOTS * b : SLOTS * b + SLOTS]:
                return True
        return False

    def _grow(self) -> None:
        size = 2 * len(self.layers[-1]) if self.layers else SLOTS
        while not self.layers and size * FULL < self.expected:
            size *= 2
        self.layers.append(array("H", bytes(2 * size)))
        self.used = 0

    def add(self, key: bytes) -> None:
        if not self.layers or self.used >= FULL * len(self.layers[-1]):
            self._grow()
        mark, place, turn = self._print(key)
        layer = self.layers[-1]
        moved: list[int] = []
        for home in self._homes(layer, place, turn):
            at = self._free(layer, home)
            if at >= 0:
                layer[at] = mark
                self.used += 1
                return
        # move others to their second bucket; if that does not end, undo it and go on in a new layer
        mask, home = len(layer) // SLOTS - 1, place & (len(layer) // SLOTS - 1)
        for k in range(KICKS):
            at = SLOTS * home + (k * 7 + mark) % SLOTS
            moved.append(at)
            layer[at], mark = mark, layer[at]
            home = (home ^ (mark * 0x9E3779B1 >> 8)) & mask
            free = self._free(layer, home)
            if free >= 0:
                layer[free] = mark
                self.used += 1
                return
        for at in reversed(moved):
            layer[at], mark = mark, layer[at]
        self._grow()
        self.add(key)

    @staticmethod
    def _free(layer: array, home: int) -> int:
        for at in range(SLOTS * home, SLOTS * home + SLOTS):
            if not layer[at]:
                return at
        return -1

    def discard(self, key: bytes) -> bool:
        """Takes out one copy; whether there was one."""
        mark, place, turn = self._print(key)
        for k in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[k]
            for home in self._homes(layer, place, turn):
                for at in range(SLOTS * home, SLOTS * home + SLOTS):
                    if layer[at] == mark:
                        layer[at] = 0
                        self.used -= k == len(self.layers) - 1
                        return True
        return False


@dataclass
class Manifest:
    gen: int = 0
    bits: int = 0
    n_keys: int = 0
    postings: list[str] = field(default_factory=list)
    states: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    filters: str | None = None


class LineIndex:
    """An index in a shared folder. `LineIndex(spark, folder)` opens it as its last whole update left it, or a new one."""

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = LEAST_CHARS):
        self.spark, self.least = spark, least
        self.folder, self.now = folder or scratch_path(spark, "line-index"), Manifest()
        if folder and self._exists(f"{folder}/manifest"):
            said = spark.read.text(f"{folder}/manifest").selectExpr("max_by(value, CAST(get_json_object(value, '$.gen') AS LONG))")
            self.now = Manifest(**json.loads(said.first()[0]))

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        path = os.path.join(self.folder, kind, scratch_path(self.spark, "t").rsplit("-", 1)[1])
        with setting(self.spark, DROP_SHUFFLES, "true"):
            df.write.option("compression", "zstd").parquet(path)
        return path

    def _commit(self, new: Manifest) -> None:
        new.gen += 1
        self.spark.createDataFrame([(json.dumps(asdict(new)),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/manifest")
        self.now = new

    def _next(self) -> Manifest:
        return Manifest(**json.loads(json.dumps(asdict(self.now))))

    # --- tables in force

    def postings(self) -> DataFrame:
        """key, doc_id, of documents that have not been removed since."""
        rows = self._read(self.now.postings, POSTING)
        if self.now.removed:
            gone = self._read(self.now.removed, "doc_id long, gen long").groupBy("doc_id").agg(F.max("gen").alias("gone"))
            rows = rows.join(gone, "doc_id", "left").where("gone IS NULL OR gen > gone")
        return rows.select("key", "doc_id")

    def states(self) -> DataFrame:
        """key, n_docs, keeper of every key in use."""
        rows = self._read(self.now.states, STATE)
        last = rows.groupBy("key").agg(F.max_by(F.struct("n_docs", "keeper"), "gen").alias("last"))
        return last.select("key", "last.*").where("n_docs > 0")

    def drops(self) -> DataFrame:
        """doc_id, key: lines that a document loses, as a document with a smaller id has them."""
        # written, so that both sides of the join are shuffled and the postings of a hot key can be split
        shared = self._read([self._write(self.states().where("n_docs > 1").select("key", "keeper"), "shared")], "key binary, keeper long")
        return self.postings().join(shared, "key").where("doc_id <> keeper").select("doc_id", "key")

    # --- updates

    def _keyed(self, docs: DataFrame, gen: int) -> DataFrame:
        least = self.least

        def post(batches):
            import pyarrow as pa

            for batch in slices(batches, 1):
                keys, ids = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = set(line_keys(text, least)) - {None}
                    keys += own
                    ids += [doc_id] * len(own)
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "doc_id": pa.array(ids, pa.int64())})

        found = _plain(docs).mapInArrow(post, "key binary, doc_id long").distinct()
        lot = F.pmod(F.xxhash64("doc_id"), F.lit(LOTS)).cast("int")
        return found.select("key", "doc_id", lot.alias("lot"), F.lit(gen).cast("long").alias("gen"))

    def _shard(self, bits: int):
        """The first bits of a key."""
        return F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)

    def _passed(self, keys: DataFrame, filters: str | None, bits: int) -> str:
        """Runs keys (key, n_docs, keeper, what) through the filters of their shards and writes what comes out.

        what: "add" and "drop" change the filter; "ask" adds the key if the filter does not know it. Rows
        come out with `known`, followed by the filters, which are rows without a key.
        """
        old = self._read([filters] if filters else [], "key binary, " + FILTER).where("key IS NULL").drop("key")

        def turn(left, right):
            import pyarrow as pa

            state = right.to_pylist()[0] if right.num_rows else None
            shard = state["shard"] if state else left.column("shard")[0].as_py()
            cuckoo = Cuckoo(state["layers"] if state else (), left.num_rows)
            n_keys = state["n_keys"] if state else 0
            rows, order = left.to_pylist(), {"drop": 0, "add": 1, "ask": 2}
            for row in sorted(rows, key=lambda r: order[r["what"]]):
                if row["what"] == "drop":
                    n_keys -= cuckoo.discard(row["key"])
                    continue
                row["known"] = row["what"] == "ask" and row["key"] in cuckoo
                if not row["known"]:
                    cuckoo.add(row["key"])
                    n_keys += 1
            asked = [r for r in rows if r["what"] == "ask"]
            blank = {"key": None, "n_docs": None, "keeper": None, "known": None}
            out = [blank | {"shard": shard, "n_keys": n_keys, "layers": cuckoo.dump()}]
            out += [{"shard": shard, "n_keys": None, "layers": None} | {c: r[c] for c in blank} for r in asked]
            types = [("key", pa.binary()), ("n_docs", pa.int64()), ("keeper", pa.int64()), ("known", pa.bool_()),
                     ("shard", pa.int64()), ("n_keys", pa.int64()), ("layers", pa.list_(pa.binary()))]
            return pa.Table.from_pylist(out, schema=pa.schema(types))

        placed = keys.select(self._shard(bits).alias("shard"), "key", "n_docs", "keeper", "what")
        done = placed.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(
            turn, "key binary, n_docs long, keeper long, known boolean, " + FILTER
        )
        return self._write(done, "filters")

    def _asked(self, path: str) -> DataFrame:
        return self._read([path], "key binary, n_docs long, keeper long, known boolean").where("key IS NOT NULL")

    def _total(self, path: str) -> int:
        return self._read([path], FILTER).agg(F.sum("n_keys")).first()[0] or 0

    def insert(self, docs: DataFrame) -> None:
        """Adds documents (doc_id, text). Those whose id the index holds are replaced; rows that share an id are one document."""
        gen = self.now.gen + 1
        path = self._write(self._keyed(docs, gen + 1), "postings")
        if self.now.postings:
            ids = self._read([path], POSTING).select("doc_id").distinct()
            held = docs.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
            held = self.postings().select("doc_id").distinct().join(held.unionByName(ids).distinct(), "doc_id", "left_semi")
            again = self._write(held, "again")
            if not self.spark.read.parquet(again).isEmpty():
                self.remove(self.spark.read.parquet(again))
        new = self._next()
        rows = self._read([path], POSTING)
        most = new.n_keys + rows.count()  # an upper bound on keys: rows of a hot key count as often as they occur
        bits = new.bits
        while SHARD_KEYS << bits < most and bits < 31:
            bits += 1
        if new.filters is None:
            new.bits = bits
        elif bits > new.bits + 3:  # shards have outgrown their size: the filters are built anew from the states
            new.bits = bits
            every = self.states().select("key", "n_docs", "keeper", F.lit("add").alias("what"))
            new.filters = self._passed(every, None, bits)
        wrong = self._read([], "key binary, n_docs long, keeper long")  # known to a filter, not to the states
        for k in range(LOTS):
            lot = rows.where(F.col("lot") == k).groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))
            asks = lot.withColumn("what", F.lit("ask")).unionByName(wrong.withColumn("what", F.lit("add")))
            new.filters = self._passed(asks, new.filters, new.bits)
            asked = self._asked(new.filters)
            hits = asked.where("known").select("key", "n_docs", "keeper")
            old = self._read(new.states, STATE).groupBy("key").agg(F.max_by(F.struct("n_docs", "keeper"), "gen").alias("old"))
            exact = hits.join(old, "key", "left").select(
                "key", (F.col("n_docs") + F.coalesce("old.n_docs", F.lit(0))).alias("n_docs"),
                F.when(F.col("old.n_docs") > 0, F.least("keeper", "old.keeper")).otherwise(F.col("keeper")).alias("keeper"),
                (F.coalesce("old.n_docs", F.lit(0)) == 0).alias("wrong"),
            )
            checked = self._write(exact, "checked")
            exact = self._read([checked], "key binary, n_docs long, keeper long, wrong boolean")
            wrong = exact.where("wrong").drop("wrong")
            fresh = asked.where("NOT known").select("key", "n_docs", "keeper").unionByName(exact.drop("wrong"))
            # a lot's rows are newer than those of the lots before it
            new.states.append(self._write(fresh.withColumn("gen", F.lit(gen * LOTS + k).cast("long")), "states"))
        if not wrong.isEmpty():
            new.filters = self._passed(wrong.withColumn("what", F.lit("add")), new.filters, new.bits)
        new.postings.append(path)
        new.n_keys = self._total(new.filters)
        new.gen = gen
        self._commit(new)

    def remove(self, ids: DataFrame) -> None:
        """Takes documents (doc_id) out again: the index is as if they had never come in. Unknown and null ids change nothing."""
        gen = self.now.gen + 1
        new = self._next()
        gone = self._write(ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct().withColumn("gen", F.lit(gen).cast("long")), "removed")
        left = self.spark.read.parquet(gone).select("doc_id")
        lost = self._write(self.postings().join(left, "doc_id", "left_semi").select("key").distinct(), "lost")
        keys = self.spark.read.schema("key binary").parquet(lost)
        still = self.postings().join(keys, "key", "left_semi").join(left, "doc_id", "left_anti")
        counts = still.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("keeper"))
        after = keys.join(counts, "key", "left").select("key", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "keeper")
        path = self._write(after.withColumn("gen", F.lit(gen * LOTS).cast("long")), "states")
        out = self._read([path], STATE).where("n_docs = 0").select("key", "n_docs", "keeper", F.lit("drop").alias("what"))
        if new.filters:
            new.filters = self._passed(out, new.filters, new.bits)
            new.n_keys = self._total(new.filters)
        new.states.append(path)
        new.removed.append(gone)
        new.gen = gen
        self._commit(new)

    def compact(self) -> None:
        """One table of each kind in place of those of many updates; filters are built anew, in one layer."""
        new = self._next()
        gen = new.gen + 1
        new.postings = [self._write(self.postings().select("key", "doc_id", F.lit(0).alias("lot"), F.lit(gen).cast("long").alias("gen")), "postings")]
        new.states = [self._write(self.states().withColumn("gen", F.lit(gen * LOTS).cast("long")), "states")]
        new.removed, new.gen = [], gen
        every = self._read(new.states, STATE).select("key", "n_docs", "keeper", F.lit("add").alias("what"))
        new.filters = self._passed(every, None, new.bits)
        self._commit(new)

    # --- what is left of documents

    def kept(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept of documents that the index holds, one row for each row with an id.

        A text is split at newlines; a null or empty one is one empty line. Lines whose key has fewer
        code points than the index asks for always stay, as do all lines of the smallest document
        that holds their key. What stays is joined by newlines.
        """
        least = self.least
        lost = self.drops().groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

        def cut(batches):
            import pyarrow as pa

            for batch in slices(batches, 1):
                n_lines, n_dropped, kept = [], [], []
                for text, keys in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    n_lines.append(len(lines))
                    if keys:
                        gone = set(keys)
                        lines = [line for line, key in zip(lines, line_keys(text, least), strict=True) if key not in gone]
                    n_dropped.append(n_lines[-1] - len(lines))
                    kept.append("\n".join(lines) if keys else text or "")
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_lines": n_lines, "n_dropped": n_dropped, "kept": kept})

        met = _plain(docs).join(lost.hint("shuffle_hash"), "doc_id", "left")
        return met.select("doc_id", "text", "keys").mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
