"""Token ids in binary shards: fixed-size blocks, transposed into planes, each plane compressed.

A shard holds the documents of one range of ids. Layout: magic, then for each block its planes one
after another, then a footer (zstd): document ids, their token counts, and the chunk index with the
place and size of every plane; last the footer's size. A block can be read without its neighbours.
Byte planes put the low bytes of all ids of a block together, then the next bytes; bit planes do
the same with single bits. Planes above the largest id are not stored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import keyed, partitions
from clipledger.llm.spans import slices
from clipledger.llm.tokens import ENCODED_BYTES, encoder, forget_encoders
from clipledger.session import scratch_path

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    if not len(ids):
        return []
    top = int(ids.max()).bit_length()
    if kind == "byte":
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [raw[:, k].tobytes() for k in range(max(1, -(-top // 8)))]
    return [np.packbits(((ids >> k) & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(max(1, top))]


def ids_of(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        if kind == "byte":
            out |= np.frombuffer(plane, np.uint8).astype(np.uint32) << np.uint32(8 * k)
        else:
            bits = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=n)
            out |= bits.astype(np.uint32) << np.uint32(k)
    return out


class ShardWriter:
    """Takes documents one by one; holds a block and the index, never the shard."""

    def __init__(self, sink, kind: str, level: int = 3):
        import zstandard

        self.sink, self.kind, self.press = sink, kind, zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n_held, self.at, self.n_ids = 0, len(MAGIC), 0
        self.docs: list[tuple[int, int]] = []
        self.index: list[list[int]] = []
        sink.write(MAGIC)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            flat = np.concatenate(self.held)
            full = len(flat) // BLOCK_IDS * BLOCK_IDS
            for i in range(0, full, BLOCK_IDS):
                self._block(flat[i : i + BLOCK_IDS])
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.press.compress(x) for x in planes_of(ids, self.kind)]
        self.index.append([self.at, len(ids), *map(len, packed)])
        for x in packed:
            self.sink.write(x)
            self.at += len(x)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs = np.array(self.docs, "<i8").reshape(-1, 2)
        rows = np.array([x for row in self.index for x in (len(row), *row)], "<i8")
        head = struct.pack("<4sQQ", self.kind.encode().ljust(4), len(docs), len(rows))
        footer = self.press.compress(head + docs.tobytes() + rows.tobytes())
        self.sink.write(footer + struct.pack("<Q", len(footer)))


class ShardReader:
    """Documents of a shard, block by block; read(at, n) fetches n bytes at an offset."""

    def __init__(self, read, size: int):
        import zstandard

        self.read, self.open = read, zstandard.ZstdDecompressor()
        (length,) = struct.unpack("<Q", read(size - 8, 8))
        footer = self.open.decompress(read(size - 8 - length, length))
        kind, n_docs, n_rows = struct.unpack_from("<4sQQ", footer)
        self.kind, at = kind.decode().strip(), struct.calcsize("<4sQQ")
        self.docs = np.frombuffer(footer, "<i8", 2 * n_docs, at).reshape(-1, 2)
        flat, self.index, i = np.frombuffer(footer, "<i8", n_rows, at + 16 * n_docs).tolist(), [], 0
        while i < len(flat):
            self.index.append(flat[i + 1 : i + 1 + flat[i]])
            i += 1 + flat[i]

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k]
        raw, planes = self.read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.open.decompress(raw[:size]))
            raw = raw[size:]
        return ids_of(planes, n, self.kind)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in self.docs.tolist():
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, kind: str = "byte") -> DataFrame:
    """Encodes (doc_id, text) and writes shards in ascending doc_id order.

    Returns shard, path, n_docs, n_ids; shards count upwards with the ids. A null text is empty, a
    null id is left out, rows that share an id are documents of their own. Every attempt of a task
    writes a file of its own; only the files of tasks that ended are in the result.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-shards")

    def encode(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        path, enc, writer = f"{shard:06d}-{uuid.uuid4().hex}.ids", encoder(vocabulary), None
        for batch in slices(batches, 1, ENCODED_BYTES):
            if writer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/{path}")
                writer = ShardWriter(sink, kind)
            ids = enc.encode(batch.column(1).to_pylist())
            for doc_id, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                writer.add(doc_id, np.append(x.astype(np.uint32), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "path": [f"{folder}/{path}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]}
            )

    ordered = (
        keyed(docs, "doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
        .repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return ordered.mapInArrow(encode, "shard long, path string, n_docs long, n_ids long")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. One row for each shard is all
    that the running total of ids needs."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def decode(batches):
        import pyarrow as pa
        import pyarrow.fs

        forget_encoders()  # workers that wrote shards read them as well
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    reader = ShardReader(lambda at, n, f=f: f.read_at(n, at), f.size())
                    rows, start = [], base
                    for doc_id, ids in reader:
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                names = ("doc_id", "start", "n_tokens", "ids_crc32")
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)}
                )

    spread = based.select("path", "base").repartition(partitions(shards.sparkSession), "path")
    return spread.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
