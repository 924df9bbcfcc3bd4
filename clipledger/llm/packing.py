"""Best-fit packing planned over the histogram of lengths, not over documents.

The plan takes lengths from the longest down. Bins with equal room are kept as runs, so placing a
million pieces of one length takes a few steps. Steps depend on the sequence length and the spread of
lengths alone; the driver holds the histogram (one entry for each length) and the plan.
Pieces then take planned places by their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import keyed, ranked, written
from clipledger.llm.spans import slices
from clipledger.llm.tokens import ENCODED_BYTES, encoder


def plan(counts: dict[int, int], room: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, offset): ranks from there on go to bins from there on."""
    runs: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first bin, bins)]
    rooms: list[int] = []
    out: dict[int, list[tuple[int, int, int]]] = {}
    bins = 0

    def leave(left: int, first: int, n: int) -> None:
        if left:
            if left not in runs:
                runs[left] = []
                bisect.insort(rooms, left)
            runs[left].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= room:
            raise ValueError(f"length {length} does not fit into {room}")
        todo, rank, rows = counts[length], 0, []
        while todo:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                left = rooms[k]
                first, n = runs[left].pop()
                take = min(n, todo)
                if take < n:
                    runs[left].append((first + take, n - take))
                elif not runs[left]:
                    del runs[left], rooms[k]
                rows.append((rank, first, room - left))
                leave(left - length, first, take)
            else:  # new bins hold as many of this length as they can
                per = room // length
                take, first = todo, bins
                full, rest = divmod(todo, per)
                for j in range(per if full else 0):
                    rows.append((rank + j * full, first, j * length))
                leave(room - per * length, first, full)
                bins += full
                if rest:
                    for j in range(rest):
                        rows.append((rank + full * per + j, bins, j * length))
                    leave(room - rest * length, bins, 1)
                    bins += 1
            rank, todo = rank + take, todo - take
        out[length] = rows
    return {k: np.array(v, np.int64) for k, v in out.items()}


def best_fit(pieces: DataFrame, room: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `room` tokens."""
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    spots = plan(counts, room)
    shared = pieces.sparkSession.sparkContext.broadcast(spots)
    placed = ranked(pieces, length, list(order), "_rank", "packing-ranks")
    schema = placed.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(frames):
        for frame in frames:
            lengths, ranks = frame[length].to_numpy(), frame.pop("_rank").to_numpy()
            bins, offsets = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for n in np.unique(lengths):
                rows, at = shared.value[int(n)], lengths == n
                k = np.searchsorted(rows[:, 0], ranks[at], "right") - 1
                bins[at], offsets[at] = rows[k, 1] + ranks[at] - rows[k, 0], rows[k, 2]
            yield frame.assign(sequence_id=bins, offset=offsets)

    return placed.mapInPandas(place, schema)


def numbered(pieces: DataFrame, order: list[str]) -> DataFrame:
    """The packed pieces with sequences numbered anew, from 0, by the first piece each holds in `order`."""
    first = pieces.groupBy("sequence_id").agg(F.min(F.struct(*order)).alias("_first")).withColumn("_all", F.lit(0))
    new = ranked(first, "_all", ["_first"], "_new", "packing-sequences").select(F.col("sequence_id").alias("_old"), "_new")
    joined = pieces.join(new, pieces["sequence_id"] == new["_old"])
    return joined.select(*(F.col("_new").alias(c) if c == "sequence_id" else F.col(c) for c in pieces.columns))


def token_pieces(docs: DataFrame, vocabulary: str, room: int, end_id: int = 0, places: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of (doc_id, text): the ids and an end id, cut only where longer than `room`.

    The first piece takes what is over whole pieces. A null text is empty (its one piece is the end id),
    a null id is left out, rows that share an id are documents of their own. `places` are whole numbers
    of the documents that their pieces keep.
    """

    def cut(batches):
        import pyarrow as pa

        names = ("doc_id", "piece", "start", "length", "ids_crc32", *places)
        for batch in slices(batches, 1, ENCODED_BYTES):
            rows = []
            ids = encoder(vocabulary).encode(batch.column(1).to_pylist())
            place = zip(*(batch.column(2 + k).to_pylist() for k in range(len(places)))) if places else [()] * len(ids)
            for doc_id, x, at in zip(batch.column(0).to_pylist(), ids, place, strict=True):
                x = np.append(x.astype("<u4"), np.uint32(end_id)).astype("<u4")
                first = len(x) % room or room
                edges = [0, *range(first, len(x) + 1, room)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(x[a:b].tobytes()), *at))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * len(places))
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([r[k] for r in rows], kinds[k]) for k, n in enumerate(names)}
            )

    kept = keyed(docs, "doc_id", text="text", **{c: c for c in places})
    return kept.select(F.col("doc_id").cast("long"), "text", *(F.col(c).cast("long") for c in places)).mapInArrow(
        cut, ", ".join(["doc_id long, piece int, start long, length long, ids_crc32 long", *(f"{c} long" for c in places)])
    )


def pack_documents(
    docs: DataFrame, vocabulary: str, room: int = 2048, end_id: int = 0, places: tuple[str, ...] = (),
) -> DataFrame:
    """Every piece of every document with its sequence and its place there; places leave no gap from 0.

    With `places`, columns of whole numbers that order the documents, documents of one length are taken in that
    order, and sequences are numbered by the first document they hold.
    """
    pieces = written(token_pieces(docs, vocabulary, room, end_id, places), "packing-pieces")
    if not places:
        return best_fit(pieces, room)
    order = [*places, "doc_id", "piece"]
    packed = written(best_fit(pieces, room, order=tuple(order)), "packing-placed")
    return numbered(packed, order).drop(*places)


def file_places(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """A table Spark wrote, with columns that tell the order it was written in: part, file of the part, row."""
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    places = {"_part": number("^part-([0-9]+)"), "_file": number("-c([0-9]+)[.]"), "_row": F.col("_metadata.row_index")}
    return docs.select("*", *(c.alias(n) for n, c in places.items())), tuple(places)
