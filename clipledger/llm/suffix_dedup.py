"""Removes byte strings of T = 100 bytes that also start earlier in the corpus, by prefix doubling.

A sort of all suffixes moves every position of the corpus in every round. Here positions are ranked
by names: the name of 2h bytes stands for the pair of names at p and p + h, so equal ranks mean equal
prefixes and Spark's sort brings them together. Three things keep the rounds small, and lose nothing:

1. Sites. Of the K-byte strings in a T-byte string, the one with the smallest name is its site. Equal
   T-byte strings have equal sites at equal places, so one position in about 35 stands for all.
   First round, offset K: sites whose rank is unique go, with all strings that they stand for.
2. Runs. The strings of a site lie side by side and cover one run of bytes. Second round, past the
   threshold: a run that occurs earlier in full is removed in full.
3. Longer ranks. What is left are runs that come first of their kind, at a site that also occurs
   within other runs. Their strings are ranked by ever longer parts that all of them hold, and those
   whose rank is unique go. The last round, at T bytes, ranks strings one by one; all but the first of
   a rank are removed.

Groups are only counted and reduced to their first member, both before the shuffle, and joins back
have one row for each rank on the other side, so a string that a third of all documents hold is
split like any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import keyed, written
from clipledger.llm.spans import doubled, leftmost_minima, mixed, pair, pieces, text_bytes

THRESHOLD = 100
SITE = 32
_HALF = 64
#: Ranked lengths between site and threshold.
LONGER = (66, 83)
#: A site's place in its document and its strings: place << 16 | bytes from first string << 8 | strings - 1.
_PLACE, _BACK = 65536, 256


def _sites(data: np.ndarray, at: np.ndarray):
    """Site names, run names, document number, packed place, of all strings of T bytes in the texts."""
    found = []
    for a, n, part in pieces(data, THRESHOLD + _HALF):
        short, half = doubled(part, SITE, _HALF)
        short = mixed(short)
        best = leftmost_minima(short, THRESHOLD - SITE + 1)[:n]
        if not len(best):
            continue
        p = np.arange(a, a + len(best))
        doc = np.searchsorted(at, p, "right") - 1
        good = p + THRESHOLD <= at[doc + 1]
        edge = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (good[1:] != good[:-1])])
        last = np.r_[edge[1:], len(best)] - 1
        edge, last = edge[good[edge]], last[good[edge]]
        site, end = best[edge], last + THRESHOLD
        name = pair(pair(half[edge], half[end - _HALF], 20), half[(edge + end - _HALF) // 2], 21)
        shape = ((site - edge) << 8 | (last - edge)).astype(np.uint64)
        found.append((short[site], mixed(name ^ mixed(shape)), doc[edge], site + a - at[doc[edge]] << 16 | shape.astype(np.int64)))
    if not found:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _site_rows(docs: DataFrame) -> DataFrame:
    def find(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            site, run, doc, place = _sites(*text_bytes(batch.column(1)))
            yield pa.RecordBatch.from_pydict(
                {"site": site.view(np.int64), "run": run.view(np.int64), "doc_id": ids[doc], "place": place}
            )

    return docs.mapInArrow(find, "site long, run long, doc_id long, place long")


_SEGMENT = "doc_id long, start long, n long, back long, bytes binary"


def _segments(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text, places): each run's first string, number of strings, distance to its site, and bytes."""

    def take(batches):
        import pyarrow as pa

        for batch in batches:
            data, at = text_bytes(batch.column(1))
            lists, parts = batch.column(2), []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                place, text = lists[i].values.to_numpy(zero_copy_only=False), data[at[i] : at[i + 1]]
                back, n = place >> 8 & 255, (place & 255) + 1
                start = (place >> 16) - back
                own = [text[a:b].tobytes() for a, b in zip(start.tolist(), (start + n - 1 + THRESHOLD).tolist(), strict=True)]
                parts.append(pa.RecordBatch.from_pydict({
                    "doc_id": np.full(len(n), doc_id), "start": start, "n": n, "back": back, "bytes": pa.array(own, pa.binary()),
                }))
            yield from parts

    return docs.mapInArrow(take, _SEGMENT)


def _columns(batch) -> tuple:
    data, at = text_bytes(batch.column(4))
    return (data, at[:-1], *(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))


def _ranked_segments(segments: DataFrame, size: int) -> DataFrame:
    """Splits segments so that all strings of a part hold one string of `size` bytes, and names that one.

    The `size`-byte string starts a multiple of T - size + 1 bytes before the site, so parts with equal
    strings hold equal ones.
    """
    step = THRESHOLD - size + 1

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            data, at, doc, start, n, back = _columns(batch)
            (half,) = doubled(data, _HALF)
            # the j-th string starts j * step before the site; it lies in strings that start up to step - 1 earlier
            high, low = back // step, (back - n + 1) // step
            parts = high - low + 1
            row = np.repeat(np.arange(len(n)), parts)
            j = low[row] + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            key = back[row] - j * step  # from the segment's start
            first, last = np.maximum(0, key - step + 1), np.minimum(n[row] - 1, key)
            p = at[row] + key
            name = mixed(pair(half[p], half[p + size - _HALF], 26) ^ mixed(j.astype(np.uint64) + np.uint64(size)))
            own = [data[a:b].tobytes() for a, b in zip((at[row] + first).tolist(), (at[row] + last + THRESHOLD).tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": doc[row], "start": start[row] + first, "n": last - first + 1, "back": back[row] - first,
                "bytes": pa.array(own, pa.binary()), "name": name.view(np.int64),
            })

    return segments.mapInArrow(split, _SEGMENT + ", name long")


def _string_rows(segments: DataFrame) -> DataFrame:
    """Two names, 96 bits together, for each string of T bytes that starts in a segment."""

    def name(batches):
        import pyarrow as pa

        for batch in batches:
            data, at, doc, start, n, _ = _columns(batch)
            short, half = doubled(data, SITE, _HALF)
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = at[row] + k
            full = pair(half[p], half[p + THRESHOLD - _HALF], 22)
            again = mixed(pair(pair(short[p], short[p + SITE], 23), half[p + THRESHOLD - _HALF], 24))
            yield pa.RecordBatch.from_pydict(
                {"x": full.view(np.int64), "y": (again >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": doc[row], "start": start[row] + k}
            )

    return segments.mapInArrow(name, "x long, y int, doc_id long, start long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (start, end) in bytes whose union is to be removed; documents without any are left out.

    A null text is empty, a null id is left out; a repeated row is the same document.
    """
    docs = keyed(docs, "doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    sites = _site_rows(docs)
    shared = written(sites.groupBy("site").count().where("count > 1").select("site"), "repeat-sites")
    live = written(sites.join(shared, "site", "left_semi"), "repeat-live")
    runs = written(
        live.groupBy("site", "run").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")),
        "repeat-runs",
    )
    later = (
        live.join(runs.where("n > 1").select("site", "run", "first"), ["site", "run"])
        .where("doc_id > first.doc_id OR doc_id = first.doc_id AND place > first.place")
        .selectExpr(
            "doc_id", f"place DIV {_PLACE} - place DIV {_BACK} % 256 AS start",
            f"place DIV {_PLACE} - place DIV {_BACK} % 256 + place % 256 + {THRESHOLD} AS end",
        )
    )
    mixed_sites = written(runs.groupBy("site").count().where("count > 1").select("site"), "repeat-mixed")
    open_runs = (
        runs.join(mixed_sites, "site", "left_semi").select("first.doc_id", "first.place")
        .groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    )
    open_docs = docs.join(written(open_runs, "repeat-open"), "doc_id").select("doc_id", "text", "places")
    segments = written(_segments(open_docs), "repeat-segments")
    for size in LONGER:
        parts = written(_ranked_segments(segments, size), "repeat-parts")
        again = written(parts.groupBy("name").count().where("count > 1").select("name"), "repeat-names")
        segments = written(parts.join(again, "name", "left_semi").drop("name"), "repeat-segments")
    strings = _string_rows(segments)  # made twice: cheaper than to keep
    firsts = written(
        strings.groupBy("x", "y").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("x", "y", "first"),
        "repeat-firsts",
    )
    again = (
        strings.join(firsts, ["x", "y"]).where("doc_id > first.doc_id OR doc_id = first.doc_id AND start > first.start")
        .selectExpr("doc_id", "start", f"start + {THRESHOLD} AS end")
    )
    return later.unionByName(again).groupBy("doc_id").agg(
        F.collect_list(F.struct(F.col("start").cast("int"), F.col("end").cast("int"))).alias("spans")
    )


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; touching ones are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return start[new], end[np.r_[np.flatnonzero(new)[1:], len(start)] - 1]


def cut_documents(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that are left (`kept`)."""
    spans = written(repeated_spans(docs), "repeat-spans")
    base = keyed(docs, "doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            data, at = text_bytes(batch.column(1))
            lists, rows = batch.column(2), []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text, start, end = data[at[i] : at[i + 1]], [], []
                if lists[i].is_valid and len(lists[i].values):
                    spans = lists[i].values
                    start, end = _merged(*(spans.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)))
                    start, end = np.minimum(start, len(text)), np.minimum(end, len(text))
                left = [text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True)]
                kept = np.concatenate(left).tobytes()
                rows.append((doc_id, len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")[: 5 + keep_text]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)})

    return base.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(cut, schema)
