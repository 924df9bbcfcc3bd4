"""Periodic runs of words, by a sparse diagonal dynamic programme that goes through a text once.

Cell (i, p) says that the words that end at word i also end p words earlier. Cells next to each other
on a lag p are a diagonal, whose match length grows by one with each word; when it ends, it is emitted
as a run if it is long enough. A word that occurs f times would have f * f / 2 cells. Only smallest
periods count, so far fewer are made: for lags in (g/2, g] the earlier occurrences are those of the
last g words together, and of these only the latest can be a smallest period, because g words of a
run with smallest period q <= g do not occur again at less than q. So a word has at most one cell for
each g = 1, 2, 4, ..., and none at 2g unless both halves of its 2g words occur elsewhere in the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.spans import slices

RUNS = "array<struct<start: long, length: long, period: long>>"
#: Words that are worked on together (a longer text is worked on whole).
WORDS_AT_ONCE = 1 << 19


def cells(codes: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, lag and g of every cell for lags up to `deepest`, in the order of words; `codes`: numbers that stand for words."""
    at, name, g = np.arange(len(codes)), np.asarray(codes, np.int64), 1
    found = [(at[:0],) * 3]
    while len(at) and g // 2 < deepest:
        order = np.argsort(name, kind="stable")  # equal words side by side, in the order of the text
        place = at[order]
        same = np.diff(name[order]) == 0
        lag = np.zeros(len(at), np.int64)
        lag[order[1:][same]] = (place[1:] - place[:-1])[same]
        near = (lag > g // 2) & (lag <= g)
        found.append((at[near], lag[near], np.full(near.sum(), g)))
        again = np.zeros(len(at), bool)  # words that occur elsewhere as well
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(np.r_[0, ~same])
        at, rank = at[again], rank[again]
        half = np.searchsorted(at, at - g)
        ok = np.flatnonzero(at[np.minimum(half, len(at) - 1)] == at - g) if len(at) else half
        name = rank[half[ok]] * (rank.max(initial=0) + 1) + rank[ok]
        at, g = at[ok], 2 * g
    i, p, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], p[order], size[order]


def diagonals(codes: np.ndarray, least: int, times: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every run of `codes`, by start and period.

    A run is at least `least` long and `times` (3 or more) its period; `longest`: words of the longest text.
    Only the lags active at one word are held: a few, as squares that end at one place are few.
    """
    if times < 3:
        raise ValueError("runs shorter than three periods are not found")
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # lag: words matched so far
    fresh: dict[int, int] = {}
    word = -1

    def end(lags: dict[int, int], last: int) -> None:
        for p, match in lags.items():
            if match + p >= max(least, times * p):
                runs.append((last + 1 - match - p, match + p, p))

    for i, p, g in zip(*(x.tolist() for x in cells(codes, longest // times)), strict=True):
        if i != word:
            end(active, word - 1)  # what word `word` did not go on with
            active, fresh = fresh, {}
            if i != word + 1:
                end(active, word)
                active = {}
            word = i
        fresh[p] = active.pop(p) + 1 if p in active else g
    end(active, word - 1)
    end(fresh, word)
    found = np.array(sorted(runs, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _texts(batches) -> Iterator[tuple]:
    """Parts of batches with the words of their texts (bytes) and numbers for these; no two texts share a number."""
    for batch in slices(batches, 1, 4 * WORDS_AT_ONCE):
        # bytes are split at space, tab, newline, vertical tab, form feed and carriage return, and at nothing else
        words = [(text or "").encode().split() for text in batch.column(1).to_pylist()]
        codes, used = [], 0
        for own in words:
            number: dict[bytes, int] = {}
            codes.append(np.fromiter((number.setdefault(w, used + len(number)) for w in own), np.int64, len(own)))
            used += len(number)
        yield batch.column(0), words, codes


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs, collapsed for every row with an id.

    Words are runs without space and without the characters 9 to 13. `runs`: every longest stretch of words
    with a smallest period, at least `least` words and `times` periods long, by start and period;
    start is a word's number from 0. `collapsed`: the words that lie in no run after its first
    period, joined by a space. A null, empty or blank text has no words, no runs and an empty
    `collapsed`. Rows are judged one by one, so a repeated row comes out as often as it went in.
    """

    def find(batches):
        import pyarrow as pa

        for ids, words, codes in _texts(batches):
            offset = np.cumsum([0, *map(len, words)])
            start, length, period = diagonals(np.concatenate(codes), least, times, max(map(len, words)))
            first = np.searchsorted(start, offset)
            gone = np.zeros(offset[-1] + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            kept = np.cumsum(gone) == 0
            collapsed = [
                b" ".join(own if a == b else compress(own, kept[o : o + len(own)].tolist())).decode()
                for own, o, a, b in zip(words, offset.tolist(), first.tolist(), first[1:].tolist(), strict=False)
            ]
            begin = np.repeat(offset[:-1], np.diff(first))
            run = pa.StructArray.from_arrays([pa.array(start - begin), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n_words": pa.array(np.diff(offset), pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(first, pa.int32()), run), "collapsed": collapsed,
            })

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    return own.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """Of `periodic_runs`: doc_id, the number of runs, the longest one (ties: smallest start, then period) and hashes."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_most", F.array_max(order)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_most.start")).alias("start"), F.col("_most.length").alias("length"),
        (-F.col("_most.period")).alias("period"), F.expr("1000 * _most.length DIV -_most.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; in a tenth of the documents, taken by the crc32 of the id, the words after some place are repeats.

    Of n words, word i >= a becomes word a + (i - a) % p, with a = g % n, p = 1 + (n - a) DIV (3 + g % 8), g = crc32 DIV 10.
    """
    chosen = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").withColumn(
        "h", F.crc32(F.col("doc_id").cast("string").cast("binary"))
    )
    words = F.when(F.expr("h % 10 = 0 AND text IS NOT NULL"), F.regexp_extract_all("text", F.lit("[^ \\t-\\r]+"), F.lit(0)))
    # every step in a generator of its own, so that none is worked out again for each word
    split = chosen.select("doc_id", "text", F.expr("h DIV 10").alias("g"), F.explode_outer(F.array(words)).alias("w"))
    split = split.withColumn("n", F.size("w")).withColumn("a", F.expr("CAST(CASE WHEN n > 0 THEN g % n END AS INT)"))
    split = split.withColumn("p", F.expr("CAST(1 + (n - a) DIV (3 + g % 8) AS INT)"))
    tail = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST((n - a) DIV p + 1 AS INT))), 1, n - a))")
    return split.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))
