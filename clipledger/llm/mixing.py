"""Mixes sources to target weights by Pfair scheduling.

Every source is cut into blocks. With weight w, block j is released at floor(j / w) and due at
ceil((j + 1) / w); in every slot the released block with the earliest deadline goes out. At any time a
source has sent w t blocks, less than one more or fewer, however long the run: weights are exact
fractions, never rounded to slots. When a source has run out, a phase ends and time starts anew for
the others, with their weights in proportion; the bound holds within each phase.

The driver walks over the slots once. It and every task hold the sources and the slot of each block: 8 bytes
for `block_rows` rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import partitions, ranked

CYCLE = 1000
BLOCK_ROWS = 16


def shares(weights: dict, cycle: int) -> dict:
    """Exact slots of a cycle for each weight, as fractions; they sum to the cycle, and none is 0."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w * cycle / total for s, w in exact.items()}


def earliest_deadline_first(weights: dict, left: dict, out: dict, start: int) -> int:
    """Adds slots from `start` on to `out` until the first source has sent all it has left; returns the next slot.

    Weights are whole numbers, of which a source's part in their sum counts.
    """
    names, total = list(weights), sum(weights.values())
    each, last = [weights[s] for s in names], [left[s] - 1 for s in names]
    places = [out[s] for s in names]
    if len(names) == 1:
        places[0].extend(range(start, start + left[names[0]]))
        return start + left[names[0]]
    waiting = [(0, str(s), i, 0) for i, s in enumerate(names)]
    ready: list = []
    heapq.heapify(waiting)
    for t in itertools.count():
        while waiting and waiting[0][0] <= t:
            _, label, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // each[i]), label, i, j))
        _, label, i, j = heapq.heappop(ready)
        places[i].append(start + t)
        if j == last[i]:
            return start + t + 1
        heapq.heappush(waiting, ((j + 1) * total // each[i], label, i, j + 1))


def schedule(blocks: dict, weights: dict, cycle: int = CYCLE) -> dict:
    """The slots of each source's blocks. Sources without a weight or with weight 0 go last, in equal shares.

    The cycle is only the unit in which shares are told; slots do not depend on it.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    out: dict = {s: array("q") for s in blocks}
    exact = shares({s: w for s in left if (w := weights.get(s) or 0) > 0}, cycle)
    unit = math.lcm(*(x.denominator for x in exact.values()))
    whole, at = {s: int(x * unit) for s, x in exact.items()}, 0
    while left:
        active = {s: whole[s] for s in left if s in whole} or dict.fromkeys(left, 1)
        at = earliest_deadline_first(active, left, out, at)
        left = {s: n for s in left if (n := blocks[s] - len(out[s]))}
    return {s: np.array(x, np.int64) for s, x in out.items()}


def slots_of(slots: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The slot of each block of a source."""
    return slots[block]


def tempered_weights(sizes: dict, power: float = 0.5) -> dict:
    """Weights between the sources' own shares (1) and equal ones (0)."""
    return {s: float(n) ** power for s, n in sizes.items()}


def interleaved(
    docs: DataFrame, weights: dict | None = None, source: str = "source", key: str = "doc_id",
    block_rows: int = BLOCK_ROWS, cycle: int = CYCLE,
) -> DataFrame:
    """Of every row its key and source, with block (within the source), slot and place (in the mix), from 0.

    Within a source rows keep a fixed random order. Without weights, the square roots of the sources'
    sizes serve. A null source is a source of its own; null and repeated keys are rows like others.
    """
    bare = docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source")).withColumn("_order", F.xxhash64(F.col("_key"), F.lit(17)))
    rows = ranked(bare, "_source", ["_order", "_key"], "_rank", "mix-ranks")
    sizes = {r[0]: r[1] for r in bare.groupBy("_source").count().collect()}
    plan = schedule({s: -(-n // block_rows) for s, n in sizes.items()}, weights or tempered_weights(sizes), cycle)
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(frames):
        for f in frames:
            block, slot = f.pop("_rank").to_numpy() // block_rows, np.zeros(len(f), np.int64)
            names = f["_source"].to_numpy(dtype=object)
            for s, at in f.groupby(f["_source"].fillna("\0none"), sort=False).indices.items():
                slot[at] = slots_of(shared.value[None if s == "\0none" else names[at[0]]], block[at])
            yield f.assign(block=block, slot=slot)

    kind = dict(bare.dtypes)["_key"]
    placed = rows.mapInPandas(place, f"_key {kind}, _source string, _order long, block long, slot long")
    mixed = ranked(placed.withColumn("all", F.lit(0)), "all", ["slot", "_order", "_key"], "place", "mix-places")
    return mixed.select(F.col("_key").alias(key), F.col("_source").alias(source), "block", "slot", "place")


def mixed_documents(docs: DataFrame, weights: dict | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, in the order of the mix: files, and the rows in them, follow the places.

    Rows that share key and source share a place and lie side by side.
    """
    code = F.xxhash64(F.col(key), F.col(source))
    mix = interleaved(docs.select(code.alias("_code"), F.col(source).alias("_from")), weights, "_from", "_code")
    places = mix.groupBy("_code").agg(F.min("place").alias("_place"))
    joined = docs.join(places, code == F.col("_code"))
    return joined.repartitionByRange(partitions(docs.sparkSession), "_place").sortWithinPartitions("_place").select(
        *(docs[c] for c in docs.columns)
    )
