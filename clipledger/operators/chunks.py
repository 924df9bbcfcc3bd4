"""Ordered work over keys of any size.

Rows are range-partitioned by (keys, order), so one key may span many
partitions ("chunks") and no task holds more than one chunk, however hot the
key is.  Two tools build on that:

* ``range_chunks`` with ``summaries`` and ``attach``: for windows that compose (sums, running extremes).  Each chunk
  is summarised per key, the summaries are combined over at most one row per
  (chunk, key), and only keys that continue into a chunk get a carry-in row.
  Those number at most one per chunk, so the carry table is broadcast.
* ``ordered_fold``: for decisions that depend on earlier decisions.  Each chunk
  is folded with the state its predecessor ended in.  Only chunks that lie
  inside a single key depend on that state.  Each such chunk tabulates once what it
  makes of any state, and the tables are applied one after another: two jobs, however
  many chunks a key has.  That is exactly the sequential result.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.session import durable, setting

CHUNK = "_chunk"
#: Bytes of shuffled rows that neighbouring partitions are merged up to; every core should get some of them.
CHUNK_BYTES = 8 * 1024**2
#: Rows of a chunk that a task sorts and holds for its windows.
CHUNK_ROWS = 500_000


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n_chunks: int | None = None) -> DataFrame:
    """Range-partition by (keys, order), sort inside, number the partitions and materialise.

    Without ``n_chunks`` the count follows the shuffle setting and AQE merges neighbours
    up to ``CHUNK_BYTES``: a key should span few chunks, but the work on chunks is to be
    spread.  Materialising pins the partition numbers, which later jobs rely on.
    """
    cols = [*keys, *order]
    spread = df.repartitionByRange(n_chunks, *cols) if n_chunks else df.repartitionByRange(*cols)
    merge_by_size = setting(df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    with merge_by_size, setting(df.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", str(CHUNK_BYTES)):
        return durable(spread.sortWithinPartitions(*cols).withColumn(CHUNK, F.spark_partition_id()))


def window_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], n_chunks: int | None = None) -> DataFrame:
    """``range_chunks`` for windows over chunks of few rows: their number follows the count of rows, and no two share a task."""
    n = n_chunks or max(1, -(-df.count() // CHUNK_ROWS))
    return range_chunks(df, keys, order, n).repartitionById(max(n, 2), CHUNK)


def inside(keys: Sequence[str], order: Sequence[str]):
    """Window over one key's rows inside one chunk."""
    return Window.partitionBy(CHUNK, *keys).orderBy(*order)


def before(keys: Sequence[str]):
    """Frame over the summaries of a key's earlier chunks."""
    return (
        Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )


def summaries(rows: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per (chunk, key): at most one per chunk for a key that spans chunks."""
    return rows.groupBy(CHUNK, *keys).agg(*aggs)


def attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join carry-ins; ``carry`` must already be limited to continuing keys (<= one per chunk)."""
    return rows.join(F.broadcast(carry), [CHUNK, *keys], "left")


def ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn", n_chunks: int | None = None
) -> DataFrame:
    """row_number() per key for keys of any size."""
    rows = range_chunks(df, keys, order, n_chunks)
    rows = rows.withColumn("_local", F.row_number().over(inside(keys, order)))
    summary = summaries(rows, keys, F.count(F.lit(1)).alias("_n"))
    carry = (
        summary.withColumn("_base", F.sum("_n").over(before(keys)))
        .where(F.col("_base").isNotNull())
        .select(CHUNK, *keys, "_base")
    )
    return (
        attach(rows, carry, keys)
        .withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_local"))
        .drop("_base", "_local", CHUNK)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, totals: dict[str, str], n_chunks: int | None = None
) -> DataFrame:
    """Adds row_number() per key, ``_rows`` (how many a key has) and sums over whole keys (new name -> column).

    The input is read once. A chunk sums its own keys; only keys that lie in several chunks,
    at most two a chunk, get their number and their sums from the summaries.
    """
    rows = range_chunks(df, keys, order, n_chunks)
    whole = Window.partitionBy(CHUNK, *keys)
    local = rows.withColumn("_local", F.row_number().over(inside(keys, order))).withColumn("_rows", F.count(F.lit(1)).over(whole))
    for new, c in totals.items():
        local = local.withColumn(new, F.sum(c).over(whole))
    summary = summaries(rows, keys, F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_part{new}") for new, c in totals.items()))
    every = Window.partitionBy(*keys)
    carry = (
        summary.withColumn("_base", F.coalesce(F.sum("_n").over(before(keys)), F.lit(0)))
        .withColumn("_pieces", F.count(F.lit(1)).over(every)).withColumn("_all", F.sum("_n").over(every))
        .withColumns({f"_all{new}": F.sum(f"_part{new}").over(every) for new in totals})
        .where("_pieces > 1").select(CHUNK, *keys, "_base", "_all", *(f"_all{new}" for new in totals))
    )
    split = F.col("_base").isNotNull()
    out = attach(local, carry, keys).withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_local"))
    out = out.withColumn("_rows", F.when(split, F.col("_all")).otherwise(F.col("_rows")))
    for new in totals:
        out = out.withColumn(new, F.when(split, F.col(f"_all{new}")).otherwise(F.col(new)))
    return out.drop(CHUNK, "_local", "_base", "_all", *(f"_all{new}" for new in totals))


class Fold:
    """A per-key state machine.

    ``inputs`` names the columns handed to ``step``; ``outputs`` are the produced
    fields.  States must survive JSON (numbers, strings, None and lists of them).
    """

    inputs: Sequence[str] = ()
    outputs: Sequence[tuple[str, T.DataType]] = ()

    def start(self) -> Any:
        return None

    def step(self, state: Any, *values: Any) -> tuple[Any, tuple]:
        raise NotImplementedError

    # The first of ``inputs`` is the row's time, and rows come in its order.

    def table(self, rows: list[tuple]) -> bytes:
        """What a chunk with these rows makes of any state; as is for states that merely block their key until they lapse."""
        return json.dumps(exit_table(self, rows)).encode()

    def enter(self, table: bytes, state: Any) -> Any:
        """The state after a chunk that is entered with ``state``."""
        return exit_state(self, json.loads(table), state)

    def lapse(self, state: Any) -> int | None:
        """When a state no longer blocks its key."""
        raise NotImplementedError

    # Seconds from a row within which the state it leaves behind has lapsed; tables are whole where it is not known.
    reach: float = float("inf")

    def closed(self, batch: pa.RecordBatch, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which islands (rows from ``start`` to before ``end``) ``answers`` is right for: single rows, if nothing else is said."""
        return end - start == 1

    def answers(self, batch: pa.RecordBatch, begins: np.ndarray) -> list[Sequence]:
        """The outputs for rows of closed islands; ``begins`` marks where islands begin."""
        raise NotImplementedError

    def resets(self, *values: Any) -> bool:
        """Whether a row's outcome state is the same whatever came before."""
        return False

    def weight(self, *values: Any) -> int:
        return 0

    def through(self, state: Any, weight: int) -> Any:
        """A state that blocked rows of this total weight have passed."""
        return state


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> list[tuple]:
    if not names:
        return [()] * batch.num_rows
    return list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _end_state_task(fold: Fold) -> Callable:
    """State after the rows of each chunk's last key, which are all it is given, had the key begun there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = state = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if chunk is None:
                chunk = _column(batch, CHUNK)[0].as_py()
                state = fold.start()
            for values in _columns(batch, fold.inputs):
                state, _ = fold.step(state, *values)
        if chunk is not None:
            yield pa.RecordBatch.from_pydict({CHUNK: pa.array([chunk], pa.int32()), "state": [json.dumps(state)]})

    return run


def exit_table(fold: Fold, rows: list[tuple]) -> dict[str, Any]:
    """What a chunk inside one key makes of the state it is entered with.

    Such a state blocks rows until it lapses; the first row after that, or one that resets,
    opens anew and forgets it.  The exit for every row that could be first to open follows
    from the exit of the row that opens after it, so one pass from the end finds all.
    Only rows up to the first one out of reach of earlier chunks can be first to open;
    neighbours with one exit share an entry, at the time of the last of them.
    """
    times = [r[0] for r in rows]
    total = list(accumulate((fold.weight(*r) for r in rows), initial=0))
    resets = [i for i, r in enumerate(rows) if fold.resets(*r)]
    exits: list[Any] = [None] * len(rows)
    reset = None
    for i in range(len(rows) - 1, -1, -1):
        state, _ = fold.step(fold.start(), *rows[i])
        lapse = fold.lapse(state)
        after = i + 1 if lapse is None else max(i + 1, bisect_left(times, lapse))
        if reset is not None and reset < after:
            after = reset
        exits[i] = exits[after] if after < len(rows) else fold.through(state, total[-1] - total[i + 1])
        if fold.resets(*rows[i]):
            reset = i
    end = min(resets[0] + 1 if resets else len(rows), bisect_left(times, times[0] + fold.reach) + 1)
    last = [i for i in range(end) if i + 1 == end or exits[i + 1] != exits[i]]
    return {"times": [times[i] for i in last], "exits": [exits[i] for i in last], "resets": bool(resets), "weight": total[-1]}


def exit_state(fold: Fold, table: dict[str, Any], state: Any) -> Any:
    lapse = None if state is None else fold.lapse(state)
    first = 0 if lapse is None else bisect_left(table["times"], lapse)
    if first < len(table["times"]):
        return table["exits"][first]
    return table["exits"][-1] if table["resets"] else fold.through(state, table["weight"])


def _exit_table_task(fold: Fold) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chunk = [], None
        for batch in batches:
            if batch.num_rows:
                chunk = _column(batch, CHUNK)[0].as_py()
                rows += _columns(batch, fold.inputs)
        if rows:
            yield pa.RecordBatch.from_pydict({CHUNK: pa.array([chunk], pa.int32()), "table": [fold.table(rows)]})

    return run


def _chain_task(fold: Fold, begin: dict[int, Any]) -> Callable:
    """The state at the end of every chunk, from the chunks' tables in order; `begin` has what each key's first is entered with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = state = None
        for batch in batches:
            ends = []
            for key_head, table in zip(_column(batch, "_head").to_pylist(), _column(batch, "table").to_pylist()):
                if key_head != head:
                    head, state = key_head, begin[key_head]
                state = fold.enter(table, state)
                ends.append(json.dumps(state))
            yield pa.RecordBatch.from_pydict({CHUNK: _column(batch, CHUNK), "state": pa.array(ends, pa.string())})

    return run


def _changes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before it; nulls are alike."""
    differs = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        codes = _column(batch, name).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        differs |= codes[1:] != codes[:-1]
    return differs


def _fold_task(fold: Fold, keys: Sequence[str], carry: dict[int, Any], arrow_types: list) -> Callable:
    """The fold's outputs for every row; a chunk's first key starts from what was carried in.

    Islands are rows of one key without a gap in which any state is forgotten. Those whose answer
    can be told from their columns are answered for the whole batch at once, the others row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sec = None
        state, started = fold.start(), False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            times = _column(batch, fold.inputs[0]).to_numpy(zero_copy_only=False)
            first = _columns(batch.slice(0, 1), keys)[0]
            if not started:
                at = _column(batch, CHUNK)[0].as_py()
                state, opens, started = carry.get(at, state), at not in carry, True
            else:
                opens = first != key or times[0] - sec >= fold.reach
            begins = np.r_[opens, _changes(batch, keys) | (np.diff(times) >= fold.reach)]
            start = np.flatnonzero(begins)
            end = np.r_[start[1:], batch.num_rows].astype(np.int64)
            closed = fold.closed(batch, start, end)
            outs = [np.array(x, object) for x in fold.answers(batch, begins)]
            one_by_one = [(a, b, fold.start()) for a, b in zip(start[~closed].tolist(), end[~closed].tolist())]
            if not opens:  # goes on with what the rows before left
                one_by_one.insert(0, (0, int(start[0]) if len(start) else batch.num_rows, state))
            for a, b, state in one_by_one:
                for i, values in enumerate(_columns(batch.slice(a, b - a), fold.inputs), a):
                    state, out = fold.step(state, *values)
                    for column, value in zip(outs, out):
                        column[i] = value
            if len(start) and closed[-1]:
                state = fold.start()
                for values in _columns(batch.slice(start[-1]), fold.inputs):
                    state, _ = fold.step(state, *values)
            key, sec = _columns(batch.slice(batch.num_rows - 1), keys)[0], times[-1]
            kept = [n for n in batch.schema.names if n != CHUNK]
            made = [pa.array(col.tolist(), t) for col, t in zip(outs, arrow_types)]
            names = kept + [n for n, _ in fold.outputs]
            yield pa.RecordBatch.from_arrays([_column(batch, n) for n in kept] + made, names=names)

    return run


_ARROW = {
    T.LongType(): pa.int64(),
    T.BooleanType(): pa.bool_(),
    T.StringType(): pa.string(),
}


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Fold,
    n_chunks: int | None = None,
) -> DataFrame:
    """Input columns plus the fold's outputs."""
    import clipledger.operators.chunks as here

    # ship this code with the tasks, so executors need no installed copy
    cloudpickle.register_pickle_by_value(here)
    rows = range_chunks(df, keys, order, n_chunks)
    keys = list(keys)
    key = F.struct(*keys)
    spans = rows.groupBy(CHUNK).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    # one short row per partition
    known = {
        r[CHUNK]: (r["first"], r["last"])
        for r in spans.select(CHUNK, F.to_json("_first").alias("first"), F.to_json("_last").alias("last")).collect()
    }
    order_of = sorted(known)
    # chunks whose first key began earlier, with the chunk before them
    entered = {now: prev for prev, now in zip(order_of, order_of[1:]) if known[prev][1] == known[now][0]}
    needed = sorted(set(entered.values()))

    inputs = list(dict.fromkeys(fold.inputs))

    states: dict[int, Any] = {}
    if needed:
        last_keys = rows.where(F.col(CHUNK).isin(needed)).join(F.broadcast(spans.select(CHUNK, "_last")), CHUNK)
        tails = last_keys.where(key.eqNullSafe(F.col("_last"))).select(CHUNK, *inputs)
        found = tails.mapInArrow(_end_state_task(fold), f"{CHUNK} int, state string").collect()
        states = {r[CHUNK]: json.loads(r["state"]) for r in found}
    # only the end of a chunk inside one key depends on what the chunk was entered with
    inner = [c for c in needed if c in entered and known[c][0] == known[c][1]]
    if inner:  # one job for all tables, one that applies those of each key in turn
        spark, head = df.sparkSession, {}
        for c in inner:
            head[c] = head.get(entered[c], c)
        begin = {c: states[entered[c]] for c in set(head.values())}
        tables = durable(rows.where(F.col(CHUNK).isin(inner)).select(CHUNK, *inputs).mapInArrow(_exit_table_task(fold), f"{CHUNK} int, table binary"))
        heads = spark.createDataFrame(list(head.items()), f"{CHUNK} int, _head int")
        in_turn = tables.join(F.broadcast(heads), CHUNK).repartition("_head").sortWithinPartitions("_head", CHUNK)
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):  # a task holds one table at a time
            found = in_turn.mapInArrow(_chain_task(fold, begin), f"{CHUNK} int, state string").collect()
        states.update({r[CHUNK]: json.loads(r["state"]) for r in found})
    carry = {now: states[prev] for now, prev in entered.items()}

    fields = [f for f in rows.schema.fields if f.name != CHUNK]
    fields += [T.StructField(n, t) for n, t in fold.outputs]
    arrow_types = [_ARROW[t] for _, t in fold.outputs]
    return rows.mapInArrow(_fold_task(fold, keys, carry, arrow_types), T.StructType(fields))
