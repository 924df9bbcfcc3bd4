"""Streaming decisions with per-key state, taken in the order of event time.

Rows wait in their key's state until the watermark has passed their second; an event-time timer
then decides all that are due, in order. So the answer is the batch operator's, however rows are
spread over files and micro-batches, as long as none comes later than the watermark allows. A row that
does takes no part: it comes out with the decision ``late``, so that counts add up.

Time goes on with the rows; where none arrive, a stream of ticks (a column ``ts``) moves it. Ticks
change no decision. A tick beyond the end of a replay settles what still waits.

Before rows reach the keyed state, each task drops or settles what cannot change a
decision: later repeats of a second, requests beyond a second's quota, progress rows
that are neither first nor last of their second.  A hot key then sends a handful
of rows per second and task to its state, not its whole traffic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEC = "at_sec"  # state rows travel as named tuples, which take no leading underscore
LATE = "late"


def _ship() -> None:
    import clipledger.streaming.stateful as here

    cloudpickle.register_pickle_by_value(here)


def _ms(sec: int) -> int:
    """When the watermark has passed a second."""
    return (sec + 1) * 1000


class _InOrder(StatefulProcessor):
    """Rows (second, micros, id, note) wait for their turn; subclasses say what becomes of them.

    ``id_type`` is the type of ids; notes are strings. Every call to the state is a round trip, and every row in it
    is packed by itself: so rows that came together wait as one row of arrays, and a key's timer and what its
    subclass remembers (``fields``; a tuple, or None for nothing) are one value.
    """

    def __init__(self, keys: Sequence[str], id_col: str, id_type: str, fields: str):
        self.keys, self.id_col, self.id_type, self.fields = list(keys), id_col, id_type, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        lot = f"sec array<bigint>, at array<bigint>, id array<{self.id_type}>, note array<string>"
        self.waiting = handle.getListState("waiting", lot)
        # when the timer goes off, whether anything is remembered, and that
        self.slot = handle.getValueState("slot", f"alarm bigint, knows boolean, {self.fields}")
        self.nothing = (None,) * (self.fields.count(",") + 1)

    # --- for subclasses

    def step(self, own: tuple | None, due: Iterable[tuple], out: list[tuple]) -> tuple | None:
        """Adds rows (id, at, note, decision) that come of due rows, which are in order; returns what is remembered then."""
        raise NotImplementedError

    def lapses(self, own: tuple) -> int:
        """When what is remembered can no longer matter, in ms."""
        raise NotImplementedError

    def lapse(self, own: tuple, out: list[tuple]) -> None:
        """Adds rows that come of a lapse, after which nothing is remembered."""

    # --- the turn of rows

    def _table(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        columns = [[k] * len(rows) for k in key] + [list(c) for c in zip(*rows, strict=True)]
        return pd.DataFrame(dict(zip([*self.keys, self.id_col, "at", "note", "decision"], columns, strict=True)))

    def _slot(self) -> tuple[int | None, tuple | None]:
        got = self.slot.get()
        if got is None:
            return None, None
        alarm, knows, *own = got
        return alarm, tuple(own) if knows else None

    def _keep(self, alarm: int | None, own: tuple | None) -> None:
        if alarm is None and own is None:
            self.slot.clear()
        else:
            self.slot.update((alarm, own is not None, *(own or self.nothing)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            got = list(zip(*(pdf[c].tolist() for c in (SEC, "at", self.id_col, "note", "tick")), strict=True))
            live = [r[:4] for r in got if not r[4]]
            late = [(i, at, note, LATE) for sec, at, i, note in live if _ms(sec) <= passed]
            if late:
                yield self._table(key, late)
                live = [r for r in live if _ms(r[0]) > passed]
            if live:
                self.waiting.appendValue(tuple(map(list, zip(*live, strict=True))))
                low = min(r[0] for r in live)
                first = low if first is None else min(first, low)
        if first is None:
            return
        # what waits already has a timer of its own, unless the timer is for a lapse, which can wait for these rows
        alarm, own = self._slot()
        if alarm is None or _ms(first) < alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(_ms(first))
            self._keep(_ms(first), own)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        _, own = self._slot()  # the timer has gone off
        every = [r for lot in self.waiting.get() for r in zip(*lot, strict=True)]
        due = sorted((r for r in every if _ms(r[0]) <= passed), key=lambda r: (r[0], r[1], r[2]))
        rest = [r for r in every if _ms(r[0]) > passed]
        out: list[tuple] = []
        own = self.step(own, due, out)
        if rest and due:
            self.waiting.put([tuple(map(list, zip(*rest, strict=True)))])
        elif due:
            self.waiting.clear()
        ends = None if own is None else self.lapses(own)
        if ends is not None and ends <= passed:  # rows that still wait are later than the lapse
            self.lapse(own, out)
            own = ends = None
        alarm = min([_ms(r[0]) for r in rest] + ([ends] if ends is not None else []), default=None)
        if alarm is not None:
            self.handle.registerTimer(alarm)
        self._keep(alarm, own)
        if out:
            yield self._table(key, out)

    def close(self) -> None:
        pass


def _decided(
    stream: DataFrame, keys: list[str], id_col: str, note: Column, processor: _InOrder, lateness: str, ticks: DataFrame | None
) -> DataFrame:
    """keys, id, at (micros), note, decision."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.select(*keys, id_col, "ts", note.alias("note"), F.lit(False).alias("tick"))
    if ticks is not None:
        blank = [F.lit(None).cast(types[c]).alias(c) for c in keys]
        rows = rows.unionByName(ticks.select(*blank, F.lit(0).cast(types[id_col]).alias(id_col), "ts", F.lit("").alias("note"), F.lit(True).alias("tick")))
    # without the time column itself: Spark would drop late rows before the state sees them
    timed = rows.withWatermark("ts", lateness).select(
        *keys, id_col, "note", "tick", F.unix_micros("ts").alias("at"), F.unix_seconds("ts").alias(SEC)
    )
    out = ", ".join(f"{c} {types[c]}" for c in [*keys, id_col]) + ", at bigint, note string, decision string"
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime"
    )


def _id_type(stream: DataFrame, id_col: str) -> str:
    return next(f.dataType.simpleString() for f in stream.schema.fields if f.name == id_col)


class _Dedup(_InOrder):
    """Keeps a row when the last kept one is more than ``ttl`` seconds older."""

    def __init__(self, keys, id_col, id_type, ttl: int):
        super().__init__(keys, id_col, id_type, "sec bigint")
        self.ttl = ttl

    def step(self, own, due, out):
        kept = own[0] if own else None
        for sec, at, i, note in due:
            if kept is None or sec - kept > self.ttl:
                kept = sec
                out.append((i, at, note, "kept"))
        return None if kept is None else (kept,)

    def lapses(self, own):
        return _ms(own[0] + self.ttl)


def stream_dedup(
    stream: DataFrame,
    keys: Sequence[str],
    ttl_s: int,
    *,
    lateness: str = "10 minutes",
    id_col: str = "request_id",
    ticks: DataFrame | None = None,
) -> DataFrame:
    """The kept rows of a request stream, and those too late to be judged: keys, id, ts, decision (``kept``, ``late``).

    A kept row re-anchors, as in the batch operator. Of a late second the first row of each task is told.
    """
    _ship()
    keys = list(keys)

    def first_of_second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.sort_values(["ts", id_col]).drop_duplicates([*keys, SEC])

    rows = stream.select(*keys, id_col, "ts", F.unix_seconds("ts").alias(SEC))
    few = rows.mapInPandas(first_of_second, rows.schema)
    processor = _Dedup(keys, id_col, _id_type(stream, id_col), ttl_s)
    judged = _decided(few, keys, id_col, F.lit(""), processor, lateness, ticks)
    return judged.select(*keys, id_col, F.timestamp_micros("at").alias("ts"), "decision")


class _Quota(_InOrder):
    """Anchored fixed window with at most ``n`` grants."""

    def __init__(self, keys, id_col, id_type, n: int, window: int):
        super().__init__(keys, id_col, id_type, "anchor bigint, used bigint")
        self.n, self.window = n, window

    def step(self, own, due, out):
        anchor, used = own or (None, 0)
        for sec, at, i, note in due:
            if anchor is None or sec - anchor >= self.window:
                anchor, used = sec, 0
            out.append((i, at, note, "allowed" if used < self.n else "denied"))
            used = min(used + 1, self.n)
        return None if anchor is None else (anchor, used)

    def lapses(self, own):
        return _ms(own[0] + self.window - 1)


def stream_rate_limit(
    stream: DataFrame,
    keys: Sequence[str],
    n: int,
    window_s: int,
    *,
    lateness: str = "10 minutes",
    id_col: str = "request_id",
    ticks: DataFrame | None = None,
) -> DataFrame:
    """Request ids with a decision (``allowed``, ``denied``, ``late``), one row for each request; ``n`` = 0 turns the limit off.

    Requests past the n-th of a second in one task are denied at once: n others of their second come first.
    """
    if n == 0:
        return stream.select(id_col, F.lit("allowed").alias("decision"))
    _ship()
    keys = list(keys)
    rows = stream.select(*keys, id_col, "ts", F.unix_seconds("ts").alias(SEC))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["ts", id_col])
            yield pdf.assign(_live=pdf.groupby([*keys, SEC]).cumcount() < n)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    marked = rows.mapInPandas(mark, types + ", _live boolean")
    processor = _Quota(keys, id_col, _id_type(stream, id_col), n, window_s)
    judged = _decided(marked.where("_live"), keys, id_col, F.lit(""), processor, lateness, ticks)
    return judged.select(id_col, "decision").union(marked.where("NOT _live").select(id_col, F.lit("denied").alias("decision")))


_SAID = "stage string, done bigint, total bigint"


class _Debounce(_InOrder):
    """Shows rows that must show or are due; holds the last other one until the job ends.

    A note is a letter (w: may wait, e: the job's end, both or neither: -) and what the row says.
    """

    def __init__(self, keys, id_col, id_type, wait: int, idle: int):
        # last second shown, last second seen, what was shown, the held row
        super().__init__(keys, id_col, id_type, f"shown bigint, seen bigint, sent string, held_at bigint, held_id {id_type}, held string")
        self.wait, self.idle = wait, idle

    def _flush(self, out, sent, at, i, held):
        if held is not None and held != sent:
            out.append((i, at, held, "flushed"))

    def step(self, own, due, out):
        shown, seen, sent, at0, id0, held = own or self.nothing
        for sec, at, i, note in due:
            if seen is not None and sec > seen + self.idle:  # the timer would have gone off between the two
                self._flush(out, sent, at0, id0, held)
                shown = sent = at0 = id0 = held = None
            kind, said, seen = note[:2], note[2:], sec
            if "w" not in kind or shown is None or sec - shown >= self.wait:
                out.append((i, at, said, "shown"))
                shown, sent, at0, id0, held = sec, said, None, None, None
            else:
                at0, id0, held = at, i, said
            if "e" in kind:
                self._flush(out, sent, at0, id0, held)
                shown = seen = sent = at0 = id0 = held = None
        return None if shown is None else (shown, seen, sent, at0, id0, held)

    def lapses(self, own):
        return _ms(own[1] + self.idle)

    def lapse(self, own, out):
        self._flush(out, *own[2:])


def stream_progress_debounce(
    stream: DataFrame, debounce_s: int, *, idle_s: int = 86_400, lateness: str = "10 minutes", ticks: DataFrame | None = None
) -> DataFrame:
    """Progress rows of a stream of job, seq, ts, stage, done, total and, if it has one, ends.

    Comes out as job, seq, stage, done, total, decision (``shown``, ``flushed``, ``late``). A row with ``ends``
    is its job's last; it releases the held update and the job's state, and so does a timer ``idle_s``
    after a job's last row. Without a wait every row is shown.
    """
    body = ["job", "seq", "stage", "done", "total"]
    if debounce_s <= 0:
        return stream.select(*body, F.lit("shown").alias("decision"))
    _ship()
    ends = F.coalesce(F.col("ends"), F.lit(False)) if "ends" in stream.columns else F.lit(False)
    wait = F.coalesce((F.col("stage") == "transcoding") & (F.col("done") < F.col("total")), F.lit(False))
    kind = F.concat(F.when(wait, "w").otherwise("-"), F.when(ends, "e").otherwise("-"))
    said = F.to_json(F.struct("stage", "done", "total"))
    rows = stream.select("job", "seq", "ts", kind.alias("kind"), said.alias("said"), F.unix_seconds("ts").alias(SEC))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # of a second only the first row, the last forced one and the last waiting one can matter
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "seq"])
            second = pdf.groupby(["job", SEC])
            last_of_kind = pdf.groupby(["job", SEC, "kind"]).cumcount(ascending=False) == 0
            yield pdf.assign(_live=(second.cumcount() == 0) | last_of_kind | pdf["kind"].str.contains("e"))

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    marked = rows.mapInPandas(mark, types + ", _live boolean")
    processor = _Debounce(["job"], "seq", _id_type(stream, "seq"), debounce_s, idle_s)
    judged = _decided(marked.where("_live"), ["job"], "seq", F.concat("kind", "said"), processor, lateness, ticks)
    late = F.col("decision") == LATE
    judged = judged.select("job", "seq", F.when(late, F.substr("note", F.lit(3))).otherwise(F.col("note")).alias("said"), "decision")
    # forced rows between the first and the last of a second are shown whatever came before
    forced = marked.where("NOT _live AND kind NOT LIKE 'w%'").select("job", "seq", "said", F.lit("shown").alias("decision"))
    return judged.union(forced).withColumn("_said", F.from_json("said", _SAID)).select("job", "seq", "_said.*", "decision")
