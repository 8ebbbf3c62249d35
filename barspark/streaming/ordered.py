"""Folds over streams in order of event time, whatever order and batches rows come in.

Rows wait in the state of their key until the watermark has passed them; a timer on event time wakes the key then, and what is due is
folded in order. They wait in chunks of a slice of time each, as Arrow batches, and slices are read, sorted and folded one after the other: Python holds a
slice of a key, however much of it waits. So a row that comes late, but within the watermark's delay, takes its place, and results don't hang on how rows were cut into
batches. A fold may also name a time at which something is due though no row comes; the same timers wake it for that. Rows behind the
watermark are dropped, by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: What keeps the state of these folds: the only store that has timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Row(NamedTuple):
    """us: microseconds of event time; seq orders rows of one time; side is +1 or -1 where a row has one."""

    us: int
    seq: int
    kind: str | None
    label: str | None
    value: float | None
    side: float | None


class Fold:
    """One key's life: a state of the given schema, moved by rows in order and by times that come due."""

    state = "x double"
    output = "what string, value double"

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: Row) -> tuple[tuple, list[tuple]]:
        """The next state and what is put out, each with the fields of output."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When something happens if no row does."""
        return None

    def lapse(self, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []


def advanced(fold: Fold, state: tuple, rows: Iterable[Row], until: int) -> tuple[tuple, list[tuple]]:
    """Folds rows in order, and what comes due before them or by until; what is put out begins with its microseconds.

    Order is time, then seq; rows alike in both go by kind (those with one first), label and value.
    """
    ordered = sorted(rows, key=lambda r: (r.us, r.seq, r.kind is None, r.kind or "", r.label or "", r.value or 0.0))
    state, out = _stepped(fold, state, ordered)
    state, last = _lapsed(fold, state, until)
    return state, out + last


def _stepped(fold: Fold, state: tuple, ordered: Iterable[Row]) -> tuple[tuple, list[tuple]]:
    out: list[tuple] = []
    for row in ordered:
        state, lapsed = _lapsed(fold, state, row.us)
        state, new = fold.step(state, row)
        out += lapsed
        out.extend((row.us, *x) for x in new)
    return state, out


def _lapsed(fold: Fold, state: tuple, until: int) -> tuple[tuple, list[tuple]]:
    out: list[tuple] = []
    while (due := fold.due(state)) is not None and due <= until:
        state, new = fold.lapse(state)
        out.extend((due, *x) for x in new)
    return state, out


#: Microseconds of a slice: what of a key is sorted at once.
SLICE = 3_600_000_000

#: Rows that are gathered before they are cut into chunks, and rows that are Python objects at once.
GATHERED, AT_ONCE = 100_000, 10_000

_FIELDS = pa.schema([("us", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("label", pa.string()), ("value", pa.float64()), ("side", pa.float64())])


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, names: list[str]):
        self.fold, self.names = fold, names

    def init(self, handle: Any) -> None:
        self.handle = handle
        # A chunk goes by its first time and a number.
        self.waiting = handle.getMapState("chunks", "first long, number long", "rows binary")
        self.numbered = handle.getValueState("numbered", "number long")
        self.kept = handle.getValueState("kept", self.fold.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, gathered = None, []
        for batch in rows:
            # NaN is how pandas writes a missing number; Arrow reads it as null.
            gathered.append(pa.Table.from_pandas(batch[_FIELDS.names], _FIELDS, preserve_index=False))
            if sum(map(len, gathered)) >= GATHERED:
                first, gathered = _earlier(first, self._wait(gathered)), []
        if gathered:
            first = _earlier(first, self._wait(gathered))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def _wait(self, tables: list[pa.Table]) -> int | None:
        """Stores rows, a chunk a slice, and returns their first time."""
        table = pa.concat_tables(tables)
        table = table.take(pc.sort_indices(table["us"])).combine_chunks()
        if not len(table):
            return None
        us = table["us"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(us // SLICE)) + 1).tolist(), len(us)]
        number = self.numbered.get()[0] if self.numbered.exists() else 0
        for at, end in zip(cuts, cuts[1:], strict=False):
            # Taken, not sliced: a slice would be written with the texts of its whole.
            part = table.take(np.arange(at, end)).combine_chunks().to_batches()[0]
            self.waiting.updateValue((int(us[at]), number), (part.serialize().to_pybytes(),))
            number += 1
        self.numbered.update((number,))
        return int(us[0])

    def _slice(self, chunks: list[tuple[int, int]]) -> pa.Table:
        """The rows of chunks, which wait no longer."""
        batches = []
        for chunk in chunks:
            batches.append(pa.ipc.read_record_batch(pa.py_buffer(bytes(self.waiting.getValue(chunk)[0])), _FIELDS))
            self.waiting.removeKey(chunk)
        return pa.Table.from_batches(batches)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        state = tuple(self.kept.get()) if self.kept.exists() else self.fold.start()
        # A slice is due or none of it is, but for the one that the watermark is in, whose later rows wait on.
        chunks = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys()) if self.waiting.exists() else []
        first = next((us for us, _ in chunks if us > until), None)
        for _, due in groupby((c for c in chunks if c[0] <= until), key=lambda c: c[0] // SLICE):
            rows = self._slice(list(due))
            later = rows.filter(pc.greater(rows["us"], until))
            if len(later):
                first = _earlier(first, self._wait([later]))
            for some in _sorted(rows.filter(pc.less_equal(rows["us"], until))):
                state, out = _stepped(self.fold, state, some)
                yield from self._frame(key, out)
        state, out = _lapsed(self.fold, state, until)
        self.kept.update(state)
        times = [t for t in (first, self.fold.due(state)) if t is not None]
        if times:
            # Never at or before the watermark, where it would be over at once.
            self.handle.registerTimer(max(min(times) // 1000, until // 1000 + 1))
        yield from self._frame(key, out)

    def _frame(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=self.names)

    def close(self) -> None:
        pass


def _earlier(a: int | None, b: int | None) -> int | None:
    return min((x for x in (a, b) if x is not None), default=None)


def _sorted(rows: pa.Table) -> Iterator[list[Row]]:
    """Rows in the order of advanced, some at a time."""
    plain = pa.table([rows["us"], rows["seq"], rows["kind"], pc.fill_null(rows["label"], ""), pc.fill_null(rows["value"], 0.0)], names=list("abcde"))
    rows = rows.take(pc.sort_indices(plain, sort_keys=[(c, "ascending") for c in plain.column_names]))
    for at in range(0, len(rows), AT_ONCE):
        yield list(map(Row._make, zip(*(c.to_pylist() for c in rows.slice(at, AT_ONCE).columns), strict=True)))


def in_order(stream: DataFrame, fold: Fold, late: str) -> DataFrame:
    """key, ts and the output of the fold: stream has key (a text), ts (a TIMESTAMP) and, of Row's fields, those that the fold needs.

    Rows without key or ts belong nowhere and are left out. Rows that repeat are rows of their own.
    """
    missing = {"seq": F.lit(0).cast("long"), "kind": F.lit(None).cast("string"), "label": F.lit(None).cast("string"), "value": F.lit(None).cast("double"), "side": F.lit(None).cast("double")}
    rows = stream.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts", F.unix_micros("ts").alias("us"), *(F.col(c).cast(F_TYPES[c]).alias(c) if c in stream.columns else x.alias(c) for c, x in missing.items()))
    schema = f"key string, us long, {fold.output}"
    names = [part.split()[0] for part in schema.split(", ")]
    moved = rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Ordered(fold, names), schema, "Append", "EventTime")
    return moved.select("key", F.timestamp_micros("us").alias("ts"), *names[2:])


F_TYPES = {"seq": "long", "kind": "string", "label": "string", "value": "double", "side": "double"}
