"""Trailing windows of many bars as numeric kernels over sorted Arrow batches.

A sliding frame adds up its whole window anew for every bar, a row at a time; for averages of 240 bars that is most of a query. Here the same
sums are taken in the same order, the oldest bar first, but for all bars of a batch at once, so results are those of the frames to the last bit.
Spark deals and sorts the bars; a task holds a batch and as many bars before it as the longest window reaches back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from barspark.functions.indicators import BARS, Frame


def _mean(window: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    total = np.zeros_like(window(0))
    for k in range(n):
        total += window(k)
    return total / n


def _weighted(window: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    total = window(n - 1) * n
    for k in range(1, n):
        total += window(k - 1) * k
    return total / (n * (n + 1) / 2)


def _deviation(window: Callable[[int], np.ndarray], n: int) -> np.ndarray:
    mean, squares = np.zeros_like(window(0)), np.zeros_like(window(0))
    for k in range(n):
        delta = window(k) - mean
        share = delta / (k + 1.0)
        mean += share
        squares += delta * (delta - share)
    return np.sqrt(squares / (n - 1.0))


def _extreme(of: Callable) -> Callable[[Callable[[int], np.ndarray], int], np.ndarray]:
    def best(window: Callable[[int], np.ndarray], n: int) -> np.ndarray:
        found = window(0).copy()
        for k in range(1, n):
            of(found, window(k), out=found)
        return found

    return best


#: From the k-th values of all windows, the oldest being 0. NaN is above all numbers, as in SQL.
KERNELS = {"mean": _mean, "weighted": _weighted, "deviation": _deviation, "highest": _extreme(np.maximum), "lowest": _extreme(np.fmin)}


@dataclass(frozen=True)
class Trailing:
    """A line over the last n bars of a column: kind is mean, weighted (from 1 for the oldest to n), deviation (of a sample), highest or lowest."""

    kind: str
    source: str
    n: int

    def __post_init__(self) -> None:
        if self.kind not in KERNELS:
            raise ValueError(f"unknown line {self.kind}")
        if self.n < (2 if self.kind == "deviation" else 1):
            raise ValueError("a window has a bar at least, a deviation's two")


def placed(keys: pa.Array) -> np.ndarray:
    """How many rows of the same key are before each row."""
    at = np.arange(len(keys))
    later, earlier = keys.slice(1), keys.slice(0, max(len(keys) - 1, 0))
    same = pc.or_(pc.fill_null(pc.equal(later, earlier), False), pc.and_(pc.is_null(later), pc.is_null(earlier)))
    starts = np.concatenate([[True], ~same.to_numpy(zero_copy_only=False)])[: len(keys)]
    return at - np.maximum.accumulate(np.where(starts, at, 0))


def trailed(kind: str, n: int, x: np.ndarray, known: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line along x, and where its window has n known values of the same series."""
    size = len(x)
    value, full = np.zeros(size), np.zeros(size, bool)
    if (count := size - n + 1) > 0:
        seen = np.concatenate([[0], np.cumsum(known)])
        full[n - 1 :] = (place[n - 1 :] >= n - 1) & (seen[n:] - seen[:count] == n)
        value[n - 1 :] = KERNELS[kind](lambda k: x[k : k + count], n)
    return value, full


def dealt(bars: DataFrame, frame: Frame = BARS) -> DataFrame:
    """bars as with_trailing takes them: a series in one partition, in order. Windows over the same series keep that."""
    return bars.repartition(frame.key).sortWithinPartitions(frame.key, frame.ts)


def with_trailing(bars: DataFrame, lines: dict[str, Trailing], frame: Frame = BARS) -> DataFrame:
    """bars, which are dealt, with a column for each line; null where the window has fewer than n values that are not null."""
    columns = list(dict.fromkeys(t.source for t in lines.values()))
    reach, key = max(t.n for t in lines.values()) - 1, frame.key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, before = None, {c: (np.empty(0), np.empty(0, bool)) for c in columns}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key) if keys is None else pa.concat_arrays([keys, batch.column(key)])
            place, size = placed(keys), len(keys)
            for c in columns:
                x, known = batch.column(c).cast(pa.float64()), batch.column(c).is_valid()
                new = (x.fill_null(0.0).to_numpy(zero_copy_only=False), known.to_numpy(zero_copy_only=False))
                before[c] = tuple(np.concatenate(pair) for pair in zip(before[c], new, strict=True))
            made = []
            for t in lines.values():
                with np.errstate(all="ignore"):  # windows over two series are computed, too, and not told
                    value, full = trailed(t.kind, t.n, *before[t.source], place)
                old = size - batch.num_rows
                made.append(pa.array(value[old:], mask=~full[old:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *lines])
            left = max(size - reach, 0)
            keys, before = keys.slice(left), {c: (x[left:], known[left:]) for c, (x, known) in before.items()}

    schema = StructType([*bars.schema.fields, *(StructField(name, DoubleType()) for name in lines)])
    return bars.mapInArrow(run, schema)
