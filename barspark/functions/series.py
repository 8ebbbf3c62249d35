"""Recurrences of series of a bounded number of bars, as kernels over sorted Arrow batches.

Spark deals and sorts the bars; a task takes whole series from its batches and holds a batch and one series at most. A fold over arrays in the
JVM is interpreted and builds new arrays bar by bar; here what has no recurrence is taken for all bars of a batch at once, and an average is a
short loop. The operations are those of functions/recurrence.py in the same order, so lines are the same to the last bit (powers behind a gap
are those of the platform). Series of more bars are its matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from barspark.functions.recurrence import Smoothing
from barspark.functions.trailing import placed, trailed

if TYPE_CHECKING:
    from barspark.functions.scan import Scan


def _steps(alpha: float | Smoothing) -> tuple[Callable[[float, float], float], Callable[[float, float, int], float]]:
    """The next average from the old one and a value: right behind it, and behind a gap of so many bars."""
    if not isinstance(alpha, Smoothing):

        def behind_share(y: float, x: float, gap: int) -> float:
            old = math.pow(1.0 - alpha, gap + 1)
            c = old / (old + alpha)
            return c * y + (1 - c) * x

        return lambda y, x: y + alpha * (x - y), behind_share
    m = alpha.m

    def weighed(y: float, x: float, w: float) -> float:
        return (w * y + x / m) / (w + 1.0 / m)

    def behind(y: float, x: float, gap: int) -> float:
        w = 1.0
        for _ in range(gap + 1):
            w = w * (m - 1) / m
        return weighed(y, x, w)

    share = 1.0 * (m - 1) / m
    return (lambda y, x: weighed(y, x, share)) if alpha.mean else (lambda y, x: y + (x - y) / m), behind


def smoothed(xs: np.ndarray, first: Sequence[bool], alpha: float | Smoothing) -> np.ndarray:
    """Exponential averages along xs, anew where first is true; NaN is no value, and none is known before the first one."""
    plain, behind = _steps(alpha)
    out, y, gap = [], math.nan, 0
    for x, new in zip(xs.tolist(), first, strict=True):
        if new:
            y, gap = math.nan, 0
        if x != x:
            gap += 1
        else:
            y = x if y != y else behind(y, x, gap) if gap else plain(y, x)
            gap = 0
        out.append(y)
    return np.array(out)


class _Lines:
    """Lines along series that lie one behind the other, each line once; NaN is no value."""

    def __init__(self, xs: dict[str, np.ndarray], place: np.ndarray) -> None:
        self.xs, self.place, self.first = xs, place, (place == 0).tolist()
        self.done: dict[Hashable, np.ndarray] = {}

    def once(self, name: Hashable, made: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.done:
            self.done[name] = made()
        return self.done[name]

    def average(self, name: str, xs: np.ndarray, alpha: float | Smoothing) -> np.ndarray:
        return self.once((name, alpha), lambda: smoothed(xs, self.first, alpha))

    def before(self, column: str) -> np.ndarray:
        return np.where(self.place == 0, np.nan, np.roll(self.xs[column], 1))

    def trailing(self, kind: str, column: str, n: int) -> np.ndarray:
        def made() -> np.ndarray:
            x = self.xs[column]
            value, full = trailed(kind, n, x, ~np.isnan(x), self.place)
            return np.where(full, value, np.nan)

        return self.once((kind, column, n), made)

    def rsi(self, n: int) -> np.ndarray:
        change = self.xs["close"] - self.before("close")
        gain, loss = (self.average(name, np.maximum(x, 0.0), 1.0 / n) for name, x in (("gain", change), ("loss", -change)))
        # 100 where there was no loss but a gain, null where there was neither.
        return np.where(loss == 0, np.where(gain > 0, 100.0, np.nan), 100 - 100 / (1 + gain / loss))

    def kdj(self, n: int, m1: int, m2: int) -> list[np.ndarray]:
        low, high = self.trailing("lowest", "low", n), self.trailing("highest", "high", n)
        rsv = np.where(high != low, 100 * (self.xs["close"] - low) / (high - low), np.nan)
        k = self.average(f"rsv_{n}", rsv, Smoothing(m1, mean=True))
        d = self.average(f"k_{n}_{m1}", k, Smoothing(m2))
        return [rsv, k, d, 3 * k - 2 * d]

    def dmi(self, n: int) -> list[np.ndarray]:
        high, low, close = self.xs["high"], self.xs["low"], self.before("close")
        up, down = high - self.before("high"), self.before("low") - low
        move = lambda a, b: np.where((a > b) & (a > 0), a, 0.0)
        ranges = np.fmax(np.fmax(high - low, np.abs(high - close)), np.abs(low - close))
        alpha = 2.0 / (n + 1)
        atr, plus, minus = (self.average(name, x, alpha) for name, x in (("range", ranges), ("plus", move(up, down)), ("minus", move(down, up))))
        pdi, mdi = (np.where(atr != 0, 100 * x / atr, np.nan) for x in (plus, minus))
        dx = np.where(pdi + mdi != 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), np.nan)
        return [pdi, mdi, self.average(f"dx_{n}", dx, alpha)]

    def of(self, scan: Scan) -> list[np.ndarray]:
        a, source = scan.args, scan.source if scan.source in self.xs else "close"
        ema = lambda n: self.average(f"x_{source}", self.xs[source], 2.0 / (n + 1))
        if scan.kind == "ema":
            return [ema(a[0])]
        if scan.kind in ("sma", "wma"):
            return [self.trailing({"sma": "mean", "wma": "weighted"}[scan.kind], source, int(a[0]))]
        if scan.kind == "macd":
            dif = ema(a[0]) - ema(a[1])
            signal = self.average(f"dif_{scan.prefix}", dif, 2.0 / (a[2] + 1))
            return [dif, signal, dif - signal]
        if scan.kind == "rsi":
            return [self.rsi(int(a[0]))]
        if scan.kind == "kdj":
            return self.kdj(*map(int, a[:3]))
        if scan.kind == "dmi":
            return self.dmi(int(a[0]))
        if scan.kind == "jae":
            fast = self.rsi(int(a[0]))
            return [fast, self.kdj(*map(int, a[1:4]))[3], self.average(f"rsi_{int(a[0])}", fast, 2.0 / (a[4] + 1))]
        raise ValueError(f"unknown recurrence {scan.kind}")


def with_lines(bars: DataFrame, scans: Sequence[Scan], inputs: Sequence[str], key: str, ts: str) -> DataFrame:
    """bars with the output columns of all scans, from one shuffle; each series is held whole by a task. Ties of ts go by the other columns."""
    outputs = [o for s in scans for o in s.outputs]

    def lined(rows: pa.RecordBatch) -> pa.RecordBatch:
        xs = {c: rows.column(c).cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in inputs}
        with np.errstate(all="ignore"):  # quotients that are not told, and windows over two series
            lines = _Lines(xs, placed(rows.column(key)))
            made = [pa.array(x, mask=np.isnan(x)) for s in scans for x in lines.of(s)]
        return pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            # The last series may go on in the next batch.
            last = int(np.flatnonzero(placed(rows.column(key)) == 0)[-1])
            if last:
                yield lined(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield lined(held)

    others = [f"`{c}`" for c in bars.columns if c not in (key, ts)]
    dealt = bars.repartition(f"`{key}`").sortWithinPartitions(f"`{key}`", f"`{ts}`", *others)
    schema = StructType([*bars.schema.fields, *(StructField(o, DoubleType()) for o in outputs)])
    return dealt.mapInArrow(run, schema)
