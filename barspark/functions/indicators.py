"""Indicators that trailing windows express, as Column builders.

A builder takes column names and a Frame, which names the ordering of bars. A window with fewer than n values gives null,
as does any division by zero; comparisons with null are false where a predicate is made of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frame:
    """The series: one for each value of key, in order of ts."""

    key: str = "symbol"
    ts: str = "ts"

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(self.key).orderBy(self.ts)

    def last(self, n: int) -> WindowSpec:
        """The current bar and the n - 1 before it."""
        return self.rows.rowsBetween(-(n - 1), 0)

    def previous(self, n: int) -> WindowSpec:
        """The n bars before the current one."""
        return self.rows.rowsBetween(-n, -1)

    def upto(self) -> WindowSpec:
        return self.rows.rowsBetween(Window.unboundedPreceding, 0)


BARS = Frame()


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(value: Column, counted: Column, n: int, window: WindowSpec) -> Column:
    """value where the window has n values that are not null."""
    return F.when(F.count(counted).over(window) == n, value)


def lag(x: Column | str, n: int = 1, frame: Frame = BARS) -> Column:
    return F.lag(as_col(x), n).over(frame.rows)


def sma(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    x, w = as_col(x), frame.last(n)
    return full(F.avg(x).over(w), x, n, w)


def wma(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    """Weights rise from 1 for the oldest to n for the current bar."""
    x = as_col(x)
    total = sum((lag(x, n - k, frame) * k for k in range(1, n)), x * n)
    return full(total / (n * (n + 1) / 2), x, n, frame.last(n))


def stddev(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    x, w = as_col(x), frame.last(n)
    return full(F.stddev_samp(x).over(w), x, n, w)


def highest(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    x, w = as_col(x), frame.last(n)
    return full(F.max(x).over(w), x, n, w)


def lowest(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    x, w = as_col(x), frame.last(n)
    return full(F.min(x).over(w), x, n, w)


def highest_before(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    x, w = as_col(x), frame.previous(n)
    return full(F.max(x).over(w), x, n, w)


def lowest_before(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    x, w = as_col(x), frame.previous(n)
    return full(F.min(x).over(w), x, n, w)


def bollinger(x: Column | str, n: int = 20, up: float = 2.0, down: float | None = None, frame: Frame = BARS, middle: Column | None = None) -> dict[str, Column]:
    """upper, middle, lower and width (percent of the middle); the deviation is that of x, whatever the middle's average."""
    mid = sma(x, n, frame) if middle is None else middle
    sd = stddev(x, n, frame)
    upper, lower = mid + sd * up, mid - sd * (up if down is None else down)
    return {"upper": upper, "middle": mid, "lower": lower, "width": F.try_divide(upper - lower, mid) * 100}


def rsi_simple(x: str, n: int = 14, frame: Frame = BARS, delta: Column | None = None) -> Column:
    """Relative strength from plain means of gains and losses; null where there was no loss.

    delta: a column with the change from the bar before; windows of windows need it materialised first.
    """
    d = F.col(f"{x}_delta") if delta is None else delta
    w = frame.last(n)
    gain = full(F.avg(F.greatest(d, F.lit(0.0))).over(w), d, n, w)
    loss = full(F.avg(F.greatest(-d, F.lit(0.0))).over(w), d, n, w)
    return 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss))


def true_range(frame: Frame = BARS) -> Column:
    before = lag("close", 1, frame)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr_simple(n: int = 14, frame: Frame = BARS, ranges: str = "true_range") -> Column:
    return sma(ranges, n, frame)


def roc(x: Column | str, n: int, frame: Frame = BARS) -> Column:
    return (F.try_divide(as_col(x), lag(x, n, frame)) - 1) * 100


def vwap(frame: Frame = BARS) -> Column:
    """From the start of the series; a bar without volume weighs 1."""
    volume = F.when(F.col("volume") == 0, 1.0).otherwise(F.col("volume"))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.sum(typical * volume).over(frame.upto()) / F.sum(volume).over(frame.upto())


def difference(x: Column | str, frame: Frame = BARS) -> Column:
    return as_col(x) - lag(x, 1, frame)


def true_or_false(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def cross_up(a: str, b: Column | str, frame: Frame = BARS) -> Column:
    b = as_col(b)
    return true_or_false((lag(a, 1, frame) <= F.lag(b).over(frame.rows)) & (F.col(a) > b))


def cross_down(a: str, b: Column | str, frame: Frame = BARS) -> Column:
    b = as_col(b)
    return true_or_false((lag(a, 1, frame) >= F.lag(b).over(frame.rows)) & (F.col(a) < b))
