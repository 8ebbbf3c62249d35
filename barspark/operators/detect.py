"""All chart patterns on every bar, as kernels over sorted Arrow batches.

The detectors are those of operators/evaluate.py and the frames of operators/patterns.py, with the same operations in the same order, but for all bars of a
batch at once: folds over arrays in the JVM are interpreted, and a sliding frame looks through its whole window anew for every bar. Runs of swing candidates are folded once
in a short loop, extremes of a window come from those of 1, 2, 4 ... bars. Spark deals and sorts the bars; a task holds a batch and as many bars before it as
the longest window reaches back, so a series of any length takes the memory of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from barspark.functions.recurrence import long_series
from barspark.functions.trailing import placed
from barspark.operators.evaluate import FAR, FRAMES, NAMES, NEAR, NEED, PATTERNS, WEDGES, evaluated
from barspark.operators.patterns import Settings
from barspark.sources.scratch import attached, written

#: A series of at most so many bars is one task, of about a minute; a longer one is cut into blocks in the JVM, which took 14 times as long on 8 cores but are as many tasks as Spark likes.
WHOLE = 1 << 24

#: Name, label, bars, and a line for each of those; NaN is no line.
Signals = tuple[str, str | None, np.ndarray, np.ndarray | None]
#: Values, and where they are not null.
Values = tuple[np.ndarray, np.ndarray]


class _Extremes:
    """The extreme from bar a to bar z, of at most `most` bars; NaN is no value."""

    def __init__(self, of: np.ufunc, xs: np.ndarray, most: int) -> None:
        rows = [xs]
        while 1 << len(rows) <= most:
            step, row = 1 << (len(rows) - 1), rows[-1].copy()
            row[:-step] = of(rows[-1][:-step], rows[-1][step:])
            rows.append(row)
        self.of, self.rows = of, np.stack(rows)
        self.power = np.array([0, *(n.bit_length() - 1 for n in range(1, most + 1))])

    def __call__(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        from_ = np.minimum(a, z)
        k = self.power[z - from_ + 1]
        return np.where(a > z, np.nan, self.of(self.rows[k, from_], self.rows[k, z - (1 << k) + 1]))


class _Column:
    """A column along bars. NaN and null are both no value to swings and regimes; to frames NaN is above all numbers, as in SQL."""

    def __init__(self, column: pa.Array, most: int) -> None:
        known = column.is_valid().to_numpy(zero_copy_only=False)
        self.x, self.known = column.fill_null(np.nan).to_numpy(zero_copy_only=False), known
        self.lowest, self.highest = (_Extremes(of, self.x, most) for of in (np.fmin, np.fmax))
        self._values, self._nans = (np.concatenate([[0], np.cumsum(c)]) for c in (known, known & np.isnan(self.x)))

    def at(self, t: np.ndarray) -> Values:
        return self.x[t], self.known[t]

    def least(self, a: np.ndarray, z: np.ndarray) -> Values:
        return self.lowest(a, z), self._values[z + 1] > self._values[a]

    def most(self, a: np.ndarray, z: np.ndarray) -> Values:
        return np.where(self._nans[z + 1] > self._nans[a], np.nan, self.highest(a, z)), self._values[z + 1] > self._values[a]


def _over(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x > y) | (np.isnan(x) & ~np.isnan(y))


def _above(a: Values, b: Values) -> np.ndarray:
    return a[1] & b[1] & _over(a[0], b[0])


def _within(a: Values, b: Values) -> np.ndarray:
    """a <= b."""
    return a[1] & b[1] & ~_over(a[0], b[0])


def _bests(kp: list[float], first: list[bool]) -> list[int]:
    """Up to each candidate, which of its run is the most extreme: the first of equal ones."""
    out, best = [], 0
    for c, (x, new) in enumerate(zip(kp, first, strict=True)):
        if new or x > kp[best]:
            best = c
        out.append(best)
    return out


def _bests_behind(kp: list[float], first: list[bool]) -> list[int]:
    """The same from each candidate on to the end of its run."""
    out, best, ended = [0] * len(kp), 0, True
    for c in range(len(kp) - 1, -1, -1):
        if ended or kp[c] >= kp[best]:
            best = c
        out[c], ended = best, first[c]
    return out


class _Swings:
    """Candidates of all series of a batch in order, a high before a low of one bar: bar i, kind k (1 or -1), price p; and their runs."""

    def __init__(self, high: np.ndarray, low: np.ndarray, place: np.ndarray, reach: int) -> None:
        size, self.place, self.reach = len(place), place, reach
        flags = np.zeros((size, 2), bool)
        if (count := size - 2 * reach) > 0:
            inner, whole = slice(reach, reach + count), place[2 * reach :] >= 2 * reach
            for side, (xs, of, reaches) in enumerate(((high, np.fmax, np.greater_equal), (low, np.fmin, np.less_equal))):
                best = xs[:count].copy()
                for j in range(1, 2 * reach + 1):
                    of(best, xs[j : j + count], out=best)
                flags[inner, side] = whole & reaches(xs[inner], best)
        self.before = np.concatenate([[0], np.cumsum(flags.sum(axis=1))])
        at = np.flatnonzero(flags)
        self.i, self.k = at >> 1, 1 - 2 * (at & 1)
        self.p = np.where(self.k == 1, high[self.i], low[self.i])
        series, first = self.i - place[self.i], np.ones(len(at), bool)
        first[1:] = (self.k[1:] != self.k[:-1]) | (series[1:] != series[:-1])
        self.run = np.cumsum(first) - 1
        kp = (self.k * self.p).tolist()
        self.early, self.late = (np.array(f(kp, first.tolist()), dtype=np.int64) for f in (_bests, _bests_behind))
        self.runs = self.early[np.append(first[1:], True)[: len(at)]]

    def last(self, t: np.ndarray, size: int, last: int) -> _Last:
        """The last swings of the windows of `size` bars that end with bars t, of those that have two at least: one is no pattern."""
        first = t - np.minimum(size - 1, self.place[t])
        start, end = self.before[first + self.reach], self.before[t - self.reach + 1]
        some = np.flatnonzero(end > start)
        t, start, end = t[some], start[some], end[some] - 1
        some = np.flatnonzero(self.run[end] > self.run[start])
        t, start, end = t[some], start[some], end[some]
        a, z = self.run[start], self.run[end]
        # Runs inside the window are whole; only its first may have begun before, and its last may go on.
        found = [self.early[end]]
        for j in range(1, last):
            found.append(np.where(z - j > a, self.runs[np.maximum(z - j, 0)], np.where(z - j == a, self.late[start], -1)))
        return _Last(self, t, np.stack(found))


class _Last:
    """The last swings of some bars' windows: places among the candidates, the newest first, -1 where there are no more. Kinds alternate."""

    def __init__(self, swings: _Swings, t: np.ndarray, found: np.ndarray) -> None:
        self.swings, self.t, self.found = swings, t, found
        self.kind = swings.k[found[0]] if len(t) else t

    def nth(self, m: int, j: int) -> np.ndarray:
        """The j-th newest of kind m."""
        return self.behind(m, 2 * j)

    def behind(self, m: int, j: int) -> np.ndarray:
        """The j-th behind the newest of kind m."""
        return self.found[np.where(self.kind == m, 0, 1) + j, np.arange(len(self.t))]

    def i(self, c: np.ndarray) -> np.ndarray:
        return self.swings.i[c]

    def p(self, c: np.ndarray) -> np.ndarray:
        return self.swings.p[c]

    def narrowed(self, some: np.ndarray) -> _Last:
        return _Last(self.swings, self.t[some], self.found[:, some])


def _slope(i: list[np.ndarray], p: list[np.ndarray], all_: np.ndarray) -> np.ndarray:
    """Of the least squares line of points, the oldest first, which counts only where all_ is true; places count from the first point."""
    start = np.where(all_, i[0], i[1])
    n = np.where(all_, float(len(i)), len(i) - 1.0)
    sx, sy, sxx, sxy = (np.zeros(len(n)) for _ in range(4))
    for j, (at, y) in enumerate(zip(i, p, strict=True)):
        x, y = (at - start).astype(float), y if j else np.where(all_, y, 0.0)
        x = x if j else np.where(all_, x, 0.0)
        sx, sy, sxx, sxy = sx + x, sy + y, sxx + x * x, sxy + x * y
    under = n * sxx - sx * sx
    return np.where(under == 0, np.nan, (n * sxy - sx * sy) / under)


class _Bars:
    """Bars of series that lie one behind the other; signals are told of those from `new` on."""

    def __init__(self, columns: dict[str, pa.Array], place: np.ndarray, new: int, s: Settings) -> None:
        self.place, self.s = place, s
        self.high, self.low, self.close = (_Column(columns[c], max(s.long, s.lookback + 1)) for c in ("high", "low", "close"))
        self.told = np.arange(new, len(place))

    def since(self, place: int) -> np.ndarray:
        """Bars told with at least so many before them."""
        return self.told[self.place[self.told] >= place]

    def _broken(self, name: str, m: int, t: np.ndarray, start: np.ndarray, line: np.ndarray) -> Signals:
        """Where the close of t is beyond the line and none from start on was; a line under highs, m being 1, is broken downwards."""
        beyond = lambda x: m * x < m * line
        earlier = (self.close.lowest if m == 1 else self.close.highest)(start, t - 1)
        fired = beyond(self.close.x[t]) & ~beyond(earlier)
        return name, None, t[fired], line[fired]

    def _double(self, last: _Last, m: int, name: str) -> Signals:
        last = last.narrowed(last.nth(m, 1) >= 0)
        (i, a), (j, b) = ((last.i(c), m * last.p(c)) for c in (last.nth(m, 1), last.nth(m, 0)))
        some = np.flatnonzero((j > i + 1) & (a != 0) & (np.abs(b - a) / np.abs(a) * 100 <= self.s.tolerance_pct))
        i, j = i[some], j[some]
        between = self.low.lowest if m == 1 else self.high.highest
        return self._broken(name, m, last.t[some], j + 1, between(i + 1, j - 1))

    def _shoulders(self, last: _Last, m: int, name: str) -> Signals:
        margin, tolerance = self.s.head_margin_pct / 100, max(self.s.tolerance_pct, 5.0)
        last = last.narrowed(last.nth(m, 2) >= 0)
        (i, left), (j, head), (k, right) = ((last.i(c), m * last.p(c)) for c in (last.nth(m, 2), last.nth(m, 1), last.nth(m, 0)))
        older, newer = last.behind(m, 3), last.behind(m, 1)
        tall = (head > left + np.abs(left) * margin) & (head > right + np.abs(right) * margin)
        even = (left != 0) & (np.abs(right - left) / np.abs(left) * 100 <= tolerance)
        # Of one bar, a low may be at its high's place.
        apart = (last.i(older) > i) & (last.i(older) < j) & (last.i(newer) > j) & (last.i(newer) < k)
        some = np.flatnonzero(tall & even & apart)
        return self._broken(name, m, last.t[some], k[some] + 1, (last.p(older)[some] + last.p(newer)[some]) / 2)

    def _n(self, last: _Last, m: int, name: str) -> Signals:
        last = last.narrowed(last.nth(m, 1) >= 0)
        (i, a), (j, b) = ((last.i(c), m * last.p(c)) for c in (last.nth(m, 1), last.nth(m, 0)))
        low = last.behind(m, 1)
        some = np.flatnonzero((b < a) & (last.i(low) > i) & (last.i(low) < j))
        return self._broken(name, m, last.t[some], j[some] + 1, last.p(low)[some])

    def _wedges(self, last: _Last) -> Iterator[Signals]:
        last = last.narrowed((last.nth(1, 2) >= 0) & (last.nth(-1, 2) >= 0))
        total, count, slopes = np.zeros(len(last.t)), np.zeros(len(last.t)), []
        for m in (1, -1):
            places = [last.nth(m, j) for j in (3, 2, 1, 0)]
            i, p, four = [last.i(c) for c in places], [last.p(c) for c in places], places[0] >= 0
            side = np.where(four, p[0], 0.0)
            for y in p[1:]:
                side = side + y
            total, count = total + side, count + np.where(four, 4, 3)
            slopes.append(_slope(i, p, four))
        level = total / count
        flat = level * self.s.flat_pct / 100
        up, down = (np.where(np.abs(v) <= flat, 0, np.sign(v)) for v in slopes)
        for (a, b), name in WEDGES.items():
            yield name, None, last.t[(level > 0) & (up == a) & (down == b)], None

    def swinging(self, enabled: tuple[str, ...]) -> Iterator[Signals]:
        s = self.s
        swings = _Swings(self.high.x, self.low.x, self.place, s.swing_window)
        need = {what: 2 * s.swing_window + n for what, n in NEED.items()}
        near, far = (swings.last(self.since(max(2 * s.swing_window, 9)), size, last) if size > 2 * s.swing_window else None for size, last in ((s.lookback, NEAR), (s.long, FAR)))
        for what, detect in (("double", self._double), ("shoulders", self._shoulders), ("n", self._n), ("wedge", self._wedges)):
            last, size = (near, s.lookback) if what == "double" else (far, s.long)
            if last is None or size < need[what]:
                continue
            last = last.narrowed(self.place[last.t] + 1 >= need[what])
            if what == "wedge":
                yield from self._wedges(last)
                continue
            for m, name in zip((1, -1), NAMES[what], strict=True):
                if name in enabled:
                    yield detect(last, m, name)

    def regime(self) -> Iterator[Signals]:
        """Regime and nearness to the ends of the range, of windows of 10 bars or more; the first half of a window has half its bars, rounded down."""
        s = self.s
        if s.lookback < 10:
            return
        t = self.since(9)
        size = np.minimum(s.lookback, self.place[t] + 1)
        first, half = t - size + 1, size // 2
        known = ~np.isnan(self.close.x)
        closes, seen = np.where(known, self.close.x, 0.0), np.concatenate([[0], np.cumsum(known)])

        def mean(start: np.ndarray, n: np.ndarray, most: int) -> Values:
            total = np.zeros(len(t))
            for k in range(most):
                total += np.where(k < n, closes[np.minimum(start + k, t)], 0.0)
            count = seen[start + n] - seen[start]
            return total / count, count > 0

        (a, has_a), (b, has_b) = mean(first, half, s.lookback // 2), mean(first + half, size - half, s.lookback - s.lookback // 2)
        change = np.where(has_a & has_b & (a != 0), (b - a) / a * 100, 0.0)
        up, down = _over(change, np.full(len(t), 2 * s.near_pct)), change < -2 * s.near_pct
        for label, which in (("up", up), ("down", down & ~up), ("range", ~(up | down))):
            yield "regime", label, t[which], None
        now, high, low = self.close.x[t], self.close.highest(first, t), self.close.lowest(first, t)
        for name, d, line in (("near_range_high", high - now, high), ("near_range_low", now - low, low)):
            fired = (high - low != 0) & (d / (high - low) * 100 <= s.near_pct)
            yield name, None, t[fired], line[fired]

    def frames(self) -> Iterator[Signals]:
        """The signals of patterns.range_signals."""
        s, close, high, low = self.s, self.close, self.high, self.low
        t = self.since(s.lookback + 1)
        window, now, previous = (t - s.lookback - 1, t - 2), close.at(t), close.at(t - 1)
        top, bottom = close.most(*window), close.least(*window)
        yield "range_breakout", None, t[_above(now, top) & _within(previous, top)], None
        yield "range_breakdown", None, t[_above(bottom, now) & _within(bottom, previous)], None
        t = self.since(s.recover_bars + 4)
        start = t - self.place[t]
        older, recent = (np.maximum(t - s.lookback + 1, start), t - s.recover_bars), (np.maximum(t - s.recover_bars + 1, start), t)
        now, previous, support, resistance = close.at(t), close.at(t - 1), low.least(*older), high.most(*older)
        yield "undercut_reverse", None, t[_above(now, support) & _within(previous, support) & _above(support, low.least(*recent))], None
        yield "false_breakout", None, t[_above(resistance, now) & _within(resistance, previous) & _above(high.most(*recent), resistance)], None
        t, g = self.since(s.max_island_bars + 2), s.gap_pct / 100

        def gap(k: int, up: bool) -> np.ndarray:
            """Whether the bar k bars ago left a gap to the one before it."""
            (h, has_h), (lo, has_lo) = (high.at(t - k - 1), low.at(t - k)) if up else (high.at(t - k), low.at(t - k - 1))
            return _above((lo, has_lo), (h * (1 + g), has_h)) if up else _above((lo * (1 - g), has_lo), (h, has_h))

        risen, fallen = (np.logical_or.reduce([gap(k, up) for k in range(2, s.max_island_bars + 1)] or [np.zeros(len(t), bool)]) for up in (True, False))
        down = gap(0, False) & risen
        yield "island_reversal_down", None, t[down], None
        yield "island_reversal_up", None, t[~down & gap(0, True) & fallen], None

    def signals(self, enabled: tuple[str, ...]) -> Iterator[Signals]:
        if set(enabled) - set(FRAMES) - {"regime", "near_range_high", "near_range_low"}:
            yield from self.swinging(enabled)
        if {"regime", "near_range_high", "near_range_low"} & set(enabled):
            yield from self.regime()
        if set(FRAMES) & set(enabled):
            yield from self.frames()


def _kernels(bars: DataFrame, s: Settings, enabled: tuple[str, ...]) -> DataFrame:
    """symbol, ts, pattern, label, line from one shuffle of bars; ties of ts go by high, low and close."""
    reach = max(s.long - 1, s.lookback + 1, s.recover_bars + 4, s.max_island_bars + 2, 2 * s.swing_window + max(NEED.values()))
    kinds = bars.schema
    schema = StructType([kinds["symbol"], kinds["ts"], StructField("pattern", StringType()), StructField("label", StringType()), StructField("line", DoubleType())])

    def told(rows: pa.RecordBatch, new: int) -> pa.RecordBatch:
        with np.errstate(all="ignore"):  # quotients and windows that are not told
            found = _Bars({c: rows.column(c) for c in ("high", "low", "close")}, placed(rows.column("symbol")), new, s).signals(enabled)
            found = [x for x in found if len(x[2]) and x[0] in enabled]
        at = np.concatenate([np.empty(0, np.int64), *(t for _, _, t, _ in found)])
        lines = np.concatenate([np.empty(0), *(np.full(len(t), np.nan) if line is None else line for _, _, t, line in found)])
        each = np.repeat(np.arange(len(found)), np.array([len(t) for _, _, t, _ in found], dtype=np.int64))
        texts = [pa.array([x[n] for x in found], pa.string()).take(pa.array(each)) for n in (0, 1)]
        own = [rows.column(c).take(pa.array(at)) for c in ("symbol", "ts")]
        return pa.RecordBatch.from_arrays([*own, *texts, pa.array(lines, mask=np.isnan(lines))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield told(rows, rows.num_rows - batch.num_rows)
            held = rows.slice(max(rows.num_rows - reach, 0))

    prices = [F.col(c).cast("double").alias(c) for c in ("high", "low", "close")]
    dealt = bars.select("symbol", "ts", *prices).repartition("symbol").sortWithinPartitions("symbol", "ts", "high", "low", "close")
    return dealt.mapInArrow(run, schema)


def detected(bars: DataFrame, s: Settings = Settings(), enabled: tuple[str, ...] = PATTERNS, made_of: DataFrame | None = None) -> DataFrame:
    """symbol, ts, pattern, label, line of all enabled patterns on every bar: the rows of evaluate.evaluated.

    Series of at most WHOLE bars go through kernels, a series in one task; longer ones are cut into blocks in the JVM. made_of has the symbol of each row that
    bars are made from, so that long series are told without making bars twice.
    """
    unknown = set(enabled) - set(PATTERNS)
    if unknown:
        raise ValueError(f"no such patterns: {', '.join(sorted(unknown))}")
    rows = bars.select("symbol", "ts", "high", "low", "close")
    counts = long_series(rows, "symbol", made_of, WHOLE)
    if counts.isEmpty():
        return _kernels(rows, s, enabled)
    # Null keys are a series, too.
    keyed, keys = rows.withColumn("_key", F.struct("symbol")), counts.select(F.struct("symbol").alias("_key"))
    short, long = (attached(keyed, keys, ["_key"], how).select(*rows.columns) for how in ("left_anti", "left_semi"))
    return _kernels(short, s, enabled).union(evaluated(written(long, "bars"), s, enabled))
