"""Recursive indicators and averages by running sums: one grouped pass computes all that a query needs.

A recurrence over the bars of a symbol has no window form. Series of a bounded number of bars go through kernels (functions/series.py). But it is
an affine map, and functions/recurrence.py runs such maps over blocks of bars of longer series inside the JVM. The pandas forms of the same lines serve user code that runs in Python anyway, and tests.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.recurrence import Smoothing, along, as_bars, averaged, before, blocks_of, extreme, long_series, running_sums, trailing
from barspark.functions.series import with_lines
from barspark.sources.scratch import attached


@dataclass(frozen=True)
class Scan:
    """kind: ema, macd, rsi, kdj, dmi, jae, sma or wma; args as the kind has them. Output columns are prefix_<line>."""

    kind: str
    args: tuple[float, ...]
    source: str = "close"

    @property
    def prefix(self) -> str:
        source = "" if self.source == "close" else f"_{self.source}"
        return "_".join([self.kind, *(f"{a:g}" for a in self.args)]) + source

    @property
    def outputs(self) -> list[str]:
        return [f"{self.prefix}_{x}" if x else self.prefix for x in LINES[self.kind]]

    @property
    def inputs(self) -> list[str]:
        return {k: [self.source] for k in ("ema", "macd", "rsi", "sma", "wma")}.get(self.kind, ["high", "low", "close"])


LINES = {
    "ema": [""],
    "sma": [""],
    "wma": [""],
    "macd": ["dif", "signal", "hist"],
    "rsi": [""],
    "kdj": ["rsv", "k", "d", "j"],
    "dmi": ["plus", "minus", "adx"],
    "jae": ["a", "j", "e"],
}


def ewm(x: pd.Series, alpha: float) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False).mean()


def span(x: pd.Series, n: float) -> pd.Series:
    return ewm(x, 2.0 / (n + 1.0))


def wilder_rsi(close: pd.Series, n: int) -> pd.Series:
    """100 where there was no loss but a gain, null where there was neither."""
    delta = close.diff()
    gain, loss = ewm(delta.clip(lower=0), 1.0 / n), ewm(-delta.clip(upper=0), 1.0 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 100 - 100 / (1 + gain / loss)


def kdj(bars: pd.DataFrame, n: int, m1: int, m2: int) -> list[pd.Series]:
    low, high = bars["low"].rolling(n).min(), bars["high"].rolling(n).max()
    width = (high - low).where(high != low)
    rsv = 100 * (bars["close"] - low) / width
    k = ewm(rsv, 1.0 / m1)
    d = ewm(k, 1.0 / m2)
    return [rsv, k, d, 3 * k - 2 * d]


def dmi(bars: pd.DataFrame, n: int) -> list[pd.Series]:
    """Smoothed by an exponential average of span n, not by Wilder's."""
    up, down = bars["high"].diff(), -bars["low"].diff()
    plus = up.where((up > down) & (up > 0), 0.0)
    minus = down.where((down > up) & (down > 0), 0.0)
    before = bars["close"].shift()
    ranges = pd.concat([bars["high"] - bars["low"], (bars["high"] - before).abs(), (bars["low"] - before).abs()], axis=1).max(axis=1)
    atr = span(ranges, n)
    atr = atr.where(atr != 0)
    pdi, mdi = 100 * span(plus, n) / atr, 100 * span(minus, n) / atr
    both = pdi + mdi
    dx = 100 * (pdi - mdi).abs() / both.where(both != 0)
    return [pdi, mdi, span(dx, n)]


def computed(bars: pd.DataFrame, scan: Scan) -> list[pd.Series]:
    a = scan.args
    x = bars[scan.source] if scan.source in bars else bars["close"]
    if scan.kind == "ema":
        return [span(x, a[0])]
    if scan.kind == "sma":
        return [x.rolling(int(a[0])).mean()]
    if scan.kind == "wma":
        n = int(a[0])
        return [x.rolling(n).apply(lambda w: float(np.arange(1, n + 1) @ w) / (n * (n + 1) / 2), raw=True)]
    if scan.kind == "macd":
        dif = span(x, a[0]) - span(x, a[1])
        signal = span(dif, a[2])
        return [dif, signal, dif - signal]
    if scan.kind == "rsi":
        return [wilder_rsi(x, int(a[0]))]
    if scan.kind == "kdj":
        return kdj(bars, int(a[0]), int(a[1]), int(a[2]))
    if scan.kind == "dmi":
        return dmi(bars, int(a[0]))
    if scan.kind == "jae":
        fast = wilder_rsi(bars["close"], int(a[0]))
        return [fast, kdj(bars, int(a[1]), int(a[2]), int(a[3]))[3], span(fast, a[4])]
    raise ValueError(f"unknown recurrence {scan.kind}")


class _Plan:
    """The arrays that scans need, each once: inputs along the bars, then two levels of averages with what stands between them."""

    def __init__(self) -> None:
        self.sums: dict[str, Column] = {}
        self.level0: dict[str, Column] = {}
        self.first: dict[str, tuple[str, float | Smoothing]] = {}
        self.level1: dict[str, Column] = {}
        self.second: dict[str, tuple[str, float | Smoothing]] = {}
        self.level2: dict[str, Column] = {}

    def average(self, xs: str, alpha: float | Smoothing, second: bool = False) -> str:
        told = f"{alpha.m}{'mean' if alpha.mean else 'share'}" if isinstance(alpha, Smoothing) else repr(alpha)
        name = f"_e_{xs}_{told}".replace(".", "p").replace("-", "m")
        (self.second if second else self.first)[name] = (xs, alpha)
        return name

    def source(self, column: str) -> str:
        self.level0[f"_in_{column}"] = along(f"_x_{column}")
        return f"_in_{column}"

    def rsi(self, n: int) -> str:
        xs = "_x_close"
        change = lambda x, i: x - before(xs, i)
        clipped = lambda v: F.when(v.isNotNull(), F.greatest(v, F.lit(0.0)))
        self.level0["_gain"] = along(xs, lambda x, i: clipped(change(x, i)))
        self.level0["_loss"] = along(xs, lambda x, i: clipped(-change(x, i)))
        gain, loss, name = self.average("_gain", 1.0 / n), self.average("_loss", 1.0 / n), f"_rsi_{n}"
        # 100 where there was no loss but a gain, null where there was neither.
        line = lambda g, l: F.when(l == 0, F.when(g > 0, F.lit(100.0))).otherwise(100 - 100 / (1 + g / l))  # noqa: E731, E741
        self.level1[name] = F.zip_with(gain, loss, line)
        return name

    def kdj(self, n: int, m1: int, m2: int) -> tuple[str, str, str]:
        rsv = f"_rsv_{n}"

        def line(x: Column, i: Column) -> Column:
            low, high = extreme("_x_low", i, n, F.array_min), extreme("_x_high", i, n, F.array_max)
            return F.when(high != low, 100 * (x - low) / (high - low))

        self.level0[rsv] = along("_x_close", line)
        # The forms of the SQL, to the last bit: k and d often touch, and a cross or a threshold hangs on it.
        k = self.average(rsv, Smoothing(m1, mean=True))
        return rsv, k, self.average(k, Smoothing(m2), second=True)

    def dmi(self, n: int) -> tuple[str, str, str]:
        up = lambda i: F.get("_x_high", i) - before("_x_high", i)
        down = lambda i: before("_x_low", i) - F.get("_x_low", i)
        move = lambda a, b: F.coalesce(F.when((a > b) & (a > 0), a), F.lit(0.0))
        self.level0["_plus"] = along("_x_high", lambda x, i: move(up(i), down(i)))
        self.level0["_minus"] = along("_x_high", lambda x, i: move(down(i), up(i)))
        close = lambda i: before("_x_close", i)
        self.level0["_range"] = along("_x_high", lambda x, i: F.greatest(x - F.get("_x_low", i), F.abs(x - close(i)), F.abs(F.get("_x_low", i) - close(i))))
        atr, plus, minus = (self.average(x, 2.0 / (n + 1)) for x in ("_range", "_plus", "_minus"))
        share = lambda v, a: F.when(a != 0, 100 * v / a)
        self.level1[f"_pdi_{n}"], self.level1[f"_mdi_{n}"] = F.zip_with(plus, atr, share), F.zip_with(minus, atr, share)
        dx = lambda r, p, m: F.when(p + m != 0, 100 * F.abs(p - m) / (p + m))
        part = lambda v, i: F.when(F.get(atr, i) != 0, 100 * v / F.get(atr, i))
        self.level1[f"_dx_{n}"] = F.transform(plus, lambda v, i: dx(None, part(v, i), part(F.get(minus, i), i)))
        return f"_pdi_{n}", f"_mdi_{n}", self.average(f"_dx_{n}", 2.0 / (n + 1), second=True)

    def lines(self, scan: Scan, columns: list[str]) -> list[str]:
        """The array columns of a scan's outputs."""
        a, minus = scan.args, lambda x, y: x - y
        j = lambda k, d: 3 * k - 2 * d
        source = scan.source if scan.source in columns else "close"
        if scan.kind == "ema":
            return [self.average(self.source(source), 2.0 / (a[0] + 1))]
        if scan.kind in ("sma", "wma"):
            sums, name = f"_sums_{source}", f"_{scan.kind}_{int(a[0])}_{source}"
            self.sums[sums] = running_sums(f"_x_{source}")
            self.level0[name] = trailing(f"_x_{source}", sums, int(a[0]), scan.kind == "wma")
            return [name]
        if scan.kind == "macd":
            fast, slow = (self.average(self.source(source), 2.0 / (n + 1)) for n in a[:2])
            dif, hist = f"_dif_{scan.prefix}", f"_hist_{scan.prefix}"
            self.level1[dif] = F.zip_with(fast, slow, minus)
            signal = self.average(dif, 2.0 / (a[2] + 1), second=True)
            self.level2[hist] = F.zip_with(dif, signal, minus)
            return [dif, signal, hist]
        if scan.kind == "rsi":
            return [self.rsi(int(a[0]))]
        if scan.kind == "kdj":
            rsv, k, d = self.kdj(*map(int, a[:3]))
            self.level2[f"_j_{scan.prefix}"] = F.zip_with(k, d, j)
            return [rsv, k, d, f"_j_{scan.prefix}"]
        if scan.kind == "dmi":
            return list(self.dmi(int(a[0])))
        if scan.kind == "jae":
            fast = self.rsi(int(a[0]))
            _, k, d = self.kdj(*map(int, a[1:4]))
            self.level2[f"_j_{scan.prefix}"] = F.zip_with(k, d, j)
            return [fast, f"_j_{scan.prefix}", self.average(fast, 2.0 / (a[4] + 1), second=True)]
        raise ValueError(f"unknown recurrence {scan.kind}")


#: Kinds that are averages of one column. Where a query has no others, they stay in the JVM.
AVERAGES = ("ema", "macd", "sma", "wma")


def with_scans(bars: DataFrame, scans: Iterable[Scan], key: str = "symbol", ts: str = "ts", made_of: DataFrame | None = None) -> DataFrame:
    """bars with the output columns of all scans, from one shuffle; a scan that repeats is computed once.

    Series of at most BLOCK bars go through kernels, a series in one task (functions/series.py); longer ones, and averages alone, are cut into
    blocks in the JVM (functions/recurrence.py). Missing values are null, never NaN, so that comparisons stay unknown. made_of, if it is at hand,
    has the key of each row that bars are made from, so that short series are told without making bars twice.
    """
    scans = list(dict.fromkeys(scans))
    if not scans:
        return bars
    counts = long_series(bars, key, made_of)
    if all(s.kind in AVERAGES for s in scans):
        return _in_blocks(bars, scans, key, ts, counts)
    inputs = _inputs(bars, scans)
    if counts.isEmpty():
        return with_lines(bars, scans, inputs, key, ts)
    # Null keys are a series, too.
    keyed, keys = bars.withColumn("_key", F.struct(key)), counts.select(F.struct(key).alias("_key"))
    short, long = (attached(keyed, keys, ["_key"], how).select(*(f"`{c}`" for c in bars.columns)) for how in ("left_anti", "left_semi"))
    return with_lines(short, scans, inputs, key, ts).union(_in_blocks(long, scans, key, ts, counts))


def _inputs(bars: DataFrame, scans: Iterable[Scan]) -> list[str]:
    return sorted({c if c in bars.columns else "close" for s in scans for c in s.inputs})


def _in_blocks(bars: DataFrame, scans: list[Scan], key: str, ts: str, counts: DataFrame | None = None) -> DataFrame:
    plan = _Plan()
    outputs = {o: line for s in scans for o, line in zip(s.outputs, plan.lines(s, bars.columns), strict=True)}
    # sums of n values are differences of running sums, so they look n bars back.
    reach = {"kdj": (0, 1), "jae": (1, 1), "sma": (0, 0), "wma": (0, 0)}
    halo = max([1, *(int(s.args[reach[s.kind][0]]) - reach[s.kind][1] for s in scans if s.kind in reach)])
    blocks = blocks_of(bars, key, ts, _inputs(bars, scans), halo, counts)
    for arrays in (plan.sums, plan.level0):
        blocks = blocks.let(**arrays) if arrays else blocks
    if plan.first:
        blocks = averaged(blocks, plan.first).let(**plan.level1)
    if plan.second:
        blocks = averaged(blocks, plan.second).let(**plan.level2)
    return as_bars(blocks, outputs)
