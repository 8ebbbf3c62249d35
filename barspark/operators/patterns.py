"""Chart patterns on the last bar of each series.

What trailing frames express stays in windows; patterns of swings need an ordered pass over the last bars of a symbol, which is bounded
by the lookback. Bearish patterns are defined once, and their bullish mirrors are the same on negated prices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """Defaults of the detectors."""

    lookback: int = 60
    swing_window: int = 3
    tolerance_pct: float = 3.0
    head_margin_pct: float = 1.0
    near_pct: float = 3.0
    recover_bars: int = 5
    gap_pct: float = 0.5
    max_island_bars: int = 5
    flat_pct: float = 0.05

    @property
    def long(self) -> int:
        return max(self.lookback, 90)


def regime(bars: DataFrame, s: Settings = Settings()) -> DataFrame:
    """symbol, regime (up, down or range), range_high, range_low, today_close, near_high, near_low, for series of 10 bars or more."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    last = bars.select("symbol", "ts", "close", F.row_number().over(w).alias("n")).where(F.col("n") <= s.lookback)
    last = last.withColumn("bars", F.count("*").over(Window.partitionBy("symbol"))).where("bars >= 10")
    # The first half, from the oldest, has bars / 2 rounded down.
    early = F.col("n") > F.col("bars") - F.floor(F.col("bars") / 2)
    out = last.groupBy("symbol").agg(
        F.max("close").alias("range_high"), F.min("close").alias("range_low"), F.min_by("close", "n").alias("today_close"),
        F.avg(F.when(early, F.col("close"))).alias("_a"), F.avg(F.when(~early, F.col("close"))).alias("_b"),
    )
    span = F.col("range_high") - F.col("range_low")
    change = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.col("_a")) * 100, F.lit(0.0))
    near = lambda d: F.coalesce(F.try_divide(d, span) * 100 <= s.near_pct, F.lit(False))
    return out.select(
        "symbol",
        F.when(change > 2 * s.near_pct, "up").when(change < -2 * s.near_pct, "down").otherwise("range").alias("regime"),
        "range_high",
        "range_low",
        "today_close",
        near(F.col("range_high") - F.col("today_close")).alias("near_high"),
        near(F.col("today_close") - F.col("range_low")).alias("near_low"),
    )


def range_signals(bars: DataFrame, s: Settings = Settings()) -> DataFrame:
    """symbol, ts and a boolean for each frame pattern on every bar: breakout, breakdown, undercut and false breakout, islands.

    A signal is of the first close beyond its line only. A bar without a full frame has no signal.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    n, r = s.lookback, s.recover_bars
    before = w.rowsBetween(-(n + 1), -2)
    older, recent = w.rowsBetween(-(n - 1), -r), w.rowsBetween(-(r - 1), 0)
    number = F.row_number().over(w)
    previous = F.lag("close").over(w)
    g = s.gap_pct / 100
    rows = bars.select(
        "symbol", "ts", "close", "high", "low", previous.alias("c1"), number.alias("n"),
        F.max("close").over(before).alias("top"), F.min("close").over(before).alias("bottom"),
        F.min("low").over(older).alias("support"), F.max("high").over(older).alias("resistance"),
        F.min("low").over(recent).alias("low_r"), F.max("high").over(recent).alias("high_r"),
        F.lag("high").over(w).alias("h1"), F.lag("low").over(w).alias("l1"),
        *(F.lag(c, k).over(w).alias(f"{c[0]}{k}x") for k in range(2, s.max_island_bars + 2) for c in ("high", "low")),
    )
    c, c1 = F.col("close"), F.col("c1")
    enough, full = F.col("n") >= n + 2, F.col("n") >= r + 5
    gap_up = lambda k: F.col(f"l{k}x") > F.col(f"h{k + 1}x") * (1 + g)
    gap_down = lambda k: F.col(f"h{k}x") < F.col(f"l{k + 1}x") * (1 - g)
    ks = range(2, s.max_island_bars + 1)
    known = lambda p: F.coalesce(p, F.lit(False))
    any_ = lambda f: known(F.exists(F.array(*(known(f(k)) for k in ks)), lambda x: x))
    down_now, up_now = known(F.col("high") < F.col("l1") * (1 - g)), known(F.col("low") > F.col("h1") * (1 + g))
    room = F.col("n") >= s.max_island_bars + 3
    return rows.select(
        "symbol",
        "ts",
        known(enough & (c > F.col("top")) & (c1 <= F.col("top"))).alias("range_breakout"),
        known(enough & (c < F.col("bottom")) & (c1 >= F.col("bottom"))).alias("range_breakdown"),
        known(full & (c > F.col("support")) & (c1 <= F.col("support")) & (F.col("low_r") < F.col("support"))).alias("undercut_reverse"),
        known(full & (c < F.col("resistance")) & (c1 >= F.col("resistance")) & (F.col("high_r") > F.col("resistance"))).alias("false_breakout"),
        (room & down_now & any_(gap_up)).alias("island_reversal_down"),
        (room & ~(down_now & any_(gap_up)) & up_now & any_(gap_down)).alias("island_reversal_up"),
    )


Swing = tuple[int, int, float]  # index, +1 for a high or -1 for a low, price


def swings(high: np.ndarray, low: np.ndarray, reach: int) -> list[Swing]:
    """Alternating highs and lows: extremes of 2 reach + 1 bars; of neighbours of one kind the more extreme stays, the first if equal."""
    found: list[Swing] = []
    for i in range(reach, len(high) - reach):
        part = slice(i - reach, i + reach + 1)
        for sign, price, extreme in ((1, high[i], high[part].max()), (-1, low[i], -(-low[part]).max())):
            if sign * price < sign * extreme:
                continue
            if found and found[-1][1] == sign:
                if sign * price > sign * found[-1][2]:
                    found[-1] = (i, sign, float(price))
            else:
                found.append((i, sign, float(price)))
    return found


def _first_below(closes: np.ndarray, start: int, line: float) -> bool:
    """Whether the last close is under the line and none from start on was."""
    return bool(closes[-1] < line and not (closes[start:-1] < line).any())


def _topping(found: list[Swing], low: np.ndarray, close: np.ndarray, s: Settings) -> float | None:
    """Neckline of two highs of like price."""
    tops = [x for x in found if x[1] > 0][-2:]
    if len(tops) < 2:
        return None
    (i, _, a), (j, _, b) = tops
    if j <= i + 1 or a == 0 or abs(b - a) / abs(a) * 100 > s.tolerance_pct:
        return None
    line = float(low[i + 1 : j].min())
    return line if _first_below(close, j + 1, line) else None


def _head_and_shoulders(found: list[Swing], close: np.ndarray, s: Settings) -> float | None:
    tops = [x for x in found if x[1] > 0][-3:]
    if len(tops) < 3:
        return None
    (i, _, left), (j, _, head), (k, _, right) = tops
    margin = s.head_margin_pct / 100
    if left == 0 or head <= left + abs(left) * margin or head <= right + abs(right) * margin or abs(right - left) / abs(left) * 100 > max(s.tolerance_pct, 5.0):
        return None
    first, second = [x[2] for x in found if x[1] < 0 and i < x[0] < j], [x[2] for x in found if x[1] < 0 and j < x[0] < k]
    if not first or not second:
        return None
    line = (first[-1] + second[0]) / 2
    return line if _first_below(close, k + 1, line) else None


def _n_down(found: list[Swing], close: np.ndarray) -> float | None:
    tops = [x for x in found if x[1] > 0][-2:]
    if len(tops) < 2 or tops[1][2] >= tops[0][2]:
        return None
    between = [x[2] for x in found if x[1] < 0 and tops[0][0] < x[0] < tops[1][0]]
    return between[-1] if between and _first_below(close, tops[1][0] + 1, between[-1]) else None


#: (direction of highs, direction of lows): pattern.
WEDGES = {(-1, 1): "triangle_symmetrical", (0, 1): "triangle_ascending", (-1, 0): "triangle_descending", (1, 1): "wedge_rising", (-1, -1): "wedge_falling"}


def _wedge(found: list[Swing], s: Settings) -> str | None:
    tops, bottoms = [x for x in found if x[1] > 0][-4:], [x for x in found if x[1] < 0][-4:]
    if len(tops) < 3 or len(bottoms) < 3:
        return None
    level = float(np.mean([x[2] for x in tops + bottoms]))
    slopes = [np.polyfit([x[0] for x in part], [x[2] for x in part], 1)[0] for part in (tops, bottoms)]
    flat = level * s.flat_pct / 100
    return WEDGES.get(tuple(0 if abs(v) <= flat else int(np.sign(v)) for v in slopes)) if level > 0 else None


def swing_signals(high: np.ndarray, low: np.ndarray, close: np.ndarray, s: Settings) -> list[tuple[str, float | None]]:
    """(pattern, line) on the last bar."""
    out: list[tuple[str, float | None]] = []
    for size, checks in ((s.lookback, ("double",)), (s.long, ("shoulders", "n", "wedge"))):
        h, low_, c = high[-size:], low[-size:], close[-size:]
        found = swings(h, low_, s.swing_window)
        mirror = [(i, -k, -p) for i, k, p in found]
        sides = ((found, low_, c, False), (mirror, -h, -c, True))
        need = {"double": 3, "shoulders": 5, "n": 3, "wedge": 6}
        for check in checks:
            if len(h) < 2 * s.swing_window + need[check]:
                continue
            if check == "wedge":
                if kind := _wedge(found, s):
                    out.append((kind, None))
                continue
            for swings_, lows, closes, flipped in sides:
                line = _topping(swings_, lows, closes, s) if check == "double" else _head_and_shoulders(swings_, closes, s) if check == "shoulders" else _n_down(swings_, closes)
                if line is not None:
                    name = {"double": ("double_top", "double_bottom"), "shoulders": ("head_shoulders_top", "head_shoulders_bottom"), "n": ("n_down", "n_up")}[check][flipped]
                    out.append((name, -line if flipped else line))
    return out


def patterns(bars: DataFrame, s: Settings = Settings()) -> DataFrame:
    """symbol, ts, pattern, line: swing patterns on the last bar of each symbol; only its last bars leave the JVM."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    last = bars.select("symbol", "ts", "high", "low", "close", F.row_number().over(w).alias("_n")).where(F.col("_n") <= s.long)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        found = swing_signals(*(pdf[c].to_numpy(float) for c in ("high", "low", "close")), s)
        return pd.DataFrame([(pdf["symbol"].iloc[0], pdf["ts"].iloc[-1], name, line) for name, line in found], columns=["symbol", "ts", "pattern", "line"], dtype=object)

    kinds = {f.name: f.dataType.simpleString() for f in bars.schema.fields}
    return last.groupBy("symbol").applyInPandas(run, f"symbol {kinds['symbol']}, ts {kinds['ts']}, pattern string, line double")


def new_signals(signals: DataFrame, sent: DataFrame) -> DataFrame:
    """Signals whose (symbol, pattern, ts) has not been told before."""
    return signals.join(sent.select("symbol", "pattern", "ts"), ["symbol", "pattern", "ts"], "left_anti")
