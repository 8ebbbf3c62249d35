"""The named conditions: boolean predicates of a bar, each with its defaults and the indicator columns it needs.

A condition is compiled for all bars of all symbols at once. What it compares is computed first, in one select for windows and one
grouped pass for recurrences, shared by all conditions of a query; the predicates are a second select. Unknown is false.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from barspark.functions import indicators as I
from barspark.functions.scan import Scan

Params = dict[str, float | int | str]


@dataclass
class Compiled:
    """steps: columns to add, in order of level (0: from bars, 1: from level 0); scans; and the predicate over them."""

    predicate: Callable[[], Column]
    level0: dict[str, Column] = field(default_factory=dict)
    level1: dict[str, Column] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)


@dataclass(frozen=True)
class Condition:
    defaults: Params
    build: Callable[[Params], Compiled]
    #: A flow column that must have data, if the condition is about flow.
    flow: str | None = None


def _cross(a: str, b: str | float, up: bool) -> Callable[[], Column]:
    other = F.lit(float(b)) if not isinstance(b, str) else b
    return lambda: (I.cross_up if up else I.cross_down)(a, other)


def _average(kind: str, n: int) -> tuple[str, dict[str, Column], list[Scan]]:
    kind = str(kind).upper()
    if kind == "EMA":
        scan = Scan("ema", (n,))
        return scan.prefix, {}, [scan]
    name = f"{kind.lower()}_{n}"
    return name, {name: (I.wma if kind == "WMA" else I.sma)("close", n)}, []


def _averages(*of: tuple[str, int]) -> tuple[list[str], dict[str, Column], list[Scan]]:
    names, columns, scans = [], {}, []
    for kind, n in of:
        name, c, s = _average(kind, int(n))
        names.append(name)
        columns |= c
        scans += s
    return names, columns, scans


def _known(make: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: I.true_or_false(make())


def ma_cross(up: bool):
    def build(p: Params) -> Compiled:
        (a, b), columns, scans = _averages(("SMA", p["fast"]), ("SMA", p["slow"]))
        return Compiled(_cross(a, b, up), level1=columns, scans=scans)

    return build


def price_break(high: bool):
    def build(p: Params) -> Compiled:
        n = int(p["n"])
        name = f"{'high' if high else 'low'}_before_{n}"
        column = I.highest_before("high", n) if high else I.lowest_before("low", n)
        return Compiled(_known(lambda: F.col("close") > F.col(name) if high else F.col("close") < F.col(name)), level1={name: column})

    return build


def price_level(above: bool):
    def build(p: Params) -> Compiled:
        v = float(p["value"])
        return Compiled(_known(lambda: F.col("close") > v if above else F.lit(v > 0) & (F.col("close") < v)))

    return build


def _band(p: Params) -> tuple[str, dict[str, Column]]:
    n, k = int(p["n"]), float(p["std"])
    base = f"bb_{n}_{k:g}"
    lines = I.bollinger("close", n, k)
    return base, {f"{base}_{x}": lines[x] for x in ("upper", "middle", "lower")}


def band_cross(upper: bool):
    def build(p: Params) -> Compiled:
        base, columns = _band(p)
        return Compiled(_cross("close", f"{base}_{'upper' if upper else 'lower'}", upper), level1=columns)

    return build


def band_width(squeeze: bool):
    def build(p: Params) -> Compiled:
        base, columns = _band(p)
        width = lambda: F.try_divide(F.col(f"{base}_upper") - F.col(f"{base}_lower"), F.col(f"{base}_middle")) * 100
        v = float(p["value"])
        return Compiled(_known(lambda: width() < v if squeeze else width() > v), level1=columns)

    return build


def _kd(p: Params) -> Scan:
    return Scan("kdj", (int(p["n"]), int(p.get("m1", 3)), int(p.get("m2", 3))))


def kd_cross(up: bool, bounded: bool = False):
    def build(p: Params) -> Compiled:
        s = _kd(p)
        k, d = f"{s.prefix}_k", f"{s.prefix}_d"
        crossed = _cross(k, d, up)
        if not bounded:
            return Compiled(crossed, scans=[s])
        v = float(p["value"])
        return Compiled(lambda: crossed() & I.true_or_false(F.col(k) < v if up else F.col(k) > v), scans=[s])

    return build


def kd_level(above: bool):
    def build(p: Params) -> Compiled:
        s, v = Scan("kdj", (int(p["n"]), 3, 3)), float(p["value"])
        k = f"{s.prefix}_k"
        return Compiled(_known(lambda: F.col(k) > v if above else F.col(k) < v), scans=[s])

    return build


def macd_cross(up: bool, zero: bool = False):
    def build(p: Params) -> Compiled:
        s = Scan("macd", (int(p["f"]), int(p["s"]), int(p["sig"])))
        return Compiled(_cross(f"{s.prefix}_hist", 0.0, up) if zero else _cross(f"{s.prefix}_dif", f"{s.prefix}_signal", up), scans=[s])

    return build


def _rsi(p: Params) -> tuple[str, dict[str, Column], dict[str, Column]]:
    n = int(p["n"])
    return f"rsi_simple_{n}", {"close_delta": I.difference("close")}, {f"rsi_simple_{n}": I.rsi_simple("close", n)}


def rsi_level(above: bool):
    def build(p: Params) -> Compiled:
        name, zero, one = _rsi(p)
        v = float(p["value"])
        return Compiled(_known(lambda: F.col(name) > v if above else F.col(name) < v), zero, one)

    return build


def rsi_cross(up: bool):
    def build(p: Params) -> Compiled:
        name, zero, one = _rsi(p)
        return Compiled(_cross(name, float(p["value"]), up), zero, one)

    return build


def price_cross_ma(up: bool):
    def build(p: Params) -> Compiled:
        (a,), columns, scans = _averages((p["kind"], p["n"]))
        return Compiled(_cross("close", a, up), level1=columns, scans=scans)

    return build


def price_and_ma(above: bool):
    def build(p: Params) -> Compiled:
        (a,), columns, scans = _averages((p["kind"], p["n"]))
        return Compiled(_known(lambda: F.col("close") > F.col(a) if above else F.col("close") < F.col(a)), level1=columns, scans=scans)

    return build


def ma_slope(up: bool):
    def build(p: Params) -> Compiled:
        (a,), columns, scans = _averages((p["kind"], p["n"]))
        look = int(p["look"])
        return Compiled(_known(lambda: F.col(a) > I.lag(a, look) if up else F.col(a) < I.lag(a, look)), level1=columns, scans=scans)

    return build


def ma_align(bull: bool):
    def build(p: Params) -> Compiled:
        (a, b, c), columns, scans = _averages(*((p["kind"], p[x]) for x in ("short", "mid", "long")))
        one = lambda x, y: F.col(x) > F.col(y) if bull else F.col(x) < F.col(y)
        return Compiled(_known(lambda: one(a, b) & one(b, c)), level1=columns, scans=scans)

    return build


def volume_and_ma(above: bool):
    def build(p: Params) -> Compiled:
        n, mult = int(p["n"]), float(p["mult"])
        name = f"volume_sma_{n}"
        columns = {name: I.sma("volume", n), "bar_number": F.row_number().over(I.BARS.rows)}
        mean = lambda: F.col(name)
        # The mean has the current bar, and yet one bar more must be there.
        test = lambda: F.col("volume") > mean() * mult if above else F.col("volume") < mean() * mult
        return Compiled(_known(lambda: (F.col("bar_number") >= n + 1) & (mean() > 0) & test()), level1=columns)

    return build


def consecutive(up: bool):
    def build(p: Params) -> Compiled:
        n = int(p["n"])
        name = f"consecutive_{'up' if up else 'down'}_{n}"
        ok = (F.col("close") > F.col("open") if up else F.col("close") < F.col("open")).cast("int")
        w = I.BARS.last(n)
        return Compiled(_known(lambda: F.col(name) == 1), level1={name: F.when(F.count(F.lit(1)).over(w) == n, F.min(ok).over(w))})

    return build


def pct_change(above: bool):
    def build(p: Params) -> Compiled:
        v = float(p["value"])
        change = lambda: (F.try_divide(F.col("close"), I.lag("close")) - 1) * 100
        return Compiled(_known(lambda: change() >= v if above else change() <= v))

    return build


def always_true(p: Params) -> Compiled:
    return Compiled(lambda: F.lit(True))


def inside_bar(p: Params) -> Compiled:
    return Compiled(_known(lambda: (F.col("high") <= I.lag("high")) & (F.col("low") >= I.lag("low"))))


def gap(up: bool):
    def build(p: Params) -> Compiled:
        v = float(p["value"]) / 100
        edge = "high" if up else "low"
        test = lambda: F.col("open") > I.lag(edge) * (1 + v) if up else F.col("open") < I.lag(edge) * (1 - v)
        return Compiled(_known(lambda: (I.lag(edge) != 0) & test()))

    return build


def streak(column: str, positive: bool):
    def build(p: Params) -> Compiled:
        n = int(p["n"])
        name, w = f"{column}_{'buy' if positive else 'sell'}_{n}", I.BARS.last(n)
        ok = (F.col(column) > 0 if positive else F.col(column) < 0).cast("int")
        return Compiled(_known(lambda: F.col(name) == 1), level1={name: I.full(F.min(ok).over(w), F.col(column), n, w)})

    return build


def run_of_changes(column: str, rising: bool):
    def build(p: Params) -> Compiled:
        n = int(p["n"])
        delta, w = f"{column}_delta", I.BARS.last(n)
        name = f"{column}_{'rising' if rising else 'falling'}_{n}"
        ok = (F.col(delta) > 0 if rising else F.col(delta) < 0).cast("int")
        return Compiled(_known(lambda: F.col(name) == 1), {delta: I.difference(column)}, {name: I.full(F.min(ok).over(w), F.col(delta), n, w)})

    return build


def at_least(column: str, above: bool, unit: float = 1.0):
    def build(p: Params) -> Compiled:
        v = float(p["value"]) * unit
        return Compiled(_known(lambda: F.col(column) >= v if above else F.col(column) <= v))

    return build


def turn(column: str, up: bool):
    def build(p: Params) -> Compiled:
        before = lambda: I.lag(column)
        return Compiled(_known(lambda: (before() <= 0) & (F.col(column) > 0) if up else (before() >= 0) & (F.col(column) < 0)))

    return build


def flow_ratio(p: Params) -> Compiled:
    v = float(p["value"])
    return Compiled(_known(lambda: (F.col("volume") > 0) & (F.try_divide(F.col("foreign_net"), F.col("volume")) * 100 >= v)))


_MA = {"fast": 5, "slow": 20}
_KD = {"n": 9, "m1": 3, "m2": 3}
_MACD = {"f": 12, "s": 26, "sig": 9}
_BB = {"n": 20, "std": 2.0}
_KIND = {"n": 20, "kind": "SMA"}
_ALIGN = {"short": 5, "mid": 20, "long": 60, "kind": "SMA"}

#: Names and defaults are fixed values: stored strategies use them.
CONDITIONS: dict[str, Condition] = {
    "ma_cross_up": Condition(_MA, ma_cross(True)),
    "ma_cross_down": Condition(_MA, ma_cross(False)),
    "price_break_high": Condition({"n": 20}, price_break(True)),
    "price_break_low": Condition({"n": 20}, price_break(False)),
    "price_above": Condition({"value": 0}, price_level(True)),
    "price_below": Condition({"value": 0}, price_level(False)),
    "bb_cross_upper": Condition(_BB, band_cross(True)),
    "bb_cross_lower": Condition(_BB, band_cross(False)),
    "kd_cross_up": Condition(_KD, kd_cross(True)),
    "kd_cross_down": Condition(_KD, kd_cross(False)),
    "kd_above": Condition({"n": 9, "value": 80}, kd_level(True)),
    "kd_below": Condition({"n": 9, "value": 20}, kd_level(False)),
    "macd_cross_up": Condition(_MACD, macd_cross(True)),
    "macd_cross_down": Condition(_MACD, macd_cross(False)),
    "rsi_above": Condition({"n": 14, "value": 70}, rsi_level(True)),
    "rsi_below": Condition({"n": 14, "value": 30}, rsi_level(False)),
    "price_cross_up_ma": Condition(_KIND, price_cross_ma(True)),
    "price_cross_down_ma": Condition(_KIND, price_cross_ma(False)),
    "price_above_ma": Condition(_KIND, price_and_ma(True)),
    "price_below_ma": Condition(_KIND, price_and_ma(False)),
    "ma_slope_up": Condition(_KIND | {"look": 3}, ma_slope(True)),
    "ma_slope_down": Condition(_KIND | {"look": 3}, ma_slope(False)),
    "ma_align_bull": Condition(_ALIGN, ma_align(True)),
    "ma_align_bear": Condition(_ALIGN, ma_align(False)),
    "volume_above_ma": Condition({"n": 20, "mult": 1.5}, volume_and_ma(True)),
    "volume_below_ma": Condition({"n": 20, "mult": 0.7}, volume_and_ma(False)),
    "consecutive_up": Condition({"n": 3}, consecutive(True)),
    "consecutive_down": Condition({"n": 3}, consecutive(False)),
    "pct_change_above": Condition({"value": 3.0}, pct_change(True)),
    "pct_change_below": Condition({"value": -3.0}, pct_change(False)),
    "rsi_cross_up": Condition({"n": 14, "value": 50}, rsi_cross(True)),
    "rsi_cross_down": Condition({"n": 14, "value": 50}, rsi_cross(False)),
    "macd_hist_above_zero": Condition(_MACD, macd_cross(True, zero=True)),
    "macd_hist_below_zero": Condition(_MACD, macd_cross(False, zero=True)),
    "bb_squeeze": Condition(_BB | {"value": 8.0}, band_width(True)),
    "bb_expand": Condition(_BB | {"value": 15.0}, band_width(False)),
    "kd_cross_up_low": Condition(_KD | {"value": 30}, kd_cross(True, bounded=True)),
    "kd_cross_down_high": Condition(_KD | {"value": 70}, kd_cross(False, bounded=True)),
    "always_true": Condition({}, always_true),
    "inside_bar": Condition({}, inside_bar),
    "gap_up": Condition({"value": 0.0}, gap(True)),
    "gap_down": Condition({"value": 0.0}, gap(False)),
    "chip_foreign_buy_streak": Condition({"n": 3}, streak("foreign_net", True), "foreign_net"),
    "chip_foreign_sell_streak": Condition({"n": 3}, streak("foreign_net", False), "foreign_net"),
    "chip_trust_buy_streak": Condition({"n": 3}, streak("trust_net", True), "trust_net"),
    "chip_trust_sell_streak": Condition({"n": 3}, streak("trust_net", False), "trust_net"),
    "chip_inst_buy_over": Condition({"value": 500}, at_least("inst_total", True, 1000), "inst_total"),
    "chip_inst_sell_over": Condition({"value": -500}, at_least("inst_total", False, 1000), "inst_total"),
    "chip_foreign_turn_buy": Condition({}, turn("foreign_net", True), "foreign_net"),
    "chip_foreign_turn_sell": Condition({}, turn("foreign_net", False), "foreign_net"),
    "chip_foreign_vol_ratio": Condition({"value": 10.0}, flow_ratio, "foreign_net"),
    "chip_margin_decrease_streak": Condition({"n": 3}, run_of_changes("margin_balance", False), "margin_balance"),
    "chip_margin_increase_streak": Condition({"n": 3}, run_of_changes("margin_balance", True), "margin_balance"),
    "chip_fut_foreign_oi_above": Condition({"value": 0}, at_least("fut_foreign_oi", True), "fut_foreign_oi"),
    "chip_fut_foreign_oi_below": Condition({"value": 0}, at_least("fut_foreign_oi", False), "fut_foreign_oi"),
    "chip_fut_foreign_turn_long": Condition({}, turn("fut_foreign_oi", True), "fut_foreign_oi"),
    "chip_fut_foreign_turn_short": Condition({}, turn("fut_foreign_oi", False), "fut_foreign_oi"),
}
