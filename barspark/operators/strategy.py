"""Replay of strategies over bars: conditions become columns for all bars at once, and one fold a symbol keeps the position.

A decision is made on closed bars and filled at the next bar's open. The fold sees only times, prices and two flags, so it is linear
in the bars of a symbol, where symbols and runs are spread over tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import CONTRACT_UNITS, SHARE_LOT, Costs
from barspark.plans.compiler import Spec, combined, with_conditions


@dataclass(frozen=True)
class Strategy:
    """What to trade and when. Percent and absolute stops of 0 are off; minutes of the day bound entries and exits."""

    entry: tuple[Spec, ...]
    exit: tuple[Spec, ...] = ()
    direction: str = "long"
    quantity: int = 1
    kind: str = "share"  # share, odd or future
    product: str = ""
    stop_pct: float = 0.0
    stop_abs: float = 0.0
    take_pct: float = 0.0
    take_abs: float = 0.0
    intrabar: bool | None = None  # None: futures only
    native_stop_order: bool = False
    hold: str | None = None  # single, accumulate or dca: buy and never sell
    dca_amount: float = 0.0
    dca_interval: str = "month"
    entry_minutes: tuple[int | None, int | None] = (None, None)
    exit_minutes: tuple[int | None, int | None] = (None, None)
    entry_at: int | None = None
    slippage_ticks: float = 0.0
    tick: float | None = None
    costs: Costs | None = field(default_factory=Costs)
    settle: bool = True

    @property
    def unit(self) -> float:
        if self.kind == "future":
            return CONTRACT_UNITS.get(self.product.upper()[:3], 1)
        return SHARE_LOT if self.kind == "share" else 1

    def problems(self) -> list[str]:
        out = []
        if not self.entry:
            out.append("no entry condition")
        if self.direction not in ("long", "short"):
            out.append("direction is long or short")
        if self.quantity < 1:
            out.append("quantity is at least 1")
        if self.direction == "short" and self.kind != "future":
            out.append("only futures are sold short")
        if self.hold and (self.exit or self.stop_pct or self.stop_abs or self.take_pct or self.take_abs):
            out.append("what is held is never sold")
        if self.hold == "dca" and self.dca_amount <= 0:
            out.append("an amount to invest is missing")
        if not self.hold and not (self.exit or self.stop_pct or self.stop_abs or self.take_pct or self.take_abs):
            out.append("no way to exit")
        return out


def side_cost(s: Strategy, fund: bool, price: float, quantity: float, sells: bool) -> tuple[float, float]:
    c, quantity = s.costs, int(quantity)
    amount = abs(price) * quantity * s.unit
    if c is None:
        return 0.0, 0.0
    if s.kind == "future":
        return c.lot_fee * quantity, amount * c.future_tax
    fee = max(amount * c.share_fee * c.discount, c.odd_least if s.kind == "odd" else c.share_least) if amount > 0 else 0.0
    return fee, amount * (c.fund_tax if fund else c.share_tax) if sells else 0.0


def touched(s: Strategy, long: bool, entry: float, o: float, h: float, low: float) -> tuple[float, str] | None:
    """Price and reason if the bar's range meets a stop or a take; a stop wins, and a gap fills at the open."""
    m = 1.0 if long else -1.0
    stops = [entry - m * x for x in (entry * s.stop_pct / 100, s.stop_abs) if x > 0]
    takes = [entry + m * x for x in (entry * s.take_pct / 100, s.take_abs) if x > 0]
    if long:
        if stops and low <= max(stops):
            return min(o, max(stops)), "stop"
        if takes and h >= min(takes):
            return max(o, min(takes)), "take"
    else:
        if stops and h >= min(stops):
            return max(o, min(stops)), "stop"
        if takes and low <= max(takes):
            return min(o, max(takes)), "take"
    return None


def stopped(s: Strategy, long: bool, entry: float, close: float) -> str | None:
    """Whether a close beyond a stop or take ends the position, and by which."""
    if entry <= 0:
        return None
    m = 1.0 if long else -1.0
    pct, move = (close - entry) / entry * 100 * m, (close - entry) * m
    tests = [("stop_pct", s.stop_pct > 0 and pct <= -s.stop_pct), ("stop_abs", s.stop_abs > 0 and move <= -s.stop_abs), ("take_pct", s.take_pct > 0 and pct >= s.take_pct), ("take_abs", s.take_abs > 0 and move >= s.take_abs)]
    if s.native_stop_order:
        tests = [tests[0], tests[2], tests[1], tests[3]]
    return next((name for name, hit in tests if hit), None)


def _inside(minute: int, window: tuple[int | None, int | None]) -> bool:
    start, end = window
    if start is None and end is None:
        return True
    start, end = 0 if start is None else start, 1439 if end is None else end
    return start <= minute <= end if start <= end else minute >= start or minute <= end


def _period(ts: pd.Timestamp, interval: str):
    ts = pd.Timestamp(ts)
    return {"bar": ts, "week": tuple(ts.isocalendar())[:2], "month": (ts.year, ts.month), "quarter": (ts.year, ts.quarter)}[interval]


EVENT = ["event", "i", "ts", "entry_ts", "entry_price", "exit_price", "direction", "quantity", "gross", "fee", "tax", "pnl", "pnl_pct", "bars_held", "reason", "equity"]
EVENT_SCHEMA = (
    "event string, i long, ts {ts}, entry_ts {ts}, entry_price double, exit_price double, direction string, quantity long, gross double, fee double, tax double, "
    "pnl double, pnl_pct double, bars_held long, reason string, equity double"
)


_EVENT_DOUBLES = {"entry_price", "exit_price", "gross", "fee", "tax", "pnl", "pnl_pct", "equity"}
_EVENT_LONGS = {"i", "quantity", "bars_held"}


def event_frame(events: list[tuple], symbol: object) -> pd.DataFrame:
    """Events as a frame of typed columns, which Arrow takes whole; columns of objects are converted value by value."""
    lines = dict(zip(EVENT, zip(*events, strict=True), strict=True)) if events else {c: () for c in EVENT}
    out: dict[str, object] = {"symbol": pd.Series([symbol] * len(events), dtype=object)}
    for c, x in lines.items():
        if c in _EVENT_DOUBLES or c in _EVENT_LONGS:
            numbers = np.array(x, dtype=float)
            out[c] = numbers if c in _EVENT_DOUBLES else pd.Series(numbers).astype("Int64")
        else:
            out[c] = pd.Series(list(x), dtype=object)
    return pd.DataFrame(out)


def moves_frame(moved: list[tuple], ts: list, curve: np.ndarray, symbol: object) -> pd.DataFrame:
    """The same columns of what moves() gives, the equity as an array."""
    k, n = len(moved), len(curve)
    lines = zip(*moved, strict=True) if moved else ((),) * len(EVENT)
    out: dict[str, object] = {"symbol": pd.Series([symbol] * (k + n), dtype=object)}
    for c, x in zip(EVENT, lines, strict=True):
        if c in _EVENT_DOUBLES:
            out[c] = np.concatenate([np.array(x, float), curve if c == "equity" else np.full(n, np.nan)])
        elif c in _EVENT_LONGS:
            numbers = np.concatenate([np.array(x, float), np.arange(2.0, n + 2) if c == "i" else np.full(n, np.nan)])
            none = np.isnan(numbers)
            out[c] = pd.arrays.IntegerArray(np.where(none, 0, numbers).astype("int64"), none)
        else:
            values = np.empty(k + n, object)
            values[:k] = x
            values[k:] = {"event": "equity"}.get(c)
            if c == "ts":
                values[k:] = ts[2:]
            out[c] = pd.Series(values, dtype=object)
    return pd.DataFrame(out)


def is_fund_code(symbol: object) -> bool:
    return str(symbol).startswith("00") and len(str(symbol)) >= 4


class _Book:
    """The events of one replay: fills, closed trades and the equity of each bar."""

    def __init__(self, s: Strategy, ts: list, fund: bool):
        self.s, self.ts, self.fund, self.events, self.realized = s, ts, fund, [], 0.0
        self.step = (s.tick or 1.0) * s.slippage_ticks

    def fill(self, i: int, price: float, long: bool, opens: bool, quantity: int) -> float:
        buys = long == opens
        at = price + (self.step if buys else -self.step)
        self.events.append(("fill", i, self.ts[i], None, at, None, "buy" if buys else "sell", quantity, None, None, None, None, None, None, "open" if opens else "close", None))
        return at

    def close(self, i: int, since: int, entry: float, fill: float, quantity: int, long: bool, reason: str) -> None:
        s, unit = self.s, self.s.unit
        gross = (fill - entry) * (1.0 if long else -1.0) * quantity * unit
        fees = [side_cost(s, self.fund, entry, quantity, not long), side_cost(s, self.fund, fill, quantity, long)]
        fee, tax = fees[0][0] + fees[1][0], fees[0][1] + fees[1][1]
        pnl, base = gross - fee - tax, abs(entry) * quantity * unit
        self.realized += pnl
        self.events.append(("trade", i, self.ts[i], self.ts[since], entry, fill, "long" if long else "short", quantity, gross, fee, tax, pnl, pnl / base * 100 if base else 0.0, i - since, reason, None))

    def mark(self, i: int, floating: float) -> None:
        self.events.append(("equity", i, self.ts[i], *[None] * 12, self.realized + floating))

    def settled(self) -> list[tuple]:
        """The events, with all profit realised in the last bar's equity."""
        k = max(k for k, e in enumerate(self.events) if e[0] == "equity")
        self.events[k] = (*self.events[k][:-1], self.realized)
        return self.events


def replay(bars: pd.DataFrame, s: Strategy, fund: bool = False) -> list[tuple]:
    """Events of a strategy over one symbol's bars in order: trade (closed), equity (a bar) and fill (opened or closed).

    bars has ts, open, high, low, close, _entry and _exit, and exec_open and exec_close if another series is traded.
    """
    n = len(bars)
    if n < 3:
        return []
    ts, enter, leave = bars["ts"].tolist(), bars["_entry"].to_numpy(bool), bars["_exit"].to_numpy(bool)
    prices = prices_of(bars)
    if s.hold:
        return _bought(ts, prices, enter, s, fund)
    moved, curve = moves(ts, prices, enter, leave, s, fund)
    marks = [("equity", i, t, *[None] * 12, x) for i, t, x in zip(range(2, n), ts[2:], curve.tolist(), strict=True)]
    out, told = [], 0
    for e in moved:
        # A bar's equity comes behind its fills, but before what is settled in the end.
        upto = n - 2 if e[14] == "settled" else e[1] - 2
        out += marks[told:upto]
        told = max(told, upto)
        out.append(e)
    return out + marks[told:]


def prices_of(bars: pd.DataFrame) -> dict[str, np.ndarray]:
    """open, high, low and close, which decide, and exec_open and exec_close, which are paid."""
    out = {x: bars[x].to_numpy(float) for x in ("open", "high", "low", "close")}
    paid = {f"exec_{x}": bars[f"exec_{x}"].to_numpy(float) if "exec_open" in bars else out[x] for x in ("open", "close")}
    return out | paid | ({"elsewhere": np.ones(1)} if "exec_open" in bars else {})


def _minutes(ts: list, s: Strategy) -> list[int] | None:
    """The minute of the day of each bar, if the strategy asks for it."""
    if not hasattr(ts[0], "hour") or (s.entry_minutes == (None, None) and s.exit_minutes == (None, None) and s.entry_at is None):
        return None
    return [t.hour * 60 + t.minute for t in ts]


def _may_enter(s: Strategy, minute: list[int] | None, d: int) -> bool:
    return minute is None or (minute[d] == s.entry_at if s.entry_at is not None else _inside(minute[d], s.entry_minutes))


def moves(ts: list, prices: dict[str, np.ndarray], enter: np.ndarray, leave: np.ndarray, s: Strategy, fund: bool = False) -> tuple[list[tuple], np.ndarray]:
    """Fills and closed trades of a strategy that sells what it buys, and the equity from the third bar on.

    It goes from entry to exit: bars are looked at one by one only where a stop or a take may end a position.
    """
    n = len(ts)
    if n < 3:
        return [], np.zeros(0)
    o, h, low, c, eo, ec = (prices[x] for x in ("open", "high", "low", "close", "exec_open", "exec_close"))
    minute, intrabar = _minutes(ts, s), s.kind == "future" if s.intrabar is None else s.intrabar
    long, m = s.direction == "long", 1.0 if s.direction == "long" else -1.0
    watched = s.stop_pct > 0 or s.stop_abs > 0 or s.take_pct > 0 or s.take_abs > 0
    book, curve, at = _Book(s, ts, fund), np.zeros(n), 2
    # The last closed bar decides, the third at the earliest, and the one behind it is traded.
    entries = [d for d in np.flatnonzero(enter[: n - 1]).tolist() if d >= 2 and _may_enter(s, minute, d)]
    exits = [d for d in np.flatnonzero(leave[: n - 1]).tolist() if minute is None or _inside(minute[d], s.exit_minutes)]
    leaves, k = set(exits) if watched else set(), 0
    while (e := bisect_left(entries, at if at > 2 else 2)) < len(entries):
        start = entries[e] + 1
        signal, fill = float(o[start]), book.fill(start, eo[start], long, True, s.quantity)
        end, price, reason = n, None, ""
        if not watched:
            k = bisect_left(exits, start, k)
            if k < len(exits):
                end, reason = exits[k] + 1, "signal"
        else:
            for d in range(start, n - 1):
                reason = stopped(s, long, signal, c[d]) or ("signal" if d in leaves else "")
                hit = touched(s, long, signal, o[d + 1], h[d + 1], low[d + 1]) if intrabar and not reason else None
                if hit:
                    reason, price = f"touch_{hit[1]}", None if "elsewhere" in prices else hit[0]
                if reason:
                    end = d + 1
                    break
        curve[at:start] = book.realized
        curve[start:end] = book.realized + (ec[start:end] - fill) * m * s.quantity * s.unit
        at = end
        if end == n:
            if s.settle:
                book.close(n - 1, start, fill, ec[n - 1], s.quantity, long, "settled")
                curve[-1] = book.realized
            break
        book.close(end, start, fill, book.fill(end, eo[end] if price is None else price, long, False, s.quantity), s.quantity, long, reason)
    curve[at:] = book.realized
    return book.events, curve[2:]


def _bought(ts: list, prices: dict[str, np.ndarray], enter: np.ndarray, s: Strategy, fund: bool) -> list[tuple]:
    """Events of a strategy that buys and never sells."""
    n, c, eo, ec = len(ts), prices["close"], prices["exec_open"], prices["exec_close"]
    minute, long, unit, m = _minutes(ts, s), s.direction == "long", s.unit, 1.0 if s.direction == "long" else -1.0
    book = _Book(s, ts, fund)
    lots: list[tuple[int, float, int]] = []
    held, paid, carry, period = 0, 0.0, 0.0, None
    for i in range(2, n):
        d = i - 1  # the last closed bar; three are needed to decide
        opens, quantity = False, s.quantity
        if d >= 2:
            key = _period(ts[d], s.dca_interval) if s.hold == "dca" else None
            due = not (s.hold == "single" and lots) and not (s.hold == "dca" and key == period)
            if due and enter[d]:
                if s.hold == "dca":
                    budget, each = carry + s.dca_amount, c[d] * unit
                    if each > 0 and s.dca_amount > 0:
                        quantity = int(budget // each)
                        carry, period = budget - quantity * each, key
                        opens = quantity > 0
                else:
                    opens = True
            opens = opens and _may_enter(s, minute, d)
        if opens:
            fill = book.fill(i, eo[i], long, True, quantity)
            lots.append((i, fill, quantity))
            held, paid = held + quantity, paid + fill * quantity
        # What is held is worth its quantity less what was paid, however many lots it came in.
        book.mark(i, (ec[i] * held - paid) * m * unit)
    if s.settle and lots:
        for at, entry, quantity in lots:
            book.close(n - 1, at, entry, ec[n - 1], quantity, long, "settled")
        return book.settled()
    return book.events


def signals(bars: DataFrame, s: Strategy) -> DataFrame:
    """Bars with _entry (all entry conditions) and _exit (any exit condition)."""
    named = {f"_in{k}": spec for k, spec in enumerate(s.entry)} | {f"_out{k}": spec for k, spec in enumerate(s.exit)}
    keep = [c for c in ("symbol", "ts", "open", "high", "low", "close", "exec_open", "exec_close") if c in bars.columns]
    rows = with_conditions(bars, named, keep)
    return rows.select(*keep, combined([f"_in{k}" for k in range(len(s.entry))], "AND").alias("_entry"), combined([f"_out{k}" for k in range(len(s.exit))], "OR").alias("_exit"))


def backtest(bars: DataFrame, s: Strategy) -> DataFrame:
    """symbol and the events of the strategy on every symbol of bars."""
    rows = signals(bars, s)
    kind = rows.schema["ts"].dataType.simpleString()
    schema = f"symbol {rows.schema['symbol'].dataType.simpleString()}, " + EVENT_SCHEMA.format(ts=kind)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        symbol = pdf["symbol"].iloc[0]
        if s.hold:
            return event_frame(replay(pdf, s, is_fund_code(symbol)), symbol)
        ts, enter, leave = pdf["ts"].tolist(), pdf["_entry"].to_numpy(bool), pdf["_exit"].to_numpy(bool)
        moved, curve = moves(ts, prices_of(pdf), enter, leave, s, is_fund_code(symbol))
        return moves_frame(moved, ts if len(curve) else [], curve, symbol)

    return rows.groupBy("symbol").applyInPandas(run, schema)


def trades(events: DataFrame) -> DataFrame:
    return events.where("event = 'trade'").select("symbol", F.col("entry_ts"), "entry_price", F.col("ts").alias("exit_ts"), "exit_price", "direction", "quantity", "gross", "fee", "tax", "pnl", "pnl_pct", "bars_held", F.col("reason").alias("exit_reason"))


def equity(events: DataFrame) -> DataFrame:
    return events.where("event = 'equity'").select("symbol", "i", "ts", "equity")


def fills(events: DataFrame) -> DataFrame:
    return events.where("event = 'fill'").select("symbol", "i", "ts", F.col("entry_price").alias("price"), F.col("direction").alias("action"), "quantity", F.col("reason").alias("opens_or_closes"))


# ---------------------------------------------------------------- user code


def _passed_on(name: str):
    def call(self, *args):
        return getattr(self._line_series(), name)(*(x._line_series() if type(x) is Line else x for x in args))

    return call


class Line:
    """The first n values of a series. It is that Series in every use, but is cut only when used as one: most bars look at two values."""

    __slots__ = ("_line_whole", "_line_values", "_line_n", "_line_cut")

    def __init__(self, whole: pd.Series, values: list, n: int):
        self._line_whole, self._line_values, self._line_n, self._line_cut = whole, values, n, None

    __class__ = property(lambda self: pd.Series)

    def _line_series(self) -> pd.Series:
        if self._line_cut is None:
            self._line_cut = self._line_whole.iloc[: self._line_n]
        return self._line_cut

    def last_two(self) -> tuple | None:
        return (self._line_values[self._line_n - 2], self._line_values[self._line_n - 1]) if self._line_n > 1 else None

    def __getattr__(self, name: str):
        return getattr(self._line_series(), name)

    def __len__(self) -> int:
        return self._line_n

    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        return getattr(ufunc, method)(*(x._line_series() if type(x) is Line else x for x in inputs), **kwargs)

    __hash__ = None


for _name in (
    *(f"__{r}{x}__" for x in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor", "divmod", "matmul") for r in ("", "r")),
    *(f"__{x}__" for x in ("lt", "le", "gt", "ge", "eq", "ne", "neg", "pos", "abs", "invert", "round", "getitem", "setitem", "delitem", "iter", "contains", "array", "float", "int", "bool", "repr", "str", "copy", "deepcopy", "reduce_ex")),
):
    if hasattr(pd.Series, _name) or _name == "__bool__":
        setattr(Line, _name, _passed_on(_name))


class Context:
    """What a user's on_bar(ctx) sees: the bars so far, indicators, parameters, its own state and the position."""

    def __init__(self, bars: pd.DataFrame, params: dict, state: dict):
        self._bars, self._params, self.state = bars, params, state
        self._cache: dict[tuple, tuple[pd.Series, list]] = {}
        self._lines: dict[tuple, list[pd.Series]] = {}
        self.i, self.position, self.entry_price, self.bars_in_position = 0, "flat", 0.0, 0
        self.reads: dict[str, object] = {}
        self.lines: list[str] = []

    def _series(self, *key, make=None) -> pd.Series:
        if key not in self._cache:
            whole = make()
            self._cache[key] = whole, whole.tolist()
        return Line(*self._cache[key], self.i + 1)

    def _column(self, name: str) -> pd.Series:
        return self._series("column", name, make=lambda: self._bars[name])

    open = property(lambda self: self._column("open"))
    high = property(lambda self: self._column("high"))
    low = property(lambda self: self._column("low"))
    close = property(lambda self: self._column("close"))
    volume = property(lambda self: self._column("volume"))
    time = property(lambda self: self._bars["ts"].iloc[self.i])

    def sma(self, n: int) -> pd.Series:
        return self._series("sma", n, make=lambda: self._bars["close"].rolling(n).mean())

    def ema(self, n: int) -> pd.Series:
        return self._series("ema", n, make=lambda: self._bars["close"].ewm(span=n, adjust=False).mean())

    def rsi(self, n: int = 14) -> pd.Series:
        def make() -> pd.Series:
            d = self._bars["close"].diff()
            gain, loss = d.clip(lower=0).rolling(n).mean(), (-d.clip(upper=0)).rolling(n).mean()
            return 100 - 100 / (1 + gain / loss.where(loss != 0))

        return self._series("rsi", n, make=make)

    def kd(self, n: int = 9, m1: int = 3, m2: int = 3) -> tuple[pd.Series, pd.Series]:
        return self._line("kdj", 1, n, m1, m2), self._line("kdj", 2, n, m1, m2)

    def macd(self, f: int = 12, s: int = 26, sig: int = 9) -> tuple[pd.Series, pd.Series, pd.Series]:
        return tuple(self._line("macd", k, f, s, sig) for k in range(3))

    def _line(self, kind: str, k: int, *args: int) -> pd.Series:
        """A line of a recurrence, computed once for all bars: none of its values hangs on a later bar."""
        from barspark.functions.scan import Scan, computed

        if (kind, *args) not in self._lines:
            self._lines[kind, *args] = computed(self._bars, Scan(kind, args))
        return self._series("line", kind, k, *args, make=lambda: self._lines[kind, *args][k])

    def bb(self, n: int = 20, k: float = 2.0) -> tuple[pd.Series, pd.Series, pd.Series]:
        mid, sd = self.sma(n), self.stddev(n)
        return mid + sd * k, mid, mid - sd * k

    def highest(self, n: int) -> pd.Series:
        return self._series("highest", n, make=lambda: self._bars["high"].rolling(n).max())

    def lowest(self, n: int) -> pd.Series:
        return self._series("lowest", n, make=lambda: self._bars["low"].rolling(n).min())

    def atr(self, n: int = 14) -> pd.Series:
        def make() -> pd.Series:
            b, before = self._bars, self._bars["close"].shift()
            return pd.concat([b["high"] - b["low"], (b["high"] - before).abs(), (b["low"] - before).abs()], axis=1).max(axis=1).rolling(n).mean()

        return self._series("atr", n, make=make)

    def roc(self, n: int = 10) -> pd.Series:
        return self._series("roc", n, make=lambda: self._bars["close"].pct_change(n) * 100)

    def stddev(self, n: int = 20) -> pd.Series:
        return self._series("stddev", n, make=lambda: self._bars["close"].rolling(n).std())

    def vwap(self) -> pd.Series:
        def make() -> pd.Series:
            v = self._bars["volume"].replace(0, 1)
            return ((self._bars["high"] + self._bars["low"] + self._bars["close"]) / 3 * v).cumsum() / v.cumsum()

        return self._series("vwap", make=make)

    @staticmethod
    def _last_two(a: pd.Series | float):
        """The last two values, read from the array, as a bar costs little then; None if there are fewer."""
        if type(a) is Line:
            return a.last_two()
        if not isinstance(a, pd.Series):
            return a, a
        return a.to_numpy()[-2:] if len(a) > 1 else None

    @staticmethod
    def cross_up(a: pd.Series, b: pd.Series | float) -> bool:
        a, b = Context._last_two(a), Context._last_two(b)
        return a is not None and b is not None and bool(a[0] <= b[0] and a[1] > b[1])

    @staticmethod
    def cross_down(a: pd.Series, b: pd.Series | float) -> bool:
        a, b = Context._last_two(a), Context._last_two(b)
        return a is not None and b is not None and bool(a[0] >= b[0] and a[1] < b[1])

    def param(self, key: str, default=None):
        value = self._params.get(key, default)
        self.reads[key] = (value, "given" if key in self._params else "default")
        return value

    def log(self, text: str) -> None:
        self.lines.append(str(text))

    buy = staticmethod(lambda: "BUY")
    sell = staticmethod(lambda: "SELL")
    close_position = staticmethod(lambda: "CLOSE")
    hold = staticmethod(lambda: "HOLD")


#: What user code trades unless told otherwise: one lot a time; its conditions are the code's own.
CUSTOM = Strategy(entry=(("always_true", {}),), exit=(("always_true", {}),))
DECISIONS = {"BUY": "BUY", "LONG": "BUY", "SELL": "SELL", "SHORT": "SELL", "CLOSE": "CLOSE", "EXIT": "CLOSE", "HOLD": "HOLD", "": "HOLD"}


def decided(value: object) -> str:
    return DECISIONS.get(str(value or "").strip().upper(), "HOLD")


def compile_on_bar(source: str):
    """The on_bar of a source text; trusted code, run in the executors' Python."""
    import ast

    tree = ast.parse(source)
    if not any(isinstance(x, ast.FunctionDef) and x.name == "on_bar" for x in tree.body):
        raise ValueError("on_bar(ctx) is missing")
    space: dict = {"pd": pd, "np": np, "math": math}
    exec(compile(tree, "<strategy>", "exec"), space)  # noqa: S102
    return space["on_bar"]


def decisions(bars: pd.DataFrame, source: str, params: dict, s: Strategy) -> list[tuple]:
    """(ts, decision, actions, price) of one symbol's bars, in order of ts: where on_bar wants what changes the position. Errors hold."""
    on_bar, ctx, rows = compile_on_bar(source), Context(bars, params, {}), []
    opened = 0
    for i in range(2, len(bars)):
        ctx.i, ctx.bars_in_position = i, i - opened if ctx.position != "flat" else 0
        try:
            decision = decided(on_bar(ctx))
        except MemoryError:  # not the user's to hold: the task, or the child that runs it, fails
            raise
        except Exception as e:  # a user's error holds, and is told
            decision, _ = "HOLD", ctx.log(repr(e))
        actions = []
        wanted = {"BUY": "long", "SELL": "short"}.get(decision)
        if ctx.position != "flat" and (decision == "CLOSE" or (wanted and wanted != ctx.position)):
            actions.append(f"CLOSE {'sell' if ctx.position == 'long' else 'buy'}")
            ctx.position = "flat"
        if wanted and ctx.position == "flat" and (wanted == "long" or s.kind == "future"):
            actions.append(f"OPEN {'buy' if wanted == 'long' else 'sell'}")
            ctx.position, ctx.entry_price, opened = wanted, float(bars["close"].iloc[i]), i
        if actions:
            rows.append((bars["ts"].iloc[i], decision, ",".join(actions), float(bars["close"].iloc[i])))
    return rows


def run_custom(bars: DataFrame, source: str, params: dict | None = None, s: Strategy | None = None) -> DataFrame:
    """symbol and the decisions that on_bar takes on each bar: ts, decision, and the actions (OPEN and CLOSE, buys and sells) they mean.

    A decision against the position closes it and opens the other way; short positions only for futures. Errors hold.
    """
    s = s or CUSTOM
    compile_on_bar(source)
    params = dict(params or {})
    kind = bars.schema["ts"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        rows = [(pdf["symbol"].iloc[0], *r) for r in decisions(pdf, source, params, s)]
        return pd.DataFrame(rows, columns=["symbol", "ts", "decision", "actions", "price"], dtype=object)

    return bars.groupBy("symbol").applyInPandas(run, f"symbol {bars.schema['symbol'].dataType.simpleString()}, ts {kind}, decision string, actions string, price double")


def replay_decisions(bars: pd.DataFrame, on_bar, params: dict, s: Strategy, fund: bool = False) -> list[tuple]:
    """Events of a user's decisions over one symbol's bars, as replay() gives them: decided on closed bars, filled at the next open.

    A decision against the position closes it and, where the other way can be traded, opens that at the same price. Stops come before
    decisions. What else is told: `param` events, once each (name, value and whether it was given), and `log` events; an error in the
    user's code is logged and holds.
    """
    n = len(bars)
    if n < 3:
        return []
    ts, o, c = bars["ts"].tolist(), bars["open"].to_numpy(float), bars["close"].to_numpy(float)
    book, ctx = _Book(s, ts, fund), Context(bars, params, {})
    position: tuple[int, float, float, bool] | None = None  # bar, fill, signal price, long
    told = 0

    def leave(i: int, reason: str) -> None:
        at, entry, _, long = position
        book.close(i, at, entry, book.fill(i, o[i], long, False, s.quantity), s.quantity, long, reason)

    for i in range(2, n):
        d = i - 1
        if d >= 2:
            ctx.i = d
            ctx.position = "flat" if position is None else "long" if position[3] else "short"
            ctx.entry_price, ctx.bars_in_position = (position[1], d - position[0] + 1) if position else (0.0, 0)
            if position is not None and (why := stopped(s, position[3], position[2], c[d])):
                leave(i, why)
                position = None
            else:
                try:
                    decision = decided(on_bar(ctx))
                except MemoryError:
                    raise
                except Exception as e:  # a user's error holds, and is told
                    decision = "HOLD"
                    ctx.log(repr(e))
                wanted = {"BUY": True, "SELL": False}.get(decision)
                if position is not None and (decision == "CLOSE" or (wanted is not None and wanted != position[3])):
                    leave(i, "signal")
                    position = None
                if position is None and wanted is not None and (wanted or s.kind == "future"):
                    position = (i, book.fill(i, o[i], wanted, True, s.quantity), o[i], wanted)
            for line in ctx.lines[told:]:
                book.events.append(("log", d, ts[d], *[None] * 11, line, None))
            told = len(ctx.lines)
        book.mark(i, (c[i] - position[1]) * (1.0 if position[3] else -1.0) * s.quantity * s.unit if position else 0.0)
    for key, (value, origin) in ctx.reads.items():
        book.events.append(("param", n - 1, ts[-1], *[None] * 11, f"{key}={value} ({origin})", None))
    if s.settle and position is not None:
        book.close(n - 1, position[0], position[1], c[-1], s.quantity, position[3], "settled")
        return book.settled()
    return book.events


def backtest_custom(bars: DataFrame, source: str, params: dict | None = None, s: Strategy | None = None) -> DataFrame:
    """symbol and the events of a user's on_bar(ctx) on every symbol: trades(), equity() and fills() read them as those of backtest().

    source is trusted code: it runs in the executors' Python, without a sandbox.
    """
    s, params = s or CUSTOM, dict(params or {})
    compile_on_bar(source)
    wanted = bars.select("symbol", "ts", "open", "high", "low", "close", "volume")
    schema = f"symbol {bars.schema['symbol'].dataType.simpleString()}, " + EVENT_SCHEMA.format(ts=bars.schema["ts"].dataType.simpleString())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        symbol = pdf["symbol"].iloc[0]
        return event_frame(replay_decisions(pdf, compile_on_bar(source), params, s, is_fund_code(symbol)), symbol)

    return wanted.groupBy("symbol").applyInPandas(run, schema)


def parameters(events: DataFrame) -> DataFrame:
    """parameter and symbols: what the user's code read, its value and whether it was given, and on how many symbols."""
    return events.where("event = 'param'").groupBy(F.col("reason").alias("parameter")).agg(F.count("*").alias("symbols"))
