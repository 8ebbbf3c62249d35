"""Scalar functions of prices, costs, dates and sessions, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price bands and their ticks, for shares; funds have two.
SHARE_TICKS = ((10, 0.01), (50, 0.05), (100, 0.1), (500, 0.5), (1000, 1.0))
SHARE_TOP_TICK = 5.0
FUND_TICKS = ((50, 0.01),)
FUND_TOP_TICK = 0.05
# Units of a contract, and minutes of the day at which sessions open and close.
CONTRACT_UNITS = {"TXF": 200, "MXF": 50, "TMF": 10}
SHARE_LOT = 1000
STOCK_SESSION, DAY_SESSION, NIGHT_OPEN, NIGHT_CLOSE = (540, 810), (525, 825), 900, 300


def _banded(price: Column, bands: tuple[tuple[int, float], ...], top: float) -> Column:
    out = None
    for limit, tick in bands:
        out = F.when(price < limit, tick) if out is None else out.when(price < limit, tick)
    return out.otherwise(top)


def tick_size(price: Column, asset: str = "stock", symbol: Column | None = None) -> Column:
    """The smallest step of a price. asset: future, stock, index_tw or anything else."""
    if asset == "future":
        return F.lit(1.0)
    if asset not in ("stock", "index_tw"):
        return F.lit(0.01)
    share = _banded(price, SHARE_TICKS, SHARE_TOP_TICK)
    return share if symbol is None else F.when(symbol.startswith("00"), _banded(price, FUND_TICKS, FUND_TOP_TICK)).otherwise(share)


def round_to_tick(price: Column, asset: str = "stock", symbol: Column | None = None) -> Column:
    """Nearest step, halves to even; rounded again if that crosses into another band."""
    once = lambda p, t: F.bround(F.rint(p / t) * t, 4)
    tick = tick_size(price, asset, symbol)
    first = once(price, tick)
    again = tick_size(first, asset, symbol)
    return F.when(again != tick, once(first, again)).otherwise(first)


def format_price(price: Column, asset: str = "stock", symbol: Column | None = None) -> Column:
    tick = tick_size(price, asset, symbol)
    text = F.when(tick >= 1, F.format_string("%.0f", price)).when(tick >= 0.1, F.format_string("%.1f", price)).otherwise(F.format_string("%.2f", price))
    return F.when(price.isNull(), "--").otherwise(text)


def slipped(price: Column, buys: Column, ticks: int, asset: str = "stock", symbol: Column | None = None) -> Column:
    """Moved against the trader by whole ticks, then aligned."""
    return round_to_tick(price + tick_size(price, asset, symbol) * ticks * F.when(buys, 1).otherwise(-1), asset, symbol)


@dataclass(frozen=True)
class Costs:
    """Default rates of fees and taxes."""

    share_fee: float = 0.001425
    discount: float = 1.0
    share_least: float = 20.0
    odd_least: float = 1.0
    share_tax: float = 0.003
    fund_tax: float = 0.001
    lot_fee: float = 50.0
    future_tax: float = 0.00002


def is_fund(symbol: Column) -> Column:
    s = F.upper(F.trim(symbol))
    return s.startswith("00") & (F.length(s) >= 4)


def side_cost(kind: str, symbol: Column, price: Column, quantity: Column, unit: float, sells: Column, costs: Costs = Costs()) -> tuple[Column, Column]:
    """(fee, tax) of one side. kind: share, odd or future. Quantities count whole."""
    quantity = F.floor(quantity)
    amount = F.abs(price) * quantity * unit
    if kind == "future":
        return quantity * costs.lot_fee, amount * costs.future_tax
    least = costs.odd_least if kind == "odd" else costs.share_least
    fee = F.when(amount > 0, F.greatest(amount * costs.share_fee * costs.discount, F.lit(least))).otherwise(0.0)
    rate = F.when(is_fund(symbol), costs.fund_tax).otherwise(costs.share_tax)
    return fee, F.when(sells, amount * rate).otherwise(0.0)


def round_trip_cost(kind: str, symbol: Column, entry: Column, exit_: Column, quantity: Column, unit: float, short: Column, costs: Costs = Costs()) -> dict[str, Column]:
    fee_in, tax_in = side_cost(kind, symbol, entry, quantity, unit, short, costs)
    fee_out, tax_out = side_cost(kind, symbol, exit_, quantity, unit, ~short, costs)
    return {"fee": fee_in + fee_out, "tax": tax_in + tax_out, "total": fee_in + fee_out + tax_in + tax_out}


_DASHES = r"^(-+|—+|N/?A|n/?a|null|None)?$"


def _plain_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[,　%]", ""))


def whole_number(text: Column) -> Column:
    """Numeric text to a whole number; what cannot be read counts 0."""
    plain = _plain_number(text)
    return F.coalesce(F.when(~plain.rlike(_DASHES), plain.try_cast("double").try_cast("long")), F.lit(0).cast("long"))


def real_number(text: Column) -> Column:
    """Numeric text to a number; what cannot be read is null."""
    plain = _plain_number(text)
    return F.when(~plain.rlike(_DASHES), plain.try_cast("double"))


def iso_date(text: Column) -> Column:
    """A date from YYYYMMDD, or year, month and day with separators; years under 1911 count from 1911."""
    plain = F.trim(text)
    eight = plain.rlike(r"^\d{8}$")
    parts = [F.regexp_extract(plain, r"^(\d{2,4})\D?(\d{2})\D?(\d{2})\D*$", k).try_cast("int") for k in (1, 2, 3)]
    year = F.when(parts[0] < 1911, parts[0] + 1911).otherwise(parts[0])
    read = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(parts[1].cast("string"), 2, "0"), F.lpad(parts[2].cast("string"), 2, "0"))
    joined = F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))
    return F.when(eight, joined.try_cast("date")).otherwise(read.try_cast("date"))


def eps_from_pe(close: Column, pe: Column) -> Column:
    return F.when((pe > 0) & (close > 0), F.round(close / pe, 4))


def return_on_equity(eps: Column, close: Column, pb: Column) -> Column:
    return F.when((pb > 0) & (close > 0), F.round(F.try_divide(eps, close / pb) * 100, 2))


def _minute(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def is_trading_day(day: Column, holidays: list[str] | None = None) -> Column:
    open_ = F.weekday(day) < 5
    return open_ & ~F.to_date(day).cast("string").isin(holidays) if holidays else open_


def session(kind: str, ts: Column, holidays: list[str] | None = None, night: bool = True) -> Column:
    """regular, day, night or closed. kind: share or future. The small hours belong to the trading day before."""
    minute, today = _minute(ts), is_trading_day(ts, holidays)
    if kind == "share":
        return F.when(today & minute.between(*STOCK_SESSION), "regular").otherwise("closed")
    out = F.when(today & minute.between(*DAY_SESSION), "day")
    if night:
        yesterday = is_trading_day(F.date_sub(F.to_date(ts), 1), holidays)
        closed_today = F.to_date(ts).cast("string").isin(holidays) if holidays else F.lit(False)
        out = out.when(today & (minute >= NIGHT_OPEN), "night").when(~closed_today & (minute < NIGHT_CLOSE) & yesterday, "night")
    return out.otherwise("closed")


#: Minutes of the day at which any session opens.
OPENS = (525, 540, 550, 900)
MOST_SPAN_DAYS = 7


def just_opened(kind: str, ts: Column, seconds: int = 30, holidays: list[str] | None = None) -> Column:
    """Whether a session opened within the last so many seconds, its first moment included."""
    opens = (STOCK_SESSION[0],) if kind == "share" else (DAY_SESSION[0], NIGHT_OPEN)
    since = lambda m: _minute(ts) * 60 + F.second(ts) - m * 60
    hit = F.lit(False)
    for m in opens:
        hit = hit | ((since(m) >= 0) & (since(m) < seconds))
    return (session(kind, ts, holidays) != "closed") & hit


def session_opened_between(start: Column, end: Column) -> Column:
    """Whether any session opened in (start, end]; true for a missing bound, a clock set back, or more than a week."""
    days = F.sequence(F.to_date(start), F.to_date(end))
    moment = lambda d, m: d.cast("timestamp_ntz") + F.expr(f"interval {m} minutes")

    def any_open(d: Column) -> Column:
        hit = F.lit(False)
        for m in OPENS:
            hit = hit | ((moment(d, m) > start) & (moment(d, m) <= end))
        return (F.weekday(d) < 5) & hit

    opened = F.exists(days, any_open)
    return (
        F.when(start.isNull() | end.isNull() | (end < start) | (F.datediff(end, start) > MOST_SPAN_DAYS), True).when(end == start, False).otherwise(opened)
    )


def lots(shares: Column) -> Column:
    return shares / SHARE_LOT


def hundred_millions(amount: Column, thousands: bool = False) -> Column:
    """An amount, in units or in thousands, in units of 100 million."""
    return amount / (1e5 if thousands else 1e8)


def is_future_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol)).rlike(r"^[A-Z][A-Z0-9]{2}(R[1-9]|\d{6})$")


def product_code(symbol: Column) -> Column:
    """The first three characters of a future's symbol; a bare code of two or three is its own; else empty."""
    s = F.upper(F.trim(symbol))
    return F.when(is_future_symbol(symbol), F.substring(s, 1, 3)).when(s.rlike(r"^[A-Z][A-Z0-9]{1,2}$"), s).otherwise("")


def contract_unit(kind: str, symbol: Column) -> Column:
    if kind != "future":
        return F.lit(float(SHARE_LOT if kind == "share" else 1))
    out = F.when(F.lit(False), 0.0)
    for code, size in CONTRACT_UNITS.items():
        out = out.when(F.upper(symbol).startswith(code), float(size))
    return out.otherwise(1.0)


def in_time_window(minute: Column, start: int | None, end: int | None) -> Column:
    """Whether a minute of the day is in a window with both ends; a start after the end wraps midnight."""
    if start is None and end is None:
        return F.lit(True)
    start, end = 0 if start is None else start, 1439 if end is None else end
    return minute.between(start, end) if start <= end else (minute >= start) | (minute <= end)


def period_key(ts: Column, interval: str) -> Column:
    """The bar itself, or its week, month or quarter."""
    return ts.cast("date") if interval == "bar" else F.date_trunc(interval, ts).cast("date")


def timeframe_minutes(name: str) -> int | None:
    """Minutes of `<n>m` or `<n>h`; None for day, week and month."""
    if name[:-1].isdigit() and name[-1] in "mh":
        return int(name[:-1]) * (60 if name[-1] == "h" else 1)
    return None
