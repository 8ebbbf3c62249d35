"""The band strategy: a daily close proposes, the next noon's price confirms, and a delay later the order is sent or grows stale.

State of one symbol and direction. Long and short are one machine on signed prices: a short's close, line and stop are compared negated.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars before the first decision, and seconds until a confirmed order is sent and until it is stale.
LEAST_BARS, DELAY, STALE = 20, 60.0, 600.0
NOON = (12 * 60, 12 * 60 + 4)


@dataclass(frozen=True)
class Band:
    """line divides long from short; stop ends a position; arm is the profit that arms the trailing line, step its step."""

    line: float
    stop: float
    arm: float
    step: float
    direction: str = "long"
    quantity: int = 1

    def problems(self) -> list[str]:
        out = [f"{n} is positive" for n in ("line", "stop", "arm", "step") if not getattr(self, n) > 0]
        return out + ([] if self.direction in ("long", "short") else ["direction is long or short"])


@dataclass
class State:
    position: bool = False
    quantity: int = 0
    entry: float = 0.0
    proposed: str | None = None  # enter, stop, trail or average
    reference: float = 0.0
    armed: bool = False
    trail: float = 0.0
    by_average: bool = False
    order: tuple[str, float] | None = None  # open or close, and since when
    last_day: object = None
    last_noon: object = None
    discarded: list[str] = field(default_factory=list)


def on_close(b: Band, s: State, day: object, close: float, average: float | None, bars: int) -> None:
    """A day's close; the same day again changes nothing."""
    if bars < LEAST_BARS or s.last_day == day:
        return
    s.last_day = day
    m = 1.0 if b.direction == "long" else -1.0
    price = m * close
    if not s.position:
        if s.proposed is None and price > m * b.line:
            s.proposed = "enter"
        return
    if s.proposed is not None:
        return
    if price < m * b.stop:
        s.proposed = "stop"
        return
    if s.by_average:
        if average is not None and price < m * average:
            s.proposed, s.reference = "average", average
        return
    profit = price - m * s.entry if s.entry > 0 else 0.0
    if s.entry > 0:
        if not s.armed and profit > b.arm:
            s.armed, s.trail = True, s.entry
        if s.armed and b.step > 0 and (n := int((profit - b.arm) // b.step)) > 0:
            s.trail = m * max(m * s.trail, m * (s.entry + m * n * b.step))
        if s.armed and price < m * s.trail:
            s.proposed = "trail"
            return
    if profit > b.arm and average is not None and price > m * average:
        s.by_average = True


def on_noon(b: Band, s: State, day: object, price: float, now: float) -> None:
    """The price at noon confirms what was proposed, or drops it; once a day."""
    if s.last_noon == day:
        return
    s.last_noon = day
    m = 1.0 if b.direction == "long" else -1.0
    proposed, s.proposed = s.proposed, None
    if proposed == "enter":
        if m * price > m * b.line:
            s.entry, s.armed, s.trail, s.by_average = price, False, 0.0, False
            s.order = ("open", now)
    elif proposed is not None:
        holds = {"stop": m * price < m * b.stop, "trail": m * price <= m * s.trail, "average": m * price < m * s.reference}[proposed]
        if holds:
            s.entry, s.armed, s.trail, s.by_average = 0.0, False, 0.0, False
            s.order = ("close", now)


def on_time(b: Band, s: State, price: float, now: float) -> tuple[str, str, int, float] | None:
    """(open or close, buy or sell, quantity, price) when a confirmed order is due; a stale one is discarded."""
    if s.order is None:
        return None
    kind, since = s.order
    if now - since >= STALE:
        s.discarded.append(kind)
        s.order = None
        return None
    if now - since < DELAY:
        return None
    s.order = None
    quantity = b.quantity if kind == "open" else s.quantity
    s.position, s.quantity = kind == "open", quantity if kind == "open" else 0
    return kind, "buy" if (kind == "open") == (b.direction == "long") else "sell", quantity, price


def decisive(intraday: DataFrame) -> DataFrame:
    """Of a symbol's prices those that can decide: each day's first at noon, and the first that is a delay later and not stale.

    Two rows a day at most, however many prices there are. An order that meets no price in time is stale at whatever comes next.
    """
    minute = F.hour("ts") * 60 + F.minute("ts")
    p = intraday.select("symbol", "ts", "price", F.to_date("ts").alias("_day"), minute.alias("_minute")).where(f"_minute between {NOON[0]} and {NOON[1] + int(STALE) // 60}")
    # One shuffle: a day's prices around noon meet its first one in a window, not in a join with themselves.
    noon = F.min(F.when(F.col("_minute") <= NOON[1], F.struct("ts", "price"))).over(Window.partitionBy("symbol", "_day"))
    since = F.col("_noon.ts")
    due = F.when((F.col("ts") >= since + F.expr(f"interval {int(DELAY)} seconds")) & (F.col("ts") < since + F.expr(f"interval {int(STALE)} seconds")), F.struct("ts", "price"))
    days = p.withColumn("_noon", noon).groupBy("symbol", "_day").agg(F.min("_noon").alias("_noon"), F.min(due).alias("_due"))
    return days.select("symbol", F.explode(F.array_compact(F.array("_noon", "_due"))).alias("_first")).select("symbol", "_first.ts", "_first.price")


def run(daily: DataFrame, intraday: DataFrame, b: Band) -> DataFrame:
    """symbol, ts, kind, action, quantity, price: what the strategy does over days of daily bars and prices within days.

    daily has symbol, ts (a date) and close, intraday symbol, ts and price. Events of a symbol are put in order of time, a day's close after
    its prices. Symbols are many and short, three rows a day at most: a task folds all of its own in one streaming pass.
    """
    a = daily.select("symbol", F.date_add("ts", 1).cast("timestamp_ntz").alias("at"), F.lit(0).alias("order"), F.col("ts").alias("day"), F.col("close").alias("price"))
    p = decisive(intraday).select("symbol", F.col("ts").cast("timestamp_ntz").alias("at"), F.lit(1).alias("order"), F.to_date("ts").alias("day"), "price")
    kind = daily.schema["symbol"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, closes, bars = None, State(), deque(maxlen=LEAST_BARS), 0
        for batch in batches:
            at, day = batch["at"].cast(pa.int64()).to_pylist(), batch["day"].cast(pa.int32()).to_pylist()
            symbols, prices = batch["symbol"].to_pylist(), batch["price"].cast(pa.float64()).to_numpy(zero_copy_only=False).tolist()
            out: list[tuple] = []
            for n, (symbol, us, order, date, price) in enumerate(zip(symbols, at, batch["order"].to_pylist(), day, prices, strict=True)):
                if symbol != key:
                    key, state, closes, bars = symbol, State(), deque(maxlen=LEAST_BARS), 0
                if order == 0:
                    closes.append(price)
                    bars += 1
                    # Only a position that nothing is proposed for asks for the average.
                    asked = state.position and state.proposed is None and bars >= LEAST_BARS
                    on_close(b, state, date, price, sum(closes) / LEAST_BARS if asked else None, bars)
                elif state.proposed is not None or state.order is not None:
                    now, minute = us / 1e6, us // 60_000_000 % 1440
                    if NOON[0] <= minute <= NOON[1]:
                        on_noon(b, state, date, price, now)
                    if (done := on_time(b, state, price, now)) is not None:
                        out.append((n, *done))
            rows = pa.array([r[0] for r in out], pa.int64())
            made = [pa.array([r[k] for r in out], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.int32()), (4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch["symbol"].take(rows), batch["at"].take(rows), *made], ["symbol", "ts", "kind", "action", "quantity", "price"])

    dealt = a.unionByName(p).repartition("symbol").sortWithinPartitions("symbol", "at", "order")
    return dealt.mapInArrow(fold, f"symbol {kind}, ts timestamp_ntz, kind string, action string, quantity int, price double")
