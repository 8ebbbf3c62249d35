"""Order intents of a strategy, one row a bar, folded inside the JVM: signals, stops, and what blocked an entry.

The position, its price, the day's trades and gains and the time of the last order are one typed state, folded along the bars of a
series. A series that functions/recurrence.py cuts into blocks is folded a block at a time: all first blocks, then all second ones
with the states that the first left, so a task never holds more than blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.recurrence import Blocks, as_bars, blocks_of
from barspark.sources.scratch import attached, written

#: What the codes of reason and blocked say.
REASONS = {1: "entry_signal", 2: "exit_signal", 3: "stop_loss_pct", 4: "take_profit_pct", 5: "stop_loss_abs", 6: "take_profit_abs", 7: "max_trades", 8: "daily_loss", 9: "cooldown"}
OPEN, CLOSE = 1, 2


@dataclass(frozen=True)
class Rules:
    """Limits of 0 are off. stops_first: both stops before both takes; else percent before absolute ones, the stop before the take."""

    short: bool = False
    quantity: int = 1
    stop_pct: float = 0.0
    take_pct: float = 0.0
    stop_abs: float = 0.0
    take_abs: float = 0.0
    max_trades: int = 0
    daily_loss: float = 0.0
    cooldown: float = 0.0
    stops_first: bool = True

    def __post_init__(self) -> None:
        if self.quantity < 1:
            raise ValueError("quantity is at least 1")
        for name in ("stop_pct", "take_pct", "stop_abs", "take_abs", "max_trades", "daily_loss", "cooldown"):
            if not 0 <= getattr(self, name) < float("inf"):
                raise ValueError(f"{name} is a number of at least 0")


STATE = {"position": "int", "entry": "double", "realized": "double", "trades": "int", "day": "long", "ordered": "long"}
OUTPUT = ("kind", "action", "quantity", "price", "reason", "blocked", "state", "entry_price", "realized")


def _start() -> Column:
    first = {"position": 0, "entry": 0.0, "realized": 0.0, "trades": 0, "day": None, "ordered": None}
    return F.struct(*(F.lit(first[n]).cast(t).alias(n) for n, t in STATE.items()))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _step(rules: Rules, s: Column, x: Column) -> Column:
    """The state behind a bar, with what the bar puts out."""
    side = -1 if rules.short else 1
    fresh = ~s["day"].eqNullSafe(x["day"])
    fine = x["close"].isNotNull() & x["price"].isNotNull()
    now = F.struct(F.when(fresh, 0).otherwise(s["trades"]).alias("trades"), F.when(fresh, F.lit(0.0)).otherwise(s["realized"]).alias("realized"))

    def decide(n: Column) -> Column:
        block = F.lit(0)
        if rules.cooldown > 0:
            block = F.when(x["us"] - s["ordered"] < rules.cooldown * 1e6, 9).otherwise(block)
        if rules.daily_loss > 0:
            block = F.when(n["realized"] <= -rules.daily_loss, 8).otherwise(block)
        if rules.max_trades > 0:
            block = F.when(n["trades"] >= rules.max_trades, 7).otherwise(block)
        gain = (x["close"] - s["entry"]) * s["position"]
        limits = [(3, rules.stop_pct, gain <= -(s["entry"] * rules.stop_pct / 100)), (4, rules.take_pct, gain >= s["entry"] * rules.take_pct / 100), (5, rules.stop_abs, gain <= -rules.stop_abs), (6, rules.take_abs, gain >= rules.take_abs)]
        if rules.stops_first:
            limits = [limits[k] for k in (0, 2, 1, 3)]
        ends = F.coalesce(*(F.when(hit, code) for code, limit, hit in limits if limit > 0), F.when(x["exit"], 2), F.lit(0))
        flat = s["position"] == 0
        why = F.when(~fine, 0).when(flat, F.when(x["enter"] & (block == 0), 1).otherwise(0)).otherwise(ends)
        stopped = F.when(fine & flat & x["enter"], block).otherwise(0)
        return F.struct(n["trades"].alias("trades"), n["realized"].alias("realized"), why.cast("int").alias("why"), stopped.cast("int").alias("blocked"))

    def act(d: Column) -> Column:
        opens, closes = d["why"] == 1, d["why"] > 1
        position = F.when(opens, side).when(closes, 0).otherwise(s["position"])
        entry = F.when(opens, x["price"]).when(closes, F.lit(0.0)).otherwise(s["entry"])
        realized = F.when(closes, d["realized"] + (x["price"] - s["entry"]) * s["position"] * rules.quantity).otherwise(d["realized"])
        state = (position, entry, realized, F.when(opens, d["trades"] + 1).otherwise(d["trades"]), x["day"], F.when(opens, x["us"]).otherwise(s["ordered"]))
        acts = F.when(d["why"] > 0, True)
        out = {
            "kind": F.when(opens, OPEN).when(closes, CLOSE).otherwise(0), "action": F.when(opens, side).when(closes, -s["position"]).otherwise(0), "quantity": F.when(acts, rules.quantity).otherwise(0), "price": F.when(acts, x["price"]),
            "reason": d["why"], "blocked": d["blocked"], "state": position, "entry_price": entry, "realized": realized,
        }
        return F.struct(F.struct(*(v.cast(t).alias(n) for (n, t), v in zip(STATE.items(), state, strict=True))).alias("s"), F.struct(*(v.cast("double" if k in ("price", "entry_price", "realized") else "int").alias(k) for k, v in out.items())).alias("out"))

    return _let(_let(now, decide), act)


def _folded(rules: Rules, state: Column) -> Column:
    """(s, outs): the state behind a block and what its bars put out."""
    kinds = ", ".join(f"{o}:{'double' if o in ('price', 'entry_price', 'realized') else 'int'}" for o in OUTPUT)
    start = F.struct(state.alias("s"), F.array().cast(f"array<struct<{kinds}>>").alias("outs"))
    step = lambda acc, x: _let(_step(rules, acc["s"], x), lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["outs"], r["out"]).alias("outs")))
    return F.aggregate("_bars", start, step)


def intents(
    bars: DataFrame, enter: Column, exits: Column, rules: Rules, price: str = "close", day: Column | None = None, decide: Column | None = None, key: str = "symbol", ts: str = "ts"
) -> DataFrame:
    """bars with kind (1 opens, 2 closes), action (+1 buys, -1 sells), quantity, price, reason, blocked, state, entry_price and realized.

    enter and exits are boolean columns over bars, null as false. Orders are filled at `price` of the bar that decides. day is the session
    that bounds trades and losses, by default the date of ts. Where decide is not true nothing is decided, and the position stays. A bar whose
    close or price is null or NaN decides nothing. A blocked entry leaves its code (7 to 9) in blocked. Bars of one ts are put in order by their other
    columns. price is null and reason 0 where nothing is ordered. Where bars has a column of such a name, the new one is called order_<name>. Empty bars
    give an empty result.
    """
    extra = {
        "_enter": F.coalesce(enter, F.lit(False)), "_exit": F.coalesce(exits, F.lit(False)), "_decide": F.lit(True) if decide is None else F.coalesce(decide, F.lit(False)),
        "_day": F.unix_date(F.to_date(ts) if day is None else F.to_date(day)).cast("long"), "_us": F.unix_micros(F.col(ts).cast("timestamp")),
    }
    columns = list(bars.columns)
    cut = blocks_of(bars.withColumns(extra), key, ts, [], 0)
    number = lambda v: F.nanvl(v.cast("double"), F.lit(None).cast("double"))
    row = lambda r: F.struct(
        number(r["close"]).alias("close"), F.when(r["_decide"], number(r[price])).alias("price"), r["_enter"].alias("enter"), r["_exit"].alias("exit"), r["_day"].alias("day"), r["_us"].alias("us")
    )
    rows = cut.rows.withColumn("_bars", F.transform("_rows", row))
    if not cut.long:
        done = rows.withColumn("_f", _folded(rules, _start()))
    else:
        # The n-th blocks of all series at once; a series without an n-th block has ended.
        rows, parts, state, n = written(rows, "intent-blocks"), [], None, 0
        for n in range(1 + rows.agg(F.max("_block")).first()[0]):
            mine = rows.where(F.col("_block") == n).withColumn("_key", F.struct(key))
            if state is not None:
                mine = attached(mine, state, ["_key"], "left")
            mine = mine.withColumn("_f", _folded(rules, _start() if state is None else F.coalesce("_state", _start())))
            parts.append(written(mine.select(key, "_block", "_rows", "_f"), "intent-part"))
            new = parts[-1].select(F.struct(key).alias("_key"), F.col("_f.s").alias("_state"))
            # A series whose n-th block is empty keeps its state.
            state = new if state is None else new.union(state.join(new, "_key", "left_anti"))
            state = written(state, "intent-state")
        done = reduce(DataFrame.union, parts)
    outs = {f"_o_{o}": F.col("_f.outs")[o] for o in OUTPUT}
    flat = Blocks(done.withColumns(outs), key, cut.long, columns)
    names = {f"order_{o}" if o in columns else o: f"_o_{o}" for o in OUTPUT}
    return as_bars(flat, names)
