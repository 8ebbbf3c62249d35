"""What moves along streams: crossing positions, live stops on executed prices, notifications, and a gate that opens once a day."""

from __future__ import annotations

import json
from dataclasses import dataclass

from barspark.operators import band as B
from barspark.streaming.ordered import Fold, Row

DAY = 86_400_000_000


@dataclass
class Crossing(Fold):
    """A position that an exponential crossing of the value opens and closes."""

    fast: int = 5
    slow: int = 20
    state = "fast double, slow double, above boolean, entry double"
    output = "action string, price double, pnl double"

    def start(self) -> tuple:
        return None, None, None, None

    def step(self, state: tuple, row: Row) -> tuple[tuple, list[tuple]]:
        f, s, above, entry = state
        x, out = row.value, []
        if x is None:
            return state, out
        f = x if f is None else f + 2 / (self.fast + 1) * (x - f)
        s = x if s is None else s + 2 / (self.slow + 1) * (x - s)
        now = f > s
        if above is not None and now and not above and entry is None:
            entry = x
            out.append(("open", x, None))
        elif above and not now and entry is not None:
            out.append(("close", x, x - entry))
            entry = None
        return (f, s, now, entry), out


@dataclass
class LiveStops(Fold):
    """Stops and takes within bars, measured from the average price that fills were executed at, for long and short positions.

    Rows of kind fill have side * quantity in side and the executed price in value; others are prices. A fill that adds moves
    the average, one that reduces keeps it, one that turns the position starts anew. The first price at or beyond a limit closes the position
    at that price: percent before points, stops before takes. Limits of 0 are off.
    """

    stop_pct: float = 0.0
    stop_points: float = 0.0
    take_pct: float = 0.0
    take_points: float = 0.0
    state = "quantity double, entry double"
    output = "action string, quantity double, price double, entry double, reason string"

    def start(self) -> tuple:
        return 0.0, 0.0

    def step(self, state: tuple, row: Row) -> tuple[tuple, list[tuple]]:
        held, entry = state
        price = row.value
        if price is None or price <= 0:
            return state, []
        if row.kind == "fill":
            more = row.side or 0.0
            total = held + more
            if held * more >= 0:
                entry = (held * entry + more * price) / total if total else 0.0
            elif held * total < 0:
                entry = price
            return (total, entry if total else 0.0), []
        if not held or entry <= 0:
            return state, []
        points = (price - entry) * (1 if held > 0 else -1)
        percent = points / entry * 100
        reason = next((why for why, limit, move in self._limits(percent, points) if limit > 0 and move >= limit), None)
        if reason is None:
            return state, []
        return (0.0, 0.0), [("sell" if held > 0 else "buy", abs(held), price, entry, reason)]

    def _limits(self, percent: float, points: float) -> tuple[tuple[str, float, float], ...]:
        return ("stop_pct", self.stop_pct, -percent), ("stop_points", self.stop_points, -points), ("take_pct", self.take_pct, percent), ("take_points", self.take_points, points)


@dataclass
class Notices(Fold):
    """Which signals are told: a one-shot pattern once a bar, a lasting one when its label is not what it was at the evaluation before.

    An evaluation is the rows of one time and seq; kind is the pattern, label what it says. A row without kind is an evaluation that found nothing;
    a lasting pattern that an evaluation does not find is forgotten. bar is the length of a bar in microseconds; what was told of one bar
    is forgotten with the first evaluation of the next.
    """

    lasting: tuple[str, ...] = ("regime",)
    bar: int = DAY
    state = "kept string"
    output = "pattern string, label string"

    def start(self) -> tuple:
        return (json.dumps({"bar": None, "told": [], "at": None, "before": {}, "now": {}}),)

    def step(self, state: tuple, row: Row) -> tuple[tuple, list[tuple]]:
        s, out = json.loads(state[0]), []
        if row.us // self.bar != s["bar"]:
            s["bar"], s["told"] = row.us // self.bar, []
        if [row.us, row.seq] != s["at"]:
            s["at"], s["before"], s["now"] = [row.us, row.seq], s["now"], {}
        if row.kind in self.lasting:
            if s["before"].get(row.kind) != row.label and s["now"].get(row.kind) != row.label:
                out.append((row.kind, row.label))
            s["now"][row.kind] = row.label
        elif row.kind is not None and row.kind not in s["told"]:
            s["told"].append(row.kind)
            out.append((row.kind, row.label))
        return (json.dumps(s),), out


@dataclass
class DailyGate(Fold):
    """The first row of a day at or after a minute of it; one that was missed opens the gate later, and never twice a day."""

    minute: int = 14 * 60
    state = "day long"
    output = "seq long, value double"

    def start(self) -> tuple:
        return (-1,)

    def step(self, state: tuple, row: Row) -> tuple[tuple, list[tuple]]:
        day, since = divmod(row.us, DAY)
        if day == state[0] or since < self.minute * 60_000_000:
            return state, []
        return (day,), [(row.seq, row.value)]


@dataclass
class BandOrders(Fold):
    """The band strategy on prices as they come: a day closes with its last price, and a confirmed order that meets no price in time is stale."""

    band: B.Band
    state = "kept string"
    output = "kind string, action string, quantity int, price double"

    def start(self) -> tuple:
        return (json.dumps({"machine": B.State().__dict__, "closes": [], "days": 0, "day": None, "price": None}),)

    def step(self, state: tuple, row: Row) -> tuple[tuple, list[tuple]]:
        kept = json.loads(state[0])
        if row.value is None:
            return state, []
        s = B.State(**kept["machine"])
        day, since = divmod(row.us, DAY)
        if kept["day"] is not None and day > kept["day"]:
            kept["closes"] = [*kept["closes"], kept["price"]][-B.LEAST_BARS :]
            kept["days"] += 1
            average = sum(kept["closes"]) / B.LEAST_BARS if kept["days"] >= B.LEAST_BARS else None
            B.on_close(self.band, s, kept["day"], kept["price"], average, kept["days"])
        now = row.us / 1e6
        if B.NOON[0] <= since // 60_000_000 <= B.NOON[1]:
            B.on_noon(self.band, s, day, row.value, now)
        done = B.on_time(self.band, s, row.value, now)
        kept |= {"machine": s.__dict__, "day": day, "price": row.value}
        return (json.dumps(kept),), [done] if done is not None else []

    def due(self, state: tuple) -> int | None:
        order = json.loads(state[0])["machine"]["order"]
        return None if order is None else round((order[1] + B.STALE) * 1e6)

    def lapse(self, state: tuple) -> tuple[tuple, list[tuple]]:
        kept = json.loads(state[0])
        kind = kept["machine"]["order"][0]
        kept["machine"]["order"] = None
        kept["machine"]["discarded"].append(kind)
        return (json.dumps(kept),), [("stale", kind, 0, None)]
