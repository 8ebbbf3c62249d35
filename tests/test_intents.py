"""Intents against a loop over bars, for series of one block and of many."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspark.functions import recurrence as R
from barspark.operators.intents import Rules, intents


def looped(rows, rules):
    """(kind, action, quantity, price, reason, blocked, state, entry_price, realized) of [(ts, close, price, up, down)]."""
    out, position, entry, realized, trades, day, ordered = [], 0, 0.0, 0.0, 0, None, None
    side = -1 if rules.short else 1
    for ts, close, price, up, down in rows:
        if ts.date() != day:
            day, trades, realized = ts.date(), 0, 0.0
        kind = action = quantity = reason = blocked = 0
        filled = None
        if close is not None and price is not None:
            if position == 0 and up:
                waited = None if ordered is None else (ts - ordered).total_seconds()
                if rules.max_trades and trades >= rules.max_trades:
                    blocked = 7
                elif rules.daily_loss and realized <= -rules.daily_loss:
                    blocked = 8
                elif rules.cooldown and waited is not None and waited < rules.cooldown:
                    blocked = 9
                else:
                    kind, action, quantity, filled, reason = 1, side, rules.quantity, price, 1
                    position, entry, trades, ordered = side, price, trades + 1, ts
            elif position:
                gain = (close - entry) * position
                tests = [(3, rules.stop_pct, -gain >= entry * rules.stop_pct / 100), (4, rules.take_pct, gain >= entry * rules.take_pct / 100), (5, rules.stop_abs, -gain >= rules.stop_abs), (6, rules.take_abs, gain >= rules.take_abs)]
                if rules.stops_first:
                    tests.sort(key=lambda t: t[0] % 2 == 0)
                reason = next((c for c, limit, hit in tests if limit and hit), 2 if down else 0)
                if reason:
                    kind, action, quantity, filled = 2, -position, rules.quantity, price
                    realized += (price - entry) * position * rules.quantity
                    position, entry = 0, 0.0
        out.append((kind, action, quantity, filled, reason, blocked, position, entry, realized))
    return out


@pytest.mark.parametrize("block", [1024, 17])
@pytest.mark.parametrize(
    "rules",
    [Rules(stop_pct=2, take_pct=3, stop_abs=1.5, take_abs=2, max_trades=2, cooldown=5400, daily_loss=4, stops_first=False), Rules(short=True, quantity=3, stop_pct=2, take_pct=2, stop_abs=1, take_abs=2)],
)
def test_intents_are_those_of_a_loop(spark, monkeypatch, block, rules):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = []
    for symbol, n in (("a", 120), ("b", 9), (None, 30)):
        close = 100 + rng.normal(size=n).cumsum()
        for k in range(n):
            ts = dt.datetime(2024, 1, 1, 9) + dt.timedelta(minutes=40 * k)
            rows.append((symbol, ts, None if rng.random() < 0.05 else float(close[k]), float(close[k] + rng.normal() / 10), bool(rng.random() < 0.4), None if rng.random() < 0.1 else bool(rng.random() < 0.2)))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, fill double, up boolean, down boolean")
    got = intents(df, F.col("up"), F.col("down"), rules, price="fill")
    assert "Python" not in got._jdf.queryExecution().toString()
    names = ["kind", "action", "quantity", "price", "reason", "blocked", "state", "entry_price", "realized"]
    for symbol in ("a", "b", None):
        mine = [r for r in rows if r[0] == symbol]
        theirs = looped([r[1:5] + (bool(r[5]),) for r in mine], rules)
        found = [tuple(r[c] for c in names) for r in got.where(F.col("symbol").eqNullSafe(symbol)).orderBy("ts").collect()]
        assert len(found) == len(theirs)
        for a, b in zip(found, theirs):
            assert a[:3] + a[4:7] == b[:3] + b[4:7] and a[3] == b[3] and a[7:] == pytest.approx(b[7:], rel=1e-9, abs=1e-9)


def test_windows_of_decision_clashing_names_and_faulty_rules(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, h), 10.0 + h, "x") for h in range(6)], "symbol string, ts timestamp, close double, state string")
    rows = intents(df, F.lit(True), F.lit(False), Rules(take_abs=1), decide=F.hour("ts") >= 2).orderBy("ts").collect()
    assert [r.kind for r in rows] == [0, 0, 1, 2, 1, 2] and [r.order_state for r in rows] == [0, 0, 1, 0, 1, 0] and rows[0].state == "x"
    assert intents(df.limit(0), F.lit(True), F.lit(False), Rules()).count() == 0
    for wrong in ({"quantity": 0}, {"stop_pct": -1.0}, {"cooldown": float("nan")}):
        with pytest.raises(ValueError, match="at least"):
            Rules(**wrong)
