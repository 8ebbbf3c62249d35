"""Exponential averages in blocks against the pandas forms, for short series and for one cut into many blocks."""

import numpy as np
import pandas as pd
import pytest

from barspark.functions import recurrence as R
from barspark.functions.scan import Scan, computed, with_scans

SCANS = [Scan("ema", (20,)), Scan("ema", (1,)), Scan("macd", (12, 26, 9)), Scan("rsi", (14,)), Scan("kdj", (9, 3, 3)), Scan("kdj", (40, 1, 2)), Scan("dmi", (14,)), Scan("jae", (14, 9, 3, 3, 60)), Scan("ema", (5,), "volume"), Scan("sma", (5,)), Scan("sma", (240,)), Scan("wma", (7,)), Scan("sma", (3,), "volume")]


def series(symbol, n, rng):
    close = 100 + rng.normal(size=n).cumsum()
    high, low = close + rng.random(n), close - rng.random(n)
    close[rng.random(n) < 0.05], high[rng.random(n) < 0.03] = np.nan, np.nan
    if n > 100:
        close[20:60], high[70:90], low[70:90] = np.nan, 50.0, 50.0  # a long gap, and bars without width
    return pd.DataFrame({"symbol": symbol, "ts": np.arange(n), "high": high, "low": low, "close": close, "volume": 1.5, "note": "x"})


@pytest.mark.parametrize("block", [1024, 50, 6])
def test_lines_are_those_of_pandas(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = np.random.default_rng(block)
    bars = pd.concat([series("a", 40, rng), series("b", 400, rng), series("c", 1, rng), series(None, 30, rng)], ignore_index=True)
    df = spark.createDataFrame(bars.sample(frac=1, random_state=1))
    got = with_scans(df, SCANS)
    assert got.columns == [*bars.columns, *(o for s in SCANS for o in s.outputs)]
    got = got.toPandas()
    assert len(got) == len(bars)
    for symbol, mine in bars.groupby("symbol", dropna=False):
        theirs = got[got.symbol.isna() if pd.isna(symbol) else got.symbol == symbol].sort_values("ts")
        for scan in SCANS:
            for o, x in zip(scan.outputs, computed(mine.reset_index(drop=True), scan), strict=True):
                np.testing.assert_allclose(theirs[o].astype(float).to_numpy(), x.astype(float).to_numpy(), rtol=1e-8, atol=1e-7, err_msg=f"{symbol} {o}")


def test_one_series_is_many_tasks_without_python(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 100)
    bars = spark.range(3000).selectExpr("'one' AS symbol", "id AS ts", "double(id % 37) AS close")
    rows = with_scans(bars, [Scan("ema", (20,)), Scan("macd", (12, 26, 9))])
    assert "Python" not in rows._jdf.queryExecution().toString() and "Pandas" not in rows._jdf.queryExecution().toString()
    blocks = R.blocks_of(bars, "symbol", "ts", ["close"], 1)
    sizes = [r.n for r in blocks.rows.selectExpr("size(_rows) AS n").collect()]
    assert blocks.long and sum(sizes) == 3000 and len(sizes) > 20 and max(sizes) < 300


def test_empty_bars_and_a_series_without_values(spark):
    bars = spark.createDataFrame([("a", k, None) for k in range(3)], "symbol string, ts long, close double")
    rows = with_scans(bars, [Scan("ema", (3,)), Scan("rsi", (2,))])
    assert [(r.ema_3, r.rsi_2) for r in rows.collect()] == [(None, None)] * 3
    assert with_scans(bars.limit(0), [Scan("ema", (3,))]).count() == 0


def test_kd_rounds_as_its_sql(spark):
    """k and d to the last bit, over gaps and where they stand still, as crosses hang on it."""
    rng = np.random.default_rng(5)
    close = np.concatenate([np.linspace(10, 20, 30), rng.normal(30, 3, 60), np.full(14, 25.0), rng.normal(30, 3, 40)]).round(2)
    rows = [("a", i, *(float(x),) * 3) for i, x in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, ts int, high double, low double, close double")
    s = Scan("kdj", (9, 3, 3))
    found = [(r[f"{s.prefix}_k"], r[f"{s.prefix}_d"]) for r in with_scans(bars, [s]).orderBy("ts").collect()]
    k = d = None
    w, expected = 1.0, []
    for i, x in enumerate(close):
        window = close[max(0, i - 8) : i + 1]
        rsv = 100 * (x - window.min()) / (window.max() - window.min()) if i >= 8 and window.max() > window.min() else None
        if rsv is not None:
            k, w = rsv if k is None else (w * 2 / 3 * k + rsv / 3) / (w * 2 / 3 + 1.0 / 3), 1.0
        else:
            w = w * 2 / 3
        d = None if k is None else k if d is None else d + (k - d) / 3
        expected.append((k, d))
    assert found == expected
