"""All patterns on every bar, against the detectors that look at one bar at a time, and against the future."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions import recurrence as R
from barspark.operators import evaluate as E
from barspark.operators import patterns as P


def walks():
    rng, out = np.random.default_rng(4), []
    for symbol, n in (("a", 160), ("b", 100), ("c", 8)):
        close = 100 * np.exp(rng.normal(size=n).cumsum() * 0.01)
        out.append(pd.DataFrame({"symbol": symbol, "ts": np.arange(n), "high": (close * (1 + rng.random(n) * 0.01)).round(1), "low": (close * (1 - rng.random(n) * 0.01)).round(1), "close": close.round(1)}))
    return pd.concat(out, ignore_index=True)


@pytest.mark.parametrize("block", [1024, 50])
def test_swings_on_every_bar(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    bars, s = walks(), P.Settings()
    swings = [n for pair in E.NAMES.values() for n in pair] + list(E.WEDGES.values())
    rows = E.evaluated(spark.createDataFrame(bars), s, tuple(swings))
    assert "Python" not in rows._jdf.queryExecution().toString()
    got = {}
    for r in rows.collect():
        got.setdefault((r.symbol, r.ts), []).append((r.pattern, None if r.line is None else round(r.line, 6)))
    want = {}
    for symbol, g in bars.groupby("symbol"):
        h, low, c = (g[x].to_numpy() for x in ("high", "low", "close"))
        for t in range(9, len(g)):
            if found := [(n, None if x is None else round(x, 6)) for n, x in P.swing_signals(h[: t + 1], low[: t + 1], c[: t + 1], s)]:
                want[symbol, t] = sorted(found)
    assert {k: sorted(v) for k, v in got.items()} == want and len({p for v in want.values() for p, _ in v}) >= 7


def test_the_last_bar_agrees_with_regime_and_nothing_sees_the_future(spark):
    bars = spark.createDataFrame(walks()).cache()
    whole = E.evaluated(bars).cache()
    last = {r.symbol: r for r in P.regime(bars).collect()}
    ends = {r.symbol: r.ts for r in bars.groupBy("symbol").agg(F.max("ts").alias("ts")).collect()}
    for r in whole.where("pattern = 'regime'").collect():
        if r.ts == ends[r.symbol]:
            assert r.label == last[r.symbol].regime
    early = sorted(map(tuple, E.evaluated(bars.where("ts < 70")).collect()), key=str)
    assert early == sorted(map(tuple, whole.where("ts < 70").collect()), key=str)


def test_choice_of_patterns_odd_and_empty_bars(spark):
    with pytest.raises(ValueError, match="no such patterns"):
        E.evaluated(spark.createDataFrame(walks()), enabled=("double", "regime"))
    flat = spark.range(30).selectExpr("'x' AS symbol", "id AS ts", "if(id = 5, null, 1.0D) AS high", "1.0D AS low", "if(id = 7, double('NaN'), 1.0D) AS close")
    found = {(r.pattern, r.label) for r in E.evaluated(flat).collect()}
    assert found == {("regime", "range")}
    assert E.evaluated(flat.limit(0)).count() == 0
