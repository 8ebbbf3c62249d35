"""All patterns on every bar as kernels, against the folds and frames in the JVM and the detectors of one bar."""

import math
import struct
from collections import Counter

import numpy as np
import pytest

from barspark.operators import detect as D
from barspark.operators import evaluate as E
from barspark.operators import patterns as P
from barspark.queries import QUERIES


def _rows(df):
    """Rows with their lines to the last bit."""
    return Counter((r.symbol, r.ts, r.pattern, r.label, None if r.line is None else struct.pack("d", r.line + 0.0)) for r in df.collect())


def _drawn(gaps, symbols=(("a", 230), ("b", 60), (None, 120), ("c", 8), ("d", 1), ("e", 150), ("f", 140))):
    draw, out = np.random.default_rng(11), []
    for symbol, n in symbols:
        close = 100 + draw.normal(size=n).cumsum()
        for t in range(n):
            x = round(float(close[t]), 1)
            high, low = x + float(draw.integers(0, 4)) / 2, x - float(draw.integers(0, 4)) / 2
            if symbol == "e":  # few prices, so that neighbours of one kind are often equal; around zero
                high, low, x = float(draw.integers(0, 4)), float(draw.integers(-4, 1)), float(draw.integers(-2, 3))
            if symbol == "f":  # every bar is a candidate for long
                high, low, x = 5.0, 5.0 - t * 0.01, 5.0 if t % 40 else 4.0
            high, low, x = ((None if draw.random() < 0.5 else math.nan) if gaps and draw.random() < 0.04 else v for v in (high, low, x))
            out.append((symbol, t, high, low, x))
    return out


SCHEMA = "symbol string, ts int, high double, low double, close double"


@pytest.mark.parametrize("rows", ["7", "10000"])
@pytest.mark.parametrize("gaps", [False, True])
def test_kernels_are_the_folds_and_frames(spark, rows, gaps):
    """over nulls, NaN, series of every length and batches of a few rows."""
    bars = spark.createDataFrame(_drawn(gaps), SCHEMA).cache()
    for s in (P.Settings(), P.Settings(lookback=20, swing_window=2, tolerance_pct=8.0, recover_bars=3, max_island_bars=3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = _rows(D.detected(bars, s))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == _rows(E.evaluated(bars, s))
        # Drawn prices show all but three of the names at least.
        assert len({k[2] for k in got}) >= len(E.PATTERNS) - 3


def test_swings_are_those_of_one_bar_at_a_time(spark):
    bars, lined = _drawn(False, (("a", 600), ("e", 300))), tuple(n for pair in E.NAMES.values() for n in pair)
    got, want = Counter(), Counter()
    for r in D.detected(spark.createDataFrame(bars, SCHEMA), enabled=lined).collect():
        got[r.symbol, r.ts, r.pattern, round(r.line, 6)] += 1
    for symbol in ("a", "e"):
        h, low, c = (np.array([r[k] for r in bars if r[0] == symbol]) for k in (2, 3, 4))
        for t in range(9, len(h)):
            seen = slice(0, t + 1)
            want.update((symbol, t, name, round(line, 6)) for name, line in P.swing_signals(h[seen], low[seen], c[seen], P.Settings()) if line is not None)
    assert got == want and {k[2] for k in want} == set(lined)


def test_long_series_are_cut_and_others_go_through_kernels(spark, monkeypatch):
    bars = spark.createDataFrame(_drawn(True, (("a", 230), (None, 150), ("b", 120))), SCHEMA).cache()
    whole = _rows(D.detected(bars))
    monkeypatch.setattr(D, "WHOLE", 130)
    cut = D.detected(bars, made_of=bars.select("symbol"))
    plan = cut._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "sort_array" in plan
    assert _rows(cut) == whole == _rows(E.evaluated(bars))


def test_choice_of_patterns_and_no_bars(spark):
    bars = spark.createDataFrame(_drawn(True, (("a", 160),)), SCHEMA).cache()
    with pytest.raises(ValueError, match="no such patterns"):
        D.detected(bars, enabled=("double",))
    everything = _rows(D.detected(bars))
    for chosen in (("regime",), ("n_up", "island_reversal_up"), ("near_range_low", "range_breakout", "wedge_rising")):
        assert _rows(D.detected(bars, enabled=chosen)) == Counter({k: n for k, n in everything.items() if k[2] in chosen})
    assert D.detected(bars.limit(0)).count() == 0


def test_no_bar_folds_arrays_or_slides_a_frame(spark, small):
    """both are interpreted anew for every bar, and took most of the query; bars were written and read three times."""
    df = QUERIES["pattern_all"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform(" not in plan and "RowFrame" not in plan
    assert plan.count("FileScan") == 1 and not any("bars-" in f for f in df.inputFiles())
