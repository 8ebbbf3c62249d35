"""Recurrences of bounded series as kernels, against the folds over blocks in the JVM."""

import math
import struct

import numpy as np
import pytest

from barspark.functions import recurrence as R
from barspark.functions import scan as S
from barspark.functions.scan import Scan, with_scans
from barspark.queries import QUERIES

SCANS = [Scan("jae", (14, 9, 3, 3, 60)), Scan("kdj", (9, 3, 3)), Scan("kdj", (5, 1, 2)), Scan("dmi", (14,)), Scan("rsi", (6,)), Scan("ema", (20,)), Scan("macd", (12, 26, 9)), Scan("ema", (3,), "volume")]
OUTPUTS = list(dict.fromkeys(o for s in SCANS for o in s.outputs))


def _bits(row, *columns):
    return tuple(None if row[c] is None else struct.pack("d", row[c] + 0.0) for c in columns)


def _drawn(gaps):
    draw, out = np.random.default_rng(7), []
    for symbol, n in (("a", 90), ("b", 5), (None, 60), ("c", 1), ("d", 70)):
        close = 100 + draw.normal(size=n).cumsum().round(2)
        for t in range(n):
            flat = symbol == "d" and 20 <= t < 45  # bars without width
            x = 50.0 if flat else float(close[t])
            hole = None if t % 2 else math.nan
            out.append((symbol, t, x if flat else x + 1.5, x if flat else x - 0.25, hole if gaps and draw.random() < 0.1 else x, None if t % 9 == 4 else t % 5, "x"))
    return out


@pytest.mark.parametrize("rows", ["7", "10000"])
def test_kernels_are_the_folds_of_blocks(spark, rows):
    """to the last bit, but behind gaps, where the two platforms' powers may differ in it."""
    for gaps in (False, True):
        drawn = _drawn(gaps)
        bars = spark.createDataFrame(drawn, "symbol string, ts int, high double, low double, close double, volume int, note string")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = with_scans(bars, SCANS)
            assert got.columns == [*bars.columns, *OUTPUTS]
            got = {(r.symbol, r.ts): r for r in got.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        want = {(r.symbol, r.ts): r for r in S._in_blocks(bars, SCANS, "symbol", "ts").collect()}
        assert len(got) == len(drawn) and got.keys() == want.keys()
        exact = [o for o in OUTPUTS if not o.startswith("ema_3_volume")]
        for k, mine in got.items():
            if not gaps:
                assert _bits(mine, *exact) == _bits(want[k], *exact), k
            for o in OUTPUTS:
                assert (mine[o] is None) == (want[k][o] is None), (k, o)
                assert mine[o] is None or math.isclose(mine[o], want[k][o], rel_tol=1e-12, abs_tol=1e-12), (k, o)


def test_long_series_are_cut_and_short_ones_held_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 62)
    drawn = _drawn(False)
    bars = spark.createDataFrame(drawn, "symbol string, ts int, high double, low double, close double, volume int, note string")
    rows = with_scans(bars, SCANS[:1])
    assert sorted(map(str, rows.select(*bars.columns).collect())) == sorted(map(str, bars.collect()))
    want = {(r.symbol, r.ts): r for r in S._in_blocks(bars, SCANS[:1], "symbol", "ts").collect()}
    for r in rows.collect():
        for o in SCANS[0].outputs:
            assert r[o] == (want[r.symbol, r.ts][o] if r[o] is None else pytest.approx(want[r.symbol, r.ts][o], rel=1e-9)), (r, o)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" in plan  # a and d are cut, the others not


@pytest.mark.parametrize("name", ["ind_jae_trend", "ind_rsi_wilder", "ind_kdj", "ind_dmi", "cond_kd"])
def test_no_array_is_folded_bar_by_bar(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan and "collect_list" not in plan


def test_bars_are_counted_only_where_their_rows_may_be_a_long_series(spark, monkeypatch):
    """counting bars makes them once more; that a series is short is often told by the rows that bars are made from."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(R, "BLOCK", 10)
    rows = spark.createDataFrame([(s, t) for s, n, days in (("many", 40, 5), ("few", 8, 8), (None, 30, 30), ("long", 12, 12)) for t in [k % days for k in range(n)]], "symbol string, ts int")
    bars = rows.distinct()
    found = {r.symbol: r._n for r in R.long_series(bars, "symbol", rows.select("symbol")).collect()}
    assert found == {None: 30, "long": 12} == {r.symbol: r._n for r in R.long_series(bars, "symbol").collect()}
    unmade = bars.where(F.raise_error(F.lit("bars are made")).isNull())
    assert R.long_series(unmade, "symbol", rows.where("symbol = 'few'").select("symbol")).isEmpty()
    with pytest.raises(Exception, match="bars are made"):
        R.long_series(unmade, "symbol")
