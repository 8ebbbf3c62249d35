"""Trailing lines of kernels against Spark's frames, to the last bit, over nulls, NaN, short series and batches of a few rows."""

import math
import struct

import numpy as np
import pytest

from barspark.functions import indicators as I
from barspark.functions.trailing import Trailing, dealt, with_trailing
from barspark.queries import QUERIES

FRAMES = {"mean": I.sma, "weighted": I.wma, "deviation": I.stddev, "highest": I.highest, "lowest": I.lowest}


def _bits(row):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else struct.pack("d", x) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("rows", ["4", "10000"])
def test_lines_are_those_of_frames_to_the_last_bit(spark, rows):
    draw, out = np.random.default_rng(3), []
    for symbol, n in (("a", 70), ("b", 3), (None, 40), ("c", 1), ("d", 33)):
        for t in range(n):
            x = float(draw.normal() * 1e3)
            out.append((symbol, t, None if draw.random() < 0.03 else math.nan if symbol == "d" and t == 9 else x))
    bars = spark.createDataFrame(out, "symbol string, ts int, close double")
    wanted = {f"{kind}_{n}": Trailing(kind, "close", n) for kind in FRAMES for n in (2, 5, 17)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        got = {(r.symbol, r.ts): _bits(r) for r in with_trailing(dealt(bars), wanted).select("symbol", "ts", *wanted).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.symbol, r.ts): _bits(r) for r in bars.select("symbol", "ts", *(FRAMES[t.kind]("close", t.n).alias(n) for n, t in wanted.items())).collect()}
    assert len(got) == len(out) and got == want
    assert with_trailing(dealt(bars.limit(0)), wanted).count() == 0


def test_unknown_lines_and_windows_without_bars():
    with pytest.raises(ValueError, match="unknown line"):
        Trailing("median", "close", 5)
    with pytest.raises(ValueError, match="a bar at least"):
        Trailing("mean", "close", 0)


@pytest.mark.parametrize("name", ["ind_multi_ma", "ind_window"])
def test_no_frame_slides_over_rows(spark, small, name):
    """A frame adds up its window anew for every bar: 455 additions a bar in six averages."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(f"RowFrame, -{n}, currentrow$" in plan for n in (4, 9, 13, 19, 59, 119, 239))
