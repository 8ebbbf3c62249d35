"""The last swings of every bar's window, from runs that are folded once a series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions import recurrence as R
from barspark.operators import evaluate as E
from barspark.operators import patterns as P


@pytest.mark.parametrize("size, last", [(60, E.NEAR), (90, E.FAR)])
def test_last_swings_of_every_window(spark, size, last):
    draw = np.random.default_rng(8)
    # Few different prices, so that neighbours of one kind are often equal.
    high, low = draw.integers(5, 9, 220).astype(float), draw.integers(1, 5, 220).astype(float)
    bars = pd.DataFrame({"symbol": "a", "ts": np.arange(220), "high": high, "low": low, "close": (high + low) / 2})
    blocks = E._candidates(R.blocks_of(spark.createDataFrame(bars), "symbol", "ts", ["high", "low", "close"], 89), 3)
    (row,) = blocks.rows.select(F.transform(F.sequence(F.lit(0), F.lit(219)), lambda t: E._swings(t, size, 3, last)).alias("s")).collect()
    for t, got in enumerate(row.s):
        first = max(t - size + 1, 0)
        want = P.swings(high[first : t + 1], low[first : t + 1], 3)[-last:]
        assert [(x.i - first, x.k, x.p) for x in got] == want
