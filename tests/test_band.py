"""The band strategy of many symbols in one streaming pass."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from barspark.operators import band


def test_band_of_many_symbols_over_small_batches(spark):
    """Symbols meet in one batch and go over several; each is as it is alone, and none is a frame of its own."""
    draw, start, prices, closes = np.random.default_rng(6), dt.datetime(2024, 1, 1), [], []
    for symbol in ("a", "b", None, "c"):
        for day in range(80):
            at = start + dt.timedelta(days=day)
            closes.append((symbol, at.date(), float(draw.integers(5, 40))))
            prices += [(symbol, at + dt.timedelta(hours=12, seconds=int(s)), float(draw.integers(5, 40))) for s in (draw.integers(0, 200), draw.integers(260, 800))]
    daily, intraday = spark.createDataFrame(closes, "symbol string, ts date, close double"), spark.createDataFrame(prices, "symbol string, ts timestamp_ntz, price double")
    b = band.Band(line=20.0, stop=15.0, arm=4.0, step=2.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = band.run(daily, intraday, b)
        assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().toString() and " Join" not in rows._jdf.queryExecution().toString()
        got = sorted(map(tuple, rows.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = []
    for symbol in ("a", "b", None, "c"):
        own = F.col("symbol").eqNullSafe(F.lit(symbol))
        alone += map(tuple, band.run(daily.where(own), intraday.where(own), b).collect())
    assert len(got) > 8 and got == sorted(alone, key=str)
