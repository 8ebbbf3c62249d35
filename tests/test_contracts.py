"""Series of futures: forming, storing, loading and putting them before another source, on hand-made rows."""

import datetime as dt
import os

import pytest

from barspark.sources import contracts

RAW = "ts date, product string, month string, session string, open double, high double, low double, close double, volume double"
BARS = "symbol string, ts date, open double, high double, low double, close double, volume double"
D = dt.date


@pytest.fixture(scope="module")
def raw(spark):
    day, late = D(2024, 1, 2), D(2024, 1, 3)
    return spark.createDataFrame(
        [
            (day, "tx ", "202401", "regular", 10.0, 12.0, 9.0, 11.0, 5.0),
            (day, "tx ", "202401", "after", 8.0, 13.0, 7.0, 9.0, 2.0),
            (day, "tx ", "202402", "regular", 20.0, None, None, 21.0, None),
            (day, "tx ", "202401W1", "regular", 1.0, 1.0, 1.0, 1.0, 1.0),
            (late, "tx ", "202402", "after", 30.0, 31.0, 29.0, 30.5, 1.0),
            (late, "tx ", "202403", "regular", None, None, None, None, None),
            (None, "tx ", "202403", "regular", 1.0, 1.0, 1.0, 1.0, 1.0),
            (late, None, "202403", "regular", 1.0, 1.0, 1.0, 1.0, 1.0),
        ],
        RAW,
    )


def told(df):
    return {tuple(r[c] for c in (*contracts.KEY, "ts")): (r.open, r.high, r.low, r.close, r.volume) for r in df.collect()}


def test_series_by_hand(raw):
    day, late = D(2024, 1, 2), D(2024, 1, 3)
    second = (20.0, 21.0, 20.0, 21.0, 0.0)
    assert told(contracts.contract_bars(raw)) == {
        ("TX", "all", 1, day): (8.0, 13.0, 7.0, 11.0, 7.0),
        ("TX", "day", 1, day): (10.0, 12.0, 9.0, 11.0, 5.0),
        **{("TX", s, r, day): second for s in ("all", "day") for r in (2, 3)},
        ("TX", "all", 1, late): (30.0, 31.0, 29.0, 30.5, 1.0),
    }
    assert contracts.contract_bars(raw.limit(0)).count() == 0


def test_all_series_in_one_shuffle(raw):
    plan = contracts.contract_bars(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_store_replaces_series_only(spark, raw, tmp_path):
    store = contracts.ContractStore(spark, str(tmp_path / "series"))
    assert store.load("tx").columns == ["ts", *contracts.PRICES, "volume"] and not store.has("tx")
    series = contracts.contract_bars(raw)
    store.save(series)
    before = told(store.read())
    store.save(series.where("session = 'day' and rank = 2").selectExpr("product", "session", "rank", "ts + interval 9 day as ts", "open", "high", "low", "close + 1 as close", "volume"))
    after = told(store.read())
    assert {k: v for k, v in after.items() if k[1:3] != ("day", 2)} == {k: v for k, v in before.items() if k[1:3] != ("day", 2)}
    assert [r.ts for r in store.load("TX", "day", 2).collect()] == [D(2024, 1, 11)]
    assert store.has(" tx", "day", 3) and not store.has("tx", "day", 9) and not store.has("te")


def test_merge_prefers_new_days(spark, raw, tmp_path):
    store = contracts.ContractStore(spark, str(tmp_path / "series"))
    series = contracts.contract_bars(raw, ranks=(1,), sessions=("all",))
    store.merge(series)
    again = series.where("ts = date'2024-01-03'").selectExpr("product", "session", "rank", "ts", "open", "high", "low", "close + 1 as close", "volume")
    store.merge(again.union(again).union(again.selectExpr("product", "session", "rank", "ts + interval 1 day", "open", "high", "low", "close", "volume")))
    assert [(r.ts.day, r.close) for r in store.load("tx").collect()] == [(2, 11.0), (3, 31.5), (4, 31.5)]
    assert not os.listdir(str(tmp_path / "series__staging"))


def test_only_the_series_is_read(spark, raw, tmp_path):
    store = contracts.ContractStore(spark, str(tmp_path / "series"))
    store.save(contracts.contract_bars(raw))
    scan = store.load("tx", "day", 2)._jdf.queryExecution().executedPlan().toString()
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(c in filters for c in contracts.KEY)


def test_extension(spark):
    monday = D(2024, 1, 1)
    days = [("a", monday + dt.timedelta(k), float(k), k + 2.0, k - 2.0, k + 1.0, 1.0) for k in range(14)]
    days[0] = ("a", monday, None, 2.0, -2.0, 1.0, None)  # an open that is not known, and no volume
    daily = spark.createDataFrame([*days, ("b", monday, None, 1.0, 1.0, 1.0, 1.0)], BARS)
    own = spark.createDataFrame([("a", D(2024, 1, 8), 100.0, 101.0, 99.0, 100.0, 3.0)], BARS)
    rows = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in contracts.extended(own, daily, "week").collect()}
    # The week that own has in part is own's; b's only week has no open and is left out.
    assert rows == {("a", monday): (1.0, 8.0, -2.0, 7.0, 6.0), ("a", D(2024, 1, 8)): (100.0, 101.0, 99.0, 100.0, 3.0)}
    assert contracts.extended(own, daily, "5m").collect() == own.collect()
    alone = contracts.extended(own.limit(0), daily, "month").collect()
    assert [(r.symbol, r.ts, r.close, r.volume) for r in alone] == [("a", monday, 14.0, 13.0)]
    assert contracts.extended(own, daily.limit(0), "day").collect() == own.collect()
