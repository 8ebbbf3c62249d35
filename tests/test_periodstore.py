"""Rows by month or year, and the requests that a range takes."""

import datetime as dt
import os

import pytest

from barspark.sources import barstore
from barspark.sources.periodstore import PeriodStore

SCHEMA = "code string, ts date, `a.b` long"
D = dt.date


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return PeriodStore(spark, str(tmp_path / "flow"), SCHEMA, ["code"])


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_nothing_saved(store):
    assert store.range("2024-01-01", "2024-12-31").count() == 0 and store.days().count() == 0


def test_new_rows_replace_and_other_months_stay(spark, store):
    store.save(rows(spark, ("a", D(2024, 1, 31), 1), ("a", D(2024, 2, 1), 2), (None, D(2024, 2, 1), 3), ("a", None, 9)))
    january = sorted(os.listdir(store.path + "/_period=202401"))
    store.save(rows(spark, ("a", D(2024, 2, 1), 5), ("a", D(2024, 2, 1), 4), ("b", D(2024, 2, 29), None), (None, D(2024, 2, 1), 8)))
    assert told(store.range()) == told(rows(spark, ("a", D(2024, 1, 31), 1), ("a", D(2024, 2, 1), 5), (None, D(2024, 2, 1), 8), ("b", D(2024, 2, 29), None)))
    assert sorted(os.listdir(store.path + "/_period=202401")) == january
    assert not os.listdir(store.path + "__staging")
    store.save(rows(spark).limit(0))
    assert store.range().count() == 4


def test_ranges_are_inclusive_and_prune(spark, store):
    store.save(rows(spark, *(("a", D(2023, m, 15), m) for m in range(1, 13)), ("a", D(2024, 1, 15), 13)))
    found = store.range("2023-11-15", "2024-01-15")
    assert [r["a.b"] for r in found.orderBy("ts").collect()] == [11, 12, 13]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_period" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert store.range("2024-01-15", "2023-11-15").count() == 0
    assert [r.ts for r in store.days("2023-12-01").orderBy("ts").collect()] == [D(2023, 12, 15), D(2024, 1, 15)]


def test_years(spark, tmp_path):
    store = PeriodStore(spark, str(tmp_path / "futures"), SCHEMA, ["code"], by="year")
    store.save(rows(spark, ("x", D(2022, 12, 31), 1), ("x", D(2023, 1, 1), 2), ("x", D(2024, 1, 1), 3)))
    assert sorted(x for x in os.listdir(store.path) if "=" in x) == ["_period=2022", "_period=2023", "_period=2024"]
    assert [r["a.b"] for r in store.range("2022-06-01", "2023-06-01").orderBy("ts").collect()] == [1, 2]


def test_requests(spark):
    plans = {("5m", 10): None, ("5m", 11): (10, 5, 2), ("1h", 21): (10, 5, 3), ("day", 90): None, ("week", 91): (90, 30, 2), ("?", 181): (90, 30, 3), ("day", 0): None, ("5m", -3): None}
    assert {k: barstore.chunk_plan(*k) for k in plans} == plans
    found = [tuple(r) for r in barstore.planned(spark, "15m", "2024-01-01", "2024-01-21").collect()]
    assert found == [(D(2024, 1, 1), D(2024, 1, 10)), (D(2024, 1, 11), D(2024, 1, 20)), (D(2024, 1, 21), D(2024, 1, 21))]
    assert len(found) == barstore.chunk_plan("15m", 21)[2]
    assert [tuple(r) for r in barstore.planned(spark, "day", "2024-01-01", "2024-01-21").collect()] == [(D(2024, 1, 1), D(2024, 1, 21))]
    assert barstore.planned(spark, "day", "2024-01-02", "2024-01-01").count() == 0


def test_upsert_leaves_no_staging(spark, tmp_path):
    bars = spark.createDataFrame([("a", "share", "day", D(2024, 1, 1), 1.0)], "symbol string, asset_type string, timeframe string, ts date, close double")
    store = barstore.BarStore(spark, str(tmp_path / "bars"))
    store.create(bars)
    store.upsert(bars.selectExpr("symbol", "asset_type", "timeframe", "ts", "close + 1 as close"))
    assert [r.close for r in store.read().collect()] == [2.0] and not os.listdir(str(tmp_path / "bars__staging"))
