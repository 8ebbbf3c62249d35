"""Bars in SQLite files, and differences of tables."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from barspark.operators import difference as D
from barspark.sources import sqlite as Q


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("bars"))
    rows = [(s, "share", "day", dt.datetime(2024, 1, 1) + dt.timedelta(days=k), 1.0 + k, 2.0 + k, 0.5, 1.5 + k, None if k == 3 else 10.0) for s in ("a", "b", "c") for k in range(40)]
    rows += [("a", "share", "day", dt.datetime(2024, 1, 5), 9.0, 9.0, 9.0, 9.0, 9.0), (None, "share", "day", dt.datetime(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, Q.SCHEMA)
    assert Q.write_sqlite(df, where, 3) == 120
    return where


def test_ranges_columns_and_filters(spark, stored):
    rows = Q.sqlite_bars(spark, stored, rows_per_task=15)
    assert rows.count() == 120 and rows.rdd.getNumPartitions() >= 8
    assert rows.where("symbol = 'a' AND ts = timestamp_ntz'2024-01-05'").collect()[0].close == 9.0
    assert rows.where("ts = timestamp_ntz'2024-01-04'").agg(F.sum("volume")).first()[0] == 0.0
    picked = Q.sqlite_bars(spark, stored, ["symbol", "ts", "close"]).where("symbol IN ('a', 'b') AND ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-20'")
    assert picked.count() == 20
    assert picked.columns == ["symbol", "ts", "close"]
    # What is answered in the files is not filtered again: the plan keeps the bounds of ts only.
    plan = Q.sqlite_bars(spark, stored).where("symbol = 'b' AND timeframe = 'day'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("isnotnull", "") or "symbol" not in plan.split("Filter", 1)[1].split("\n")[0].replace("isnotnull(symbol", "")


def test_what_a_reader_asks_of_a_file():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull
    from pyspark.sql.types import StructType

    reader = Q._Reader(StructType.fromDDL(Q.SCHEMA), {"path": "/nowhere"})
    pushed = [EqualTo(("symbol",), "a"), In(("timeframe",), ("day", "hour")), GreaterThanOrEqual(("ts",), dt.datetime(2024, 3, 1)), IsNotNull(("close",))]
    assert list(reader.pushFilters(pushed)) == pushed[2:]
    assert reader.clauses == ["symbol = ?", "timeframe IN (?, ?)", "ts >= ?"] and reader.values == ["a", "day", "hour", "2024-02-29"]
    with pytest.raises(ValueError, match="no such columns"):
        Q._Reader(StructType.fromDDL("symbol string, other int"), {"path": "/nowhere"})


def test_probe_and_faulty_files(spark, stored, tmp_path):
    found = Q.probe(spark, stored).collect()
    assert len(found) == 3 and all(r.readonly and r.schema_version > 0 and r.data_version > 0 for r in found)
    assert sum(r.bars for r in found) == 120 and min(r.first_ts for r in found) == "2024-01-01T00:00:00"
    (tmp_path / "none").mkdir()
    assert Q.sqlite_bars(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        Q.files(str(tmp_path / "missing"))
    db = sqlite3.connect(tmp_path / "bad.db")
    db.execute(Q.CREATE)
    db.execute("INSERT INTO kbars VALUES ('a', 'share', 'day', '2024-01-01', 1, 1, 1, 'high', 1)")
    db.commit()
    db.close()
    with pytest.raises(Exception, match="close is a number"):
        Q.sqlite_bars(spark, str(tmp_path / "bad.db")).count()
    assert Q.sqlite_bars(spark, str(tmp_path / "bad.db"), ["symbol", "ts"]).count() == 1


def found(df):
    return [(r.key, r.column, r.kind) for r in df.collect()]


def test_planted_differences_and_only_their_buckets(spark):
    a = spark.range(5000).selectExpr("id", "id * 0.1 AS x", "cast(id % 7 AS string) AS s", "array(id, null) AS l")
    b = a.where("id <> 17").withColumn("x", F.when(F.col("id") == 40, 0.0).otherwise(F.col("x") + 1e-12)).withColumn("s", F.when(F.col("id") == 41, None).otherwise(F.col("s")))
    b = b.union(spark.range(9000, 9001).selectExpr("id", "0.0", "'z'", "array(id, null)"))
    assert found(D.differences(a, b, ["id"])) == [('["17"]', None, "missing"), ('["40"]', "x", "changed"), ('["41"]', "s", "changed"), ('["9000"]', None, "unexpected")]
    wrong = D.differing_buckets(a, b, ["id"], {"x": ["x"], "rest": ["s", "l"]}, 4096).collect()
    assert len(wrong) == 4 and sum(r.groups == ["x"] for r in wrong) == 1 and sum(r.groups == ["rest"] for r in wrong) == 1
    assert found(D.differences(a, a, ["id"])) == []
    assert len(found(D.differences(a, a.withColumn("s", F.lit("q")), ["id"], most=5))) == 5
    plan = D.differences(a, b, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan


def test_repeated_keys_odd_numbers_other_columns_and_empty_tables(spark):
    rows = [(1, float("nan")), (1, float("inf")), (None, None), (2, -0.0), (3, 1.0)]
    a = spark.createDataFrame(rows, "k long, x double")
    b = spark.createDataFrame([rows[k] for k in (4, 1, 0, 2)] + [(2, 0.0)], "k long, x double")
    assert found(D.differences(a, b, ["k"])) == []
    assert found(D.differences(a, b.union(b.limit(1)), ["k"])) == [('["3"]', None, "unexpected")]
    assert found(D.differences(a.limit(0), b.limit(0), ["k"])) == []
    assert found(D.differences(a.withColumn("more", F.lit(1)), b.withColumn("bucket", F.lit(1)), ["k"])) == [("[]", "bucket", "unexpected"), ("[]", "more", "missing")]


def test_files_have_a_bound_and_keys_stay_whole(spark, tmp_path):
    """a task writes file after file of at most so many bars; a key that repeats across the bound stays one bar."""
    rows = [("A", "share", "day", dt.datetime(2020, 1, 1) + dt.timedelta(k // 2), 1.0, 2.0, 0.5, float(k), 1.0) for k in range(46)]
    df = spark.createDataFrame(rows, Q.SCHEMA)
    where = str(tmp_path / "bounded")
    assert Q.write_sqlite(df, where, 1, rows_per_file=5) == 23
    found = Q.probe(spark, where).collect()
    assert len(found) > 3 and max(r["bars"] for r in found) <= 5 and sum(r["bars"] for r in found) == 23
    assert sorted(r["close"] for r in Q.sqlite_bars(spark, where).collect()) == [float(k) for k in range(1, 46, 2)]
