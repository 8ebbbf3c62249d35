"""Payloads by hand: layouts, odd cells, encodings and archives."""

import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from barspark.sources import payloads as P

DAY = dt.date(2024, 7, 1)


def test_iso_texts_become_utc(spark):
    texts = ["2024-07-01T09:00:00+08:00", "2024-07-01T01:00:00Z", "2024-07-01T01:00:00", "2024-07-01 01:00:00.25", "no date", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.utc(F.col("t"))).collect()
    one = dt.datetime(2024, 7, 1, 1)
    assert [r[0] for r in rows] == [one, one, one, one.replace(microsecond=250000), None, None]


def test_margin_rows_by_label(spark):
    table = {"stat": "OK", "tables": [{"data": [["融資(交易單位)", "1", "2", "3", "5,000", "5,100"], ["融券(交易單位)", "1", "2", "3", "400", "390"], ["融資金額(仟元)", "1", "2", "3", "70", "71"], ["short"]]}, {}]}
    rows = spark.createDataFrame([("113/07/01", json.dumps(table)), ("113/07/02", json.dumps({"stat": "no data"})), ("113/07/03", json.dumps({"stat": "OK"}))], "date string, payload string")
    got = {r["ts"]: tuple(r)[1:] for r in P.margin(rows).collect()}
    assert got[DAY] == (5100, 5000, 390, 400, 71)
    assert set(got) == {DAY, dt.date(2024, 7, 3)} and got[dt.date(2024, 7, 3)] == (0, 0, 0, 0, 0)


def test_cells_keep_separators_within_quotes(spark):
    line = 'a, "1,234" ,,"say ""hi""",z'
    assert spark.createDataFrame([(line,)], "x string").select(P.cells(F.col("x"))).first()[0] == ["a", "1,234", "", 'say "hi"', "z"]


def test_futures_flow_by_position(spark):
    head = ",".join(f"h{k}" for k in range(15))
    row = ["2024/07/01", " 臺股期貨 ", "外資及陸資", *"3456", "-1,200", "8", *"9012", "-33", "44"]
    text = head + "\n" + ",".join(f'"{c}"' for c in row) + "\n" + ",".join(["2024/07/01", "小型臺指期貨", "投信", *["1"] * 12]) + "\nshort,line\n"
    raw = spark.createDataFrame([(bytearray(text.encode("cp950")),)], "content binary")
    texts = raw.select(P.decoded(F.col("content"), P.FLOW_ENCODINGS).alias("text"))
    got = P.futures_flow(texts).collect()
    assert len(got) == 2
    assert tuple(P.futures_flow(texts, ("臺股期貨",)).first()) == (DAY, "臺股期貨", "外資及陸資", -1200, 8, -33, 44)


def test_futures_prices_from_archives_by_header(spark):
    head = "交易日期,契約,到期月份(週別),開盤價,最高價,最低價,收盤價,成交量,交易時段"
    one = "disclaimer\n" + head + "\n2024/07/01,txf,202407 ,100,110,90,105,7,一般\n2024/07/01,TXF,202407,-,-,-,-,0,盤後\nnot a date,TXF,202407,1,1,1,1,1,一般\n"
    two = "契約,交易日期,到期月份(週別),開盤價,最高價,最低價,收盤價,成交量\nMXF,2024/07/01,202408,1,2,0.5,1.5,3\n"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.csv", one.encode("cp950"))
        z.writestr("readme.txt", "no prices")
    files = spark.createDataFrame([("x.zip", bytearray(box.getvalue())), ("y.csv", bytearray(two.encode("utf-8-sig"))), ("z.csv", bytearray(b"<html>error</html>"))], "path string, content binary")
    got = {(r["product"], r["session"]): tuple(r)[2:3] + tuple(r)[4:] for r in P.futures_prices(P.unzipped(files)).collect()}
    assert got == {("TXF", "regular"): ("202407", 100, 110, 90, 105, 7), ("TXF", "after"): ("202407", None, None, None, None, 0), ("MXF", "regular"): ("202408", 1, 2, 0.5, 1.5, 3)}


def test_valuations(spark):
    table = {"stat": "OK", "data": [["2330", "A", "1,000", "2.5", "x", "20.1", "5"], ["0050", "fund", "1", "1", "1", "1", "1"], ["1101", "B", "-", "-", "x", "-", "0.8"], ["9999"]]}
    rows = spark.createDataFrame([(json.dumps(table),)], "payload string")
    assert sorted(map(tuple, P.listed_valuation(rows).collect())) == [("1101", "B", None, None, None, 0.8), ("2330", "A", 1000.0, 2.5, 20.1, 5.0)]
    counter = spark.createDataFrame([("6488", " C ", "1.5", "N/A", "2"), ("006201", "fund", "1", "1", "1")], "SecuritiesCompanyCode string, CompanyName string, YieldRatio string, PriceEarningRatio string, PriceBookRatio string")
    assert list(map(tuple, P.counter_valuation(counter).collect())) == [("6488", "C", None, 1.5, None, 2.0)]


def test_flow_income_equity_and_revenue(spark):
    table = {"data": [["2330", " A ", "1,000", "-200", "5"], ["031234", "warrant", "1", "1", "1"]]}
    rows = spark.createDataFrame([("113/07/01", json.dumps(table))], "date string, payload string")
    assert list(map(tuple, P.stock_flow(rows, (2,), (3,), (4,)).collect())) == [(DAY, "2330", "A", 1000, -200, 5, 805)]
    total = {"data": [["外資及陸資", "x", "7"], ["外資自營商", "x", "1"], ["投信", "x", "-2"]]}
    got = P.market_flow(spark.createDataFrame([("113/07/01", json.dumps(total))], "date string, payload string"), {"foreign_net": ("外資",), "trust_net": ("投信",)}, 2).first()
    assert tuple(got) == (DAY, 8, -2, 6)
    assert tuple(P.income(spark.createDataFrame([("1", "200", "50", "1.5")], "code string, revenue string, gross string, eps string")).first()) == ("1", 1.5, 25.0)
    assert tuple(P.equity(spark.createDataFrame([("1", None, "--", "100", "40")], "code string, total_equity string, parent_equity string, assets string, debts string")).first()) == ("1", 60.0)
    assert tuple(P.monthly_revenue(spark.createDataFrame([("1", "1,000", "2.5", "-3")], "code string, month_revenue string, revenue_mom_pct string, revenue_yoy_pct string")).first()) == ("1", 1000.0, 2.5, -3.0)


def test_the_largest_table_with_the_field(spark):
    payload = {"tables": [{"fields": ["證券代號", "x"], "data": [["1", "a"]]}, {"fields": ["證券代號"], "data": [["2"], ["3"]]}, {"fields": ["other"], "data": [["9"]] * 5}, {}]}
    rows = spark.createDataFrame([(json.dumps(payload),), ("{}",)], "payload string").select(P.largest_table(F.col("payload"), "證券代號")).collect()
    assert [r[0] for r in rows] == [[["2"], ["3"]], None]


def test_daily_prices_and_layout(spark):
    rows = spark.createDataFrame([("113/07/01", " 2330 ", "A", "1,000", "1,010", "990", "1,005", "n/a"), ("113/07/01", "1101", "B", "-", "-", "-", "--", "5")], "d string, c string, n string, o string, h string, l string, z string, v string")
    got = P.daily_prices(rows, {"ts": "d", "code": "c", "name": "n", "open": "o", "high": "h", "low": "l", "close": "z", "volume": "v"}).collect()
    assert list(map(tuple, got)) == [(DAY, "2330", "A", 1000.0, 1010.0, 990.0, 1005.0, 0.0)]
    table = spark.createDataFrame([(["1", "2", "3"],), (["1", "2", "4"],)], "row array<string>")
    assert tuple(P.layout_faults(table, {"sum": (0, 1, 2)}).first()) == (2, 1)
