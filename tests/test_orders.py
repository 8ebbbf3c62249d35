"""Orders from intents, by hand."""

import pytest

from barspark.operators import orders


def one(spark, **fields):
    base = {"symbol": "2330", "buys": True, "quantity": 1, "price": 600.0, "kind": None, "price_type": None, "exec_price": None, "ticks": None, "broker": None, "account": None} | fields
    schema = "symbol string, buys boolean, quantity double, price double, kind string, price_type string, exec_price double, ticks int, broker string, account string"
    row = tuple(float(v) if k in ("quantity", "price", "exec_price") and v is not None else v for k, v in base.items())
    return orders.orders(spark.createDataFrame([row], schema)).first()


@pytest.mark.parametrize(
    ("fields", "price", "limit", "tick", "label"),
    [
        ({}, 602.0, 602.0, 1.0, "limit 602"),
        ({"buys": False}, 598.0, 598.0, 1.0, "limit 598"),
        ({"price": 600.4, "ticks": 0}, 600.0, 600.0, 1.0, "limit 600"),
        ({"price": 23.37, "ticks": 1}, 23.4, 23.4, 0.05, "limit 23.4"),
        ({"price": 9.99, "ticks": 1}, 10.0, 10.0, 0.01, "limit 10"),
        ({"symbol": "0050", "price": 130.0, "ticks": 1}, 130.05, 130.05, 0.05, "limit 130.05"),
        ({"price": 10.0, "exec_price": 600.0}, 602.0, 602.0, 1.0, "limit 602"),
        ({"price_type": "market"}, 0.0, 602.0, 1.0, "market"),
        ({"price_type": "range"}, 602.0, 602.0, 1.0, "limit 602"),
        ({"kind": "odd", "price_type": "market"}, 602.0, 602.0, 1.0, "limit 602"),
        ({"symbol": "txfr1", "price": 17000.0, "price_type": "range"}, 0.0, 17002.0, 1.0, "range"),
        ({"symbol": "TXFR1", "price": 1234567.0, "ticks": 0}, 1234567.0, 1234567.0, 1.0, "limit 1234567"),
        ({"price": None}, None, None, None, "limit"),
        ({"price": None, "price_type": "market"}, 0.0, None, None, "market"),
    ],
)
def test_prices(spark, fields, price, limit, tick, label):
    row = one(spark, **fields)
    assert (row.price, row.limit_price, row.tick, row.label) == (price, limit, tick, label)


def test_texts(spark):
    row = one(spark, broker=" x ", account="", quantity=3.7)
    assert (row.text, row.target, row.account, row.quantity) == ("buy 2330 3 (share) limit 602", "x / default account", None, 3)
    row = one(spark, symbol=None, buys=None, quantity=None, kind="odd", broker=" ", account="7")
    assert (row.text, row.target, row.lot) == ("? ? 0 (odd) limit 598", "default / 7", "odd")


def test_columns_that_are_missing_or_more(spark):
    rows = spark.createDataFrame([("1101", True, 1, 40.0, "a")] * 2, "symbol string, buys boolean, quantity int, price double, note string")
    out = orders.orders(rows)
    assert [(r.note, r.price) for r in out.collect()] == [("a", 40.1)] * 2
    assert orders.orders(rows.limit(0)).count() == 0
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
