"""Views of the star schema as market data: ticks, daily bars, fundamentals and institutional flow.

Each view is a plain DataFrame expression, so filters and column choices of a query reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(price: Column, order: Column, volume: Column) -> list[Column]:
    """First, highest, lowest and last price and summed volume; order must be total within a group."""
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
    ]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, day, price, quantity, flags and a total order of each line item.

    The order is that of (l_orderkey, l_linenumber), the table's key, as one number of fixed width, which a hash aggregation can hold; rows that
    repeat a key go by a hash of the rest.
    """
    rest = F.pmod(F.xxhash64("l_partkey", "l_extendedprice", "l_quantity"), F.lit(1_000_000_000))
    digits = lambda c, n: F.coalesce(F.col(c), F.lit(0)).cast(f"decimal({n},0)")
    order = digits("l_orderkey", 19) * F.lit(str(10**19)).cast("decimal(20,0)") + (digits("l_linenumber", 10) * F.lit(10**9).cast("decimal(10,0)")) + rest.cast("decimal(10,0)")
    order = order.cast("decimal(38,0)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("quantity"),
        "l_returnflag",
        "l_linestatus",
        order.alias("ord"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts (a date), open, high, low, close, volume: a bar a day for each supplier.

    Trades are summed to bars before they are shuffled, so what moves are at most a bar for each task, symbol and day; a symbol with
    very many trades is no hot key. Windows over a symbol then deal bars, not trades.
    """
    return trades(spark, sf_dir).groupBy("symbol", "ts").agg(*ohlcv(F.col("price"), F.col("ord"), F.col("quantity")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, price, size, event_id, user_id of each event."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id", "user_id"
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, industry, pe, pb, yield_pct, eps of each supplier; ratios are functions of its balance, some null."""
    acct = F.col("s_acctbal")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("code"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("industry"),
            F.when(acct > 0, acct / 400).alias("pe"),
            (F.abs(acct) / 2500).alias("pb"),
            F.when(F.col("s_suppkey") % 7 != 0, F.abs(acct) / 2000).alias("yield_pct"),
            (acct / 1000).alias("eps"),
        )
    )


def stock_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, foreign_net, trust_net, dealer_net, inst_total, from the flags of line items."""
    q = F.col("quantity")
    return (
        trades(spark, sf_dir)
        .groupBy("symbol", "ts")
        .agg(
            F.sum(F.when(F.col("l_returnflag") == "A", q).when(F.col("l_returnflag") == "R", -q).otherwise(0.0)).cast("long").alias("foreign_net"),
            F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(-q)).cast("long").alias("trust_net"),
            F.sum(F.when(F.col("l_returnflag") == "N", q).otherwise(0.0)).cast("long").alias("dealer_net"),
        )
        .withColumn("inst_total", F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net"))
    )


def market_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, margin_balance, short_balance: running totals of orders by status. One row a day, so one window is no bottleneck."""
    from pyspark.sql import Window

    status = F.col("o_orderstatus")
    price = F.floor("o_totalprice")
    per_day = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(
        F.sum(F.when(status == "O", price).when(status == "F", -price).otherwise(0)).cast("long").alias("margin_delta"),
        F.sum(F.when(status == "P", price).otherwise(0)).cast("long").alias("short_delta"),
    )
    upto = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return per_day.select("ts", F.sum("margin_delta").over(upto).alias("margin_balance"), F.sum("short_delta").over(upto).alias("short_balance"))


INVESTORS = ("foreign", "trust", "dealer")


def futures_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, product, investor, net_oi in long form, from events by type and user."""
    return table(spark, sf_dir, "events").groupBy(
        F.to_date("ts").alias("ts"),
        F.col("event_type").alias("product"),
        F.element_at(F.array(*map(F.lit, INVESTORS)), (F.col("user_id") % 3 + 1).cast("int")).alias("investor"),
    ).agg(F.sum(F.floor(F.col("value")) - 50).cast("long").alias("net_oi"))


def futures_by_investor(flow: DataFrame, product: str) -> DataFrame:
    """ts, fut_foreign_oi, fut_trust_oi, fut_dealer_oi of one product: the long form pivoted, a day without an investor null."""
    wide = flow.where(F.col("product") == product).groupBy("ts").pivot("investor", list(INVESTORS)).agg(F.sum("net_oi"))
    return wide.select("ts", *(F.col(i).alias(f"fut_{i}_oi") for i in INVESTORS))


def raw_futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, product, month (YYYYMM), session (regular or after), open, high, low, close, volume, from events."""
    day = F.to_date("ts")
    month = F.date_format(F.add_months(day, (F.col("user_id") % 3).cast("int")), "yyyyMM")
    session = F.when(F.hour("ts") < 14, "regular").otherwise("after")
    rows = table(spark, sf_dir, "events").select(day.alias("day"), F.col("event_type").alias("product"), month.alias("month"), session.alias("session"), F.col("value").alias("price"), F.struct("ts", "event_id").alias("ord"))
    return rows.groupBy(F.col("day").alias("ts"), "product", "month", "session").agg(*ohlcv(F.col("price"), F.col("ord"), F.lit(1.0)))
