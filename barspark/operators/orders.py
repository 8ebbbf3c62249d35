"""Orders from intents: the price that is sent, aligned to a legal step, and the rules of an exchange that hold for every broker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import is_future_symbol, tick_size

#: Kinds of trades, types of prices, and what an order says that a strategy does not choose.
KINDS = ("share", "odd", "future")
PRICE_TYPES = ("limit", "market", "range")
FUTURE_PRICE_TYPES = ("range",)
TIME_IN_FORCE = "ROD"
CONDITION = "cash"
TICKS = 2
DEFAULT_BROKER = "default"


def _said(text: Column) -> Column:
    """A text without the white space around it; null if nothing is left."""
    plain = F.trim(text)
    return F.when(plain != "", plain)


def kind_of(kind: Column, symbol: Column) -> Column:
    """The kind a strategy names; where it names none that there is, that of its symbol."""
    return F.when(kind.isin(*KINDS), kind).when(F.coalesce(is_future_symbol(symbol), F.lit(False)), "future").otherwise("share")


def price_type_of(kind: Column, price_type: Column) -> Column:
    """Odd lots are limit orders; a range is for futures only; what is not known is a limit."""
    legal = price_type.isin(*PRICE_TYPES) & (kind != "odd") & (~price_type.isin(*FUTURE_PRICE_TYPES) | (kind == "future"))
    return F.when(legal, price_type).otherwise("limit")


def conceded(price: Column, buys: Column, ticks: Column, tick: Column) -> Column:
    """A price moved by whole ticks to where it rather fills, up for a buy and down for a sale, on a multiple of the tick."""
    moved = price + F.when(buys, ticks).otherwise(-ticks) * tick
    return F.bround(F.rint(moved / tick) * tick, 4)


def plain(number: Column) -> Column:
    """A number as text, of four places at most and without zeros at the end."""
    return F.when(number.isNotNull(), F.regexp_replace(F.format_string("%.4f", number), r"\.?0+$", ""))


def orders(intents: DataFrame) -> DataFrame:
    """intents with an order each: symbol, kind, price_type, price, limit_price, tick, time_in_force, lot, condition, label, broker, account, text, target.

    intents has symbol, buys (boolean), quantity and price; exec_price (of the instrument that is traded, where it is not the one watched),
    kind, price_type, ticks (of concession), broker and account may be missing or null. price is what is sent, 0 unless it is a limit, and
    limit_price what a limit would be. The tick is that of the price before it is moved. An account that is not said stays null, which is
    the broker's own choice. A null side is priced as a sale and told as `?`. A row without price has neither limit_price nor, for limits, price; its label tells the type only. Columns of
    other names are kept as they are, repeated rows as well; an empty table gives none. No rows move.
    """
    given = lambda name, type_: F.col(name) if name in intents.columns else F.lit(None).cast(type_)
    symbol = F.upper(F.trim(F.col("symbol").cast("string")))
    rows = intents.withColumns({"symbol": symbol, "quantity": F.floor("quantity").cast("long"), "kind": kind_of(given("kind", "string"), symbol), "_base": F.coalesce(given("exec_price", "double"), F.col("price")).cast("double")})
    rows = rows.withColumns({"price_type": price_type_of(F.col("kind"), given("price_type", "string")), "tick": F.when(F.col("kind") == "future", 1.0).otherwise(tick_size(F.col("_base"), "stock", F.col("symbol")))})
    ticks = F.coalesce(given("ticks", "int"), F.lit(TICKS))
    rows = rows.withColumns({"tick": F.when(F.col("_base").isNotNull(), F.col("tick")), "limit_price": conceded(F.col("_base"), F.coalesce("buys", F.lit(False)), ticks, F.col("tick"))})
    limit = F.col("price_type") == "limit"
    rows = rows.withColumns(
        {
            "price": F.when(limit, F.col("limit_price")).otherwise(0.0),
            "time_in_force": F.lit(TIME_IN_FORCE),
            "lot": F.when(F.col("kind") == "odd", "odd").otherwise("common"),
            "condition": F.lit(CONDITION),
            "label": F.when(limit, F.concat(F.lit("limit"), F.coalesce(F.concat(F.lit(" "), plain(F.col("limit_price"))), F.lit("")))).otherwise(F.col("price_type")),
            "broker": F.coalesce(_said(given("broker", "string")), F.lit(DEFAULT_BROKER)),
            "account": _said(given("account", "string")),
        }
    )
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    side = F.when(F.col("buys"), "buy").when(~F.col("buys"), "sell").otherwise("?")
    text = F.concat(side, F.lit(" "), told("symbol"), F.lit(" "), F.coalesce(F.col("quantity").cast("string"), F.lit("0")), F.lit(" ("), F.col("kind"), F.lit(") "), F.col("label"))
    target = F.concat(F.col("broker"), F.lit(" / "), F.coalesce("account", F.lit("default account")))
    return rows.withColumns({"text": text, "target": target}).drop("_base")
