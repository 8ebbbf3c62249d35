"""Paper accounts: fills folded to positions, cash and profits; risk checks and the comparison with what a strategy believes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.functions.scalars import CONTRACT_UNITS, SHARE_LOT

#: Rates of a paper account.
FEE, TAX, LOT_FEE = 0.001425, 0.003, 50.0


def _units() -> Column:
    """What a quantity of 1 stands for: a share for odd lots, a lot of shares, or a future's contract unit."""
    unit = F.when(F.col("market") == "share", F.when(F.col("kind") == "odd", 1.0).otherwise(float(SHARE_LOT)))
    for code, size in CONTRACT_UNITS.items():
        unit = unit.when(F.upper("symbol").startswith(code), float(size))
    return unit.otherwise(1.0)


def history(fills: DataFrame) -> DataFrame:
    """Each fill with fee, pnl and cash_flow, and the quantity, direction and average price of the position after it.

    fills has account, symbol, ts, seq, market (share or future), kind, opens, buys, quantity, price. Adding to a position averages its price,
    opening the other way replaces it; a close without a position only costs its fee, if that. Positions are signed sums: one fold an
    account and symbol keeps the signed quantity and the average price; all that is money follows from them by columns.
    """
    kinds = {f.name: f.dataType.simpleString() for f in fills.schema.fields}
    schema = ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", _signed long, _average double, _closed long, _basis double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, signed, average = None, 0, 0.0
        for batch in batches:
            keys = zip(batch["account"].to_pylist(), batch["symbol"].to_pylist(), strict=True)
            opens, buys, quantity = (batch[c].to_pylist() for c in ("opens", "buys", "quantity"))
            price = batch["price"].to_numpy(zero_copy_only=False).tolist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, opens_, buys_, n, at in zip(keys, opens, buys, quantity, price, strict=True):
                if key != now:
                    now, signed, average = key, 0, 0.0
                move, basis, closed = n if buys_ else -n, average, 0
                if opens_:
                    kept = signed if signed * move > 0 else 0
                    average = (average * kept + at * move) / (kept + move) if move else average
                    signed = kept + move
                elif signed:
                    closed = min(abs(move), abs(signed)) * (1 if signed > 0 else -1)
                    signed -= closed
                for line, x in zip(out, (signed, average, closed, basis), strict=True):
                    line.append(x)
            new = [pa.array(x, t, from_pandas=True) for x, t in zip(out, (pa.int64(), pa.float64(), pa.int64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "_signed", "_average", "_closed", "_basis"])

    # Accounts are many and short: a task runs through all of its own in order, and no group costs a frame of its own.
    dealt = fills.repartition("account", "symbol").sortWithinPartitions("account", "symbol", F.asc_nulls_last("ts"), F.asc_nulls_last("seq"))
    rows = dealt.mapInArrow(run, schema).withColumn("_unit", _units())
    gross = F.col("price") * F.col("_unit") * F.col("quantity")
    share, side = F.col("market") == "share", F.when(F.col("buys"), -1.0).otherwise(1.0)
    fee = F.when(share, gross * F.when(F.col("buys"), FEE).otherwise(FEE + TAX)).otherwise(LOT_FEE * F.col("quantity"))
    moved = (F.col("price") - F.col("_basis")) * F.col("_unit") * F.col("_closed")
    held = F.col("_signed") != 0
    return rows.select(
        *kinds,
        F.round(fee, 2).alias("fee"),
        F.when(F.col("_closed") != 0, F.round(moved - fee, 2)).otherwise(0.0).alias("pnl"),
        (F.when(share, side * gross).otherwise(F.when(F.col("_closed") != 0, moved).otherwise(0.0)) - fee).alias("cash_flow"),
        F.abs("_signed").alias("held"),
        F.when(held, F.col("_signed") > 0).alias("held_long"),
        F.when(held, F.col("_average")).alias("average"),
    )


def _positions(rows: DataFrame, *sums: Column) -> DataFrame:
    last = rows.groupBy("account", "symbol").agg(F.max_by(F.struct("market", "kind", "held", "held_long", "average"), F.struct("ts", "seq")).alias("p"), *sums)
    return last.select("account", "symbol", "p.*", *(c for c in last.columns if c not in ("account", "symbol", "p")))


def positions(rows: DataFrame) -> DataFrame:
    """account, symbol, market, kind, held, held_long, average of what is still held."""
    return _positions(rows).where("held > 0")


def equity(rows: DataFrame, marks: DataFrame, initial: float = 1_000_000.0) -> DataFrame:
    """account, cash, realized, unrealized, equity; marks has symbol and mark, a symbol without one is worth its average price."""
    sums = [F.sum("cash_flow").alias("_cash"), F.sum("pnl").alias("_pnl")]
    # Positions and sums come from one pass over rows, which may be costly to compute.
    held = _positions(rows, *sums).join(marks, "symbol", "left").withColumn("mark", F.coalesce("mark", "average")).withColumn("unit", _units())
    gain = (F.col("mark") - F.col("average")) * F.when(F.col("held_long"), 1).otherwise(-1) * F.col("unit") * F.col("held")
    worth = F.when(F.col("market") == "share", F.col("mark") * F.col("unit") * F.col("held")).otherwise(gain)
    total = lambda x: F.coalesce(F.sum(F.when(F.col("held") > 0, x)), F.lit(0.0))
    out = held.groupBy("account").agg((F.lit(initial) + F.sum("_cash")).alias("cash"), F.sum("_pnl").alias("realized"), total(gain).alias("unrealized"), total(worth).alias("_worth"))
    return out.select("account", "cash", "realized", "unrealized", (F.col("cash") + F.col("_worth")).alias("equity"))


def realized_on(rows: DataFrame, day: str) -> DataFrame:
    return rows.groupBy("account").agg(F.coalesce(F.sum(F.when(F.to_date("ts") == F.lit(day).cast("date"), F.col("pnl"))), F.lit(0.0)).alias("realized"))


def mismatches(believed: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of believed (account, symbol, state, quantity) whose position differs from the account's, with what it holds."""
    h = held.select("account", "symbol", "held", F.when(F.col("held_long"), "long").otherwise("short").alias("direction"))
    rows = believed.join(h, ["account", "symbol"], "left")
    amount = F.coalesce("held", F.lit(0))
    flat = F.col("state") == "flat"
    wrong = F.when(flat, amount > 0).otherwise((amount != F.col("quantity")) | ~F.coalesce(F.col("direction") == F.col("state"), F.lit(False)))
    return rows.where(wrong)


@dataclass(frozen=True)
class Limits:
    most_a_day: int = 3
    daily_loss: float = 0.0
    cooldown: float = 0.0


def blocked(opens: Column, quantity: Column, trades_today: Column, realized_today: Column, since_open: Column, limits: Limits = Limits()) -> Column:
    """Why an order is held back, or null: limits bind what opens, never what closes; a quantity of 0 is never sent."""
    out = F.when(opens & (trades_today >= limits.most_a_day), "trades a day")
    if limits.daily_loss > 0:
        out = out.when(opens & (realized_today <= -limits.daily_loss), "daily loss")
    if limits.cooldown > 0:
        out = out.when(opens & (since_open < limits.cooldown), "cooling down")
    return out.when(quantity <= 0, "no quantity")
