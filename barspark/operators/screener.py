"""Market-wide screens, and portfolios that a screen rebalances."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.scalars import SHARE_LOT, Costs, round_trip_cost
from barspark.plans.compiler import Spec, combined, with_conditions

#: Fields of fundamental conditions: (field, at_least or at_most, value).
Fundamental = tuple[str, str, float]

PRESETS: dict[str, dict] = {
    "value": {"fundamental": [("pe", "at_most", 15.0), ("pb", "at_most", 1.5), ("yield_pct", "at_least", 4.0)], "technical": []},
    "trend": {"fundamental": [], "technical": [("ma_align_bull", {}), ("price_above_ma", {"n": 20})]},
    "breakout": {"fundamental": [], "technical": [("price_break_high", {"n": 20}), ("volume_above_ma", {"n": 20, "mult": 1.5})]},
    "oversold": {"fundamental": [], "technical": [("rsi_below", {"n": 14, "value": 30})]},
    "flow": {"fundamental": [], "technical": [("chip_foreign_buy_streak", {"n": 3})]},
}


def fundamental_predicate(conditions: Sequence[Fundamental], industries: Sequence[str] | None = None) -> Column:
    """All conditions hold; a missing value fails its condition, and a missing industry any list of them."""
    tests = [F.coalesce(F.col(f) >= v if op == "at_least" else F.col(f) <= v, F.lit(False)) for f, op, v in conditions]
    if industries:
        tests.append(F.coalesce(F.col("industry").isin(list(industries)), F.lit(False)))
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def industries_of(fundamentals: DataFrame) -> DataFrame:
    return fundamentals.where(F.trim("industry") != "").select("industry").distinct()


def merge_fundamentals(parts: Sequence[DataFrame], closes: DataFrame | None = None) -> DataFrame:
    """Full outer join by code; a column that an earlier part has is not taken from a later one; close from closes where missing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p.select("code", *(c for c in p.columns if c not in out.columns)), "code", "full_outer")
    if closes is not None:
        daily = closes.select("code", F.col("close").alias("_close"))
        out = out.join(daily, "code", "left")
        out = (out.withColumn("close", F.coalesce("close", "_close")) if "close" in out.columns else out.withColumn("close", F.col("_close"))).drop("_close")
    return out


def screen(
    fundamentals: DataFrame,
    bars: DataFrame,
    technical: Sequence[Spec] = (),
    fundamental: Sequence[Fundamental] = (),
    industries: Sequence[str] | None = None,
    logic: str = "AND",
    min_bars: int = 30,
    max_results: int = 200,
    order: str = "code",
) -> DataFrame:
    """Rows of fundamentals that pass, with matched (names and parameters of conditions that hold) and the last bar's ts and close.

    The cheap stage comes first: bars of codes that fail it are dropped by a semi-join before any window. The first max_results in input
    order stay, a limit that is part of the screen.
    """
    kept = fundamentals.where(fundamental_predicate(fundamental, industries))
    if not technical:
        return kept.withColumn("matched", F.array().cast("array<string>")).orderBy(order).limit(max_results)
    wanted = bars.join(kept.select(F.col("code").alias("symbol")), "symbol", "left_semi")
    named = {f"_c{k}": spec for k, spec in enumerate(technical)}
    rows = with_conditions(wanted, named, ["symbol", "ts", "close"])
    last = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    rows = rows.withColumns({"_n": F.row_number().over(last), "_bars": F.count("*").over(Window.partitionBy("symbol"))})
    rows = rows.where((F.col("_n") == 1) & (F.col("_bars") >= min_bars) & combined(list(named), logic))
    told = lambda spec: " ".join([spec[0], *(f"{k}={v}" for k, v in sorted(spec[1].items()))])
    matched = F.array_compact(F.array(*(F.when(F.col(c), F.lit(told(spec))) for c, spec in named.items())))
    hits = rows.select(F.col("symbol").alias("code"), "ts", F.col("close").alias("last_close"), matched.alias("matched"))
    return kept.join(hits, "code").orderBy(order).limit(max_results)


def rebalance_days(bars: DataFrame, every: int = 20, warm_up: int = 60) -> DataFrame:
    """period, signal_day, entry_day, exit_day: signals every so many trading days after a warm-up; trades on the next day's open.

    One row a trading day goes through a window: the days of a market, not its rows.
    """
    w = Window.orderBy("ts")
    days = bars.select("ts").distinct().select("ts", (F.row_number().over(w) - 1).alias("n"), F.lead("ts").over(w).alias("next"), F.max("ts").over(Window.partitionBy()).alias("last"))
    chosen = days.where((F.col("n") >= warm_up) & ((F.col("n") - warm_up) % every == 0))
    p = Window.orderBy("n")
    chosen = chosen.select(F.row_number().over(p).alias("period"), F.col("ts").alias("signal_day"), F.col("next").alias("entry_day"), "last", F.coalesce(F.lead("next").over(p), F.col("last")).alias("exit_day"))
    return chosen.where("entry_day is not null and exit_day > entry_day").select("period", "signal_day", "entry_day", "exit_day")


def picks(bars: DataFrame, technical: Sequence[Spec], days: DataFrame, top: int = 10, min_bars: int = 60, logic: str = "AND") -> DataFrame:
    """period, symbol, rank, entry_day, exit_day, buy, sell: the first `top` symbols whose conditions hold on the signal day.

    Signals are computed for all bars once, so no day sees a later bar, and joined by day. A symbol that did not trade on the
    signal day is judged on its last bar before. Prices are opens, or closes where an open is missing; they may be null.
    """
    named = {f"_c{k}": spec for k, spec in enumerate(technical)}
    rows = with_conditions(bars, named, ["symbol", "ts"]).select("symbol", "ts", combined(list(named), logic).alias("_ok"))
    # A bar is the last one known on the signal days from its own to the one before the next bar's. Trading days know how many signal days
    # come before them, so a bar's span is a range of numbers, found by an equality with its day, and each number finds its signal day.
    signals = days.select("period", "signal_day", "entry_day", "exit_day", F.row_number().over(Window.orderBy("signal_day")).alias("_k"))
    market = bars.select("ts", F.lit(0).alias("_n")).distinct().union(signals.select("signal_day", F.lit(1))).groupBy("ts").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    counted = lambda over: F.coalesce(F.sum("_n").over(over), F.lit(0)).cast("int")
    market = market.select("ts", counted(before).alias("_from"), counted(Window.partitionBy()).alias("_all"))
    w = Window.partitionBy("symbol").orderBy("ts")
    # Trading days of a market are some hundreds a year, whatever its rows.
    placed = rows.join(F.broadcast(market), "ts").withColumns({"_bars": F.row_number().over(w), "_to": F.coalesce(F.lead("_from").over(w), F.col("_all"))})
    spans = placed.where(F.col("_ok") & (F.col("_bars") >= min_bars) & (F.col("_from") < F.col("_to")))
    spans = spans.select("symbol", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_k"))
    hits = spans.join(F.broadcast(signals), "_k").drop("_k")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("period").orderBy("symbol"))).where(F.col("rank") <= top)
    # Both prices of a pick in one pass over the bars: a pick is two wanted days, at most 2 * top a period.
    sides = F.array(*(F.struct(F.col(day).alias("ts"), F.lit(name).alias("_side")) for name, day in (("buy", "entry_day"), ("sell", "exit_day"))))
    wanted = ranked.select("period", "symbol", "rank", "signal_day", "entry_day", "exit_day", F.explode(sides).alias("_x")).select("*", "_x.*").drop("_x")
    price = bars.select("symbol", "ts", F.coalesce("open", "close").alias("_price"))
    of = lambda side: F.max(F.when(F.col("_side") == side, F.col("_price"))).alias(side)
    return wanted.join(price, ["symbol", "ts"], "left").groupBy("period", "symbol", "rank", "signal_day", "entry_day", "exit_day").agg(of("buy"), of("sell"))


def portfolio(chosen: DataFrame, days: DataFrame, cash: float = 1_000_000.0, costs: Costs | None = Costs(), partial_lots: bool = False) -> DataFrame:
    """period, signal_day, entry_day, exit_day, picks, trades, wins, pnl, return_pct, equity: equal weights, whole shares, cash carried over.

    Cash depends on the period before, so the periods, a few hundred rows of picks, are folded in order in one task. Costs count
    whole lots, unless partial_lots.
    """
    per = chosen.groupBy("period").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "symbol", "buy", "sell"))).alias("held"))
    rows = days.join(per, "period", "left").select("period", "signal_day", "entry_day", "exit_day", F.coalesce("n", F.lit(0)).alias("n"), "held")
    c = costs

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        money, out = cash, []
        for r in pdf.sort_values("period").itertuples():
            gain, trades, wins = 0.0, 0, 0
            for h in r.held if r.n else []:
                if h["buy"] is None or h["sell"] is None or h["buy"] != h["buy"] or h["sell"] != h["sell"] or h["buy"] <= 0:
                    continue
                shares = int((money / r.n) // h["buy"])
                if shares <= 0:
                    continue
                fee, lots = 0.0, shares / SHARE_LOT
                if c is not None:
                    lots = lots if partial_lots else int(lots)
                    for side, price in enumerate((h["buy"], h["sell"])):
                        amount = price * lots * SHARE_LOT
                        fee += (max(amount * c.share_fee * c.discount, c.share_least) if amount > 0 else 0.0) + (amount * c.share_tax if side else 0.0)
                pnl = (h["sell"] - h["buy"]) * shares - fee
                gain, trades, wins = gain + pnl, trades + 1, wins + (round(pnl, 2) > 0)
            base, money = money, money + gain
            out.append((r.period, r.signal_day, r.entry_day, r.exit_day, r.n, trades, wins, round(gain, 2), round(gain / base * 100, 2) if base else 0.0, round(money, 2)))
        return pd.DataFrame(out, columns=["period", "signal_day", "entry_day", "exit_day", "picks", "trades", "wins", "pnl", "return_pct", "equity"])

    schema = "period int, signal_day date, entry_day date, exit_day date, picks long, trades long, wins long, pnl double, return_pct double, equity double"
    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, schema)


def portfolio_metrics(periods: DataFrame, bars: DataFrame, cash: float = 1_000_000.0) -> DataFrame:
    """One row of figures of a portfolio, with the mean return of holding every symbol from the first day to the last."""
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    rows = periods.withColumn("_peak", F.greatest(F.lit(cash), F.max("equity").over(w)))
    figures = rows.agg(
        F.count("*").alias("periods"),
        F.round(F.sum("pnl"), 2).alias("total_pnl"),
        F.round(F.sum("pnl") / cash * 100, 2).alias("total_return_pct"),
        F.coalesce(F.round(F.try_divide(F.sum("wins"), F.sum("trades")) * 100, 2), F.lit(0.0)).alias("win_rate"),
        F.round(F.max((F.col("_peak") - F.col("equity")) / F.col("_peak") * 100), 2).alias("max_drawdown_pct"),
        F.sum("trades").alias("trades"),
        F.round(F.avg("picks"), 1).alias("avg_picks"),
        F.round(F.avg((F.col("pnl") > 0).cast("int")) * 100, 2).alias("period_win_rate"),
        F.max("return_pct").alias("best_period_pct"),
        F.min("return_pct").alias("worst_period_pct"),
    )
    ends = bars.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    edges = bars.groupBy("symbol").agg(F.min_by(F.struct("ts", "close"), "ts").alias("_first"), F.max_by(F.struct("ts", "close"), "ts").alias("_last"))
    # One row against one row a symbol.
    held = edges.crossJoin(F.broadcast(ends)).where("_first.ts = a and _last.ts = b").select(F.col("_first.close").alias("p"), F.col("_last.close").alias("q"))
    hold = held.where("p > 0 and q is not null").agg(F.coalesce(F.round(F.avg((F.col("q") / F.col("p") - 1) * 100), 2), F.lit(0.0)).alias("buy_hold_pct"))
    return figures.crossJoin(hold).withColumn("excess_pct", F.round(F.col("total_return_pct") - F.col("buy_hold_pct"), 2))


__all__ = ["fundamental_predicate", "industries_of", "merge_fundamentals", "screen", "rebalance_days", "picks", "portfolio", "portfolio_metrics", "round_trip_cost", "PRESETS"]
