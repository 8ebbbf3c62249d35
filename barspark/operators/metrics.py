"""Figures of backtests, by aggregates and windows over trades and equity, and the checks that hold them against the trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["symbol"]


def _streaks(trades: DataFrame, key: list[str]) -> DataFrame:
    """Longest runs of wins and of losses, and the largest sums of a run; a trade without gain or loss ends both."""
    w = Window.partitionBy(*key).orderBy("exit_ts", "entry_ts")
    rows = trades.withColumn("_sign", F.signum("pnl")).withColumn("_new", (F.col("_sign") != F.coalesce(F.lag("_sign").over(w), F.lit(9.0))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    runs = rows.groupBy(*key, "_run").agg(F.first("_sign").alias("sign"), F.count("*").alias("n"), F.sum("pnl").alias("total"))
    win, loss = F.col("sign") > 0, F.col("sign") < 0
    return runs.groupBy(*key).agg(
        F.coalesce(F.max(F.when(win, F.col("n"))), F.lit(0)).alias("max_consec_wins"),
        F.coalesce(F.max(F.when(loss, F.col("n"))), F.lit(0)).alias("max_consec_losses"),
        F.coalesce(F.max(F.when(win, F.col("total"))), F.lit(0.0)).alias("max_consec_win_amount"),
        F.coalesce(F.min(F.when(loss, F.col("total"))), F.lit(0.0)).alias("max_consec_loss_amount"),
    )


def _curve(equity: DataFrame, bases: DataFrame, key: list[str]) -> DataFrame:
    """Drawdowns from the running peak, which starts at the first value, and what the ratio of mean to spread needs."""
    w = Window.partitionBy(*key).orderBy("ts")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = equity.join(bases.select(*key, "base"), key)
    worth = F.when(F.col("base") != 0, F.col("base")).otherwise(1.0) + F.col("equity")
    rows = rows.withColumn("_worth", worth).withColumn("_d", F.col("equity") - F.lag("equity").over(w))
    rows = rows.withColumns({"_peak": F.max("equity").over(upto), "_top": F.max("_worth").over(upto)})
    return rows.groupBy(*key).agg(
        F.max(F.col("_peak") - F.col("equity")).alias("max_drawdown"),
        F.coalesce(F.max(F.when(F.col("_top") > 0, (F.col("_top") - F.col("_worth")) / F.col("_top") * 100)), F.lit(0.0)).alias("max_drawdown_pct"),
        F.avg("_d").alias("_mean"),
        F.stddev_pop("_d").alias("_spread"),
        F.count("_d").alias("_changes"),
        F.count("*").alias("_points"),
    )


def metrics(trades: DataFrame, equity: DataFrame, bars: DataFrame, unit: float, quantity: int = 1, held: bool = False, key: list[str] | None = None) -> DataFrame:
    """A row for each symbol with trades. Infinite ratios are infinite; held: the base is all that was bought, not the mean."""
    key = key or KEY
    cost = F.abs("entry_price") * F.col("quantity") * unit
    pnl, win, loss = F.col("pnl"), F.col("pnl") > 0, F.col("pnl") < 0
    long, short = F.col("direction") == "long", F.col("direction") == "short"
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = trades.groupBy(*key).agg(
        F.count("*").alias("trades"),
        F.count_if(win).alias("wins"),
        F.count_if(loss).alias("losses"),
        F.sum("pnl").alias("total_pnl"),
        zero(F.sum(F.when(win, pnl))).alias("gross_profit"),
        zero(-F.sum(F.when(loss, pnl))).alias("gross_loss"),
        F.sum("gross").alias("gross_pnl"),
        F.sum("fee").alias("total_fee"),
        F.sum("tax").alias("total_tax"),
        F.max("pnl").alias("best_trade"),
        F.min("pnl").alias("worst_trade"),
        zero(F.min(F.when(loss, pnl))).alias("max_single_loss"),
        zero(F.max(F.when(win, pnl))).alias("max_single_win"),
        F.count_if(long).alias("long_trades"),
        F.count_if(short).alias("short_trades"),
        zero(F.sum(F.when(long, pnl))).alias("long_pnl"),
        zero(F.sum(F.when(short, pnl))).alias("short_pnl"),
        (F.count_if(long & win) / F.greatest(F.lit(1), F.count_if(long)) * 100).alias("long_win_rate"),
        (F.count_if(short & win) / F.greatest(F.lit(1), F.count_if(short)) * 100).alias("short_win_rate"),
        F.sum("bars_held").alias("_held"),
        F.max("bars_held").alias("max_bars_held"),
        F.min_by(cost, F.struct("entry_ts", "exit_ts")).alias("cost_basis_first"),
        F.sum(cost).alias("cost_basis_total"),
        F.max(cost).alias("cost_basis_max"),
        (F.sum(cost) if held else F.avg(cost)).alias("base"),
    )
    w = Window.partitionBy("symbol").orderBy("ts")
    first = bars.select("symbol", "ts", "close", F.row_number().over(w).alias("_n"))
    series = first.groupBy("symbol").agg(
        F.count("*").alias("_bars"), F.min("ts").alias("_first"), F.max("ts").alias("_last"), F.max_by("close", "ts").alias("_close"), F.max(F.when(F.col("_n") == 3, F.col("close"))).alias("_start")
    )
    rows = per.join(_streaks(trades, key), key).join(_curve(equity, per, key), key).join(series, "symbol")
    years = F.greatest(F.datediff("_last", "_first"), F.lit(1)) / 365.0
    rows = rows.withColumn("years", years)
    bars_a_year = F.col("_points") / F.col("years")
    avg_win, avg_loss = F.try_divide("gross_profit", "wins"), F.try_divide("gross_loss", "losses")
    infinite = lambda a, b, least: F.when(b > least, F.try_divide(a, b)).otherwise(F.when(a > 0, float("inf")).otherwise(0.0))
    costs = F.col("total_fee") + F.col("total_tax")
    hold = (F.col("_close") - F.col("_start")) * quantity * unit
    derived = {
        "total_cost": costs,
        "win_rate": F.col("wins") / F.col("trades") * 100,
        "profit_factor": infinite(F.col("gross_profit"), F.col("gross_loss"), 0),
        "avg_win": zero(avg_win),
        "avg_loss": zero(-avg_loss),
        "win_loss_ratio": infinite(zero(avg_win), zero(avg_loss), 1e-12),
        "expectancy": F.col("total_pnl") / F.col("trades"),
        "total_return_pct": zero(F.try_divide("total_pnl", "base") * 100),
        "ann_return_pct": zero(F.try_divide("total_pnl", "base") * 100 / F.col("years")),
        "sharpe": F.when((F.col("_changes") > 2) & (F.col("_spread") > 1e-12), F.col("_mean") / F.col("_spread") * F.sqrt(bars_a_year)).otherwise(0.0),
        "trades_per_year": F.col("trades") / F.col("years"),
        "cost_per_year": costs / F.col("years"),
        "cost_ratio_pct": F.when(F.abs("gross_pnl") > 1e-9, costs / F.abs("gross_pnl") * 100).otherwise(0.0),
        "avg_cost_per_trade": costs / F.col("trades"),
        "exposure_pct": F.col("_held") / F.col("_bars") * 100,
        "avg_bars_held": F.col("_held") / F.col("trades"),
        "buy_hold_pnl": hold,
        "buy_hold_pct": F.try_divide(hold, F.col("_start") * quantity * unit) * 100,
    }
    return rows.withColumns(derived).drop(*[c for c in rows.columns if c.startswith("_")])


def audit(trades: DataFrame, figures: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """symbol and a boolean for each check of the figures against sums over the trades, computed anew."""
    pnl = F.col("pnl")
    again = trades.groupBy("symbol").agg(
        F.sum(pnl).alias("a_pnl"), F.count("*").alias("a_n"), F.count_if(pnl > 0).alias("a_wins"), F.count_if(pnl < 0).alias("a_losses"),
        F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0)).alias("a_gain"), F.coalesce(-F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("a_loss"), F.coalesce(-F.min(F.when(pnl < 0, pnl)), F.lit(0.0)).alias("a_worst"),
        F.count_if((F.when(F.col("direction") == "long", F.col("exit_price") <= F.col("entry_price")).otherwise(F.col("exit_price") >= F.col("entry_price"))) & (F.col("exit_price") != F.col("entry_price")) & (pnl > 0)).alias("a_odd"),
        F.count_if(F.col("exit_ts") < F.col("entry_ts")).alias("a_time"), F.count_if(F.col("bars_held") < 0).alias("a_bars"),
    )
    streak = _streaks(trades, KEY).select("symbol", F.col("max_consec_loss_amount").alias("a_streak"))
    rows = again.join(streak, "symbol").join(figures, "symbol")
    close = lambda a, b, t=tolerance: F.abs(F.col(a) - F.col(b)) <= t
    factor = F.when(F.col("a_loss") > 0, F.abs(F.col("a_gain") / F.col("a_loss") - F.col("profit_factor")) <= 0.01).otherwise(True)
    return rows.select(
        "symbol",
        close("a_pnl", "total_pnl").alias("sum_of_trades"),
        (F.col("a_n") == F.col("trades")).alias("number_of_trades"),
        ((F.col("a_wins") == F.col("wins")) & (F.col("a_losses") == F.col("losses"))).alias("wins_and_losses"),
        (F.abs(F.col("a_wins") / F.col("a_n") * 100 - F.col("win_rate")) <= 0.05).alias("rate_of_wins"),
        factor.alias("gain_over_loss"),
        close("a_streak", "max_consec_loss_amount").alias("losing_streak"),
        (F.col("max_drawdown") + tolerance >= F.col("a_worst")).alias("drawdown_over_worst"),
        (F.col("a_odd") == 0).alias("direction_of_gains"),
        (F.col("a_time") == 0).alias("exit_after_entry"),
        (F.col("a_bars") == 0).alias("bars_not_negative"),
    )
