"""Parameter sweeps: every combination is a run of the same bars, and a symbol's bars meet all runs in one task."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspark.operators.strategy import Strategy, moves, prices_of, replay
from barspark.plans.compiler import compiled, with_conditions

MOST_COMBINATIONS, MOST_TRIALS = 500, 300
MINIMISED = {"max_drawdown"}
OBJECTIVES = ("total_pnl", "profit_factor", "sharpe", "expectancy", "win_rate", "max_drawdown")

Params = dict[str, float]


def _number(text: str) -> float | int:
    x = float(text)
    return int(x) if x.is_integer() else x


def parse_grid(text: str) -> dict[str, list[float]]:
    """`a=1,2; b=1:10:2`: lists, and ranges from a start to before an end by a step (1 if missing)."""
    out: dict[str, list[float]] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        name, _, values = part.partition("=")
        if not values:
            raise ValueError(f"no values in {part!r}")
        if ":" in values:
            bounds = [_number(v) for v in values.split(":")]
            start, end, step = (*bounds, 1)[:3]
            if step <= 0:
                raise ValueError("a step is positive")
            out[name.strip()] = [_number(str(start + k * step)) for k in range(max(0, -int(-(end - start) // step)))]
        else:
            out[name.strip()] = [_number(v) for v in values.split(",")]
    return out


def combinations(grid: dict[str, Sequence[float]]) -> Iterator[Params]:
    for values in itertools.product(*grid.values()):
        yield dict(zip(grid, values, strict=True))


def sampled(ranges: dict[str, tuple[float, float, bool]], trials: int, seed: int) -> list[Params]:
    """Seeded trials of (low, high, whole numbers only); others are rounded to 4 places."""
    if trials > MOST_TRIALS:
        raise ValueError(f"at most {MOST_TRIALS} trials")
    draw = random.Random(seed)
    return [{k: draw.randint(int(lo), int(hi)) if whole else round(draw.uniform(lo, hi), 4) for k, (lo, hi, whole) in ranges.items()} for _ in range(trials)]


FIGURES = "run int, symbol {symbol}, trades long, wins long, gain double, loss double, total_pnl double, max_drawdown double, sharpe double"


def _figures(moved: list[tuple], curve: np.ndarray, span: float) -> tuple:
    """Trades, wins, gain, loss, profit, deepest drawdown and Sharpe ratio of one symbol's trades and equity; span is the series' length in days."""
    pnl = np.array([e[11] for e in moved if e[0] == "trade"], float)
    steps = np.diff(curve)
    spread = steps.std() if len(steps) > 2 else 0.0
    sharpe = steps.mean() / spread * np.sqrt(len(curve) / (max(span, 1) / 365.0)) if spread > 1e-12 else 0.0
    fall = float((np.maximum.accumulate(curve) - curve).max()) if len(curve) else 0.0
    return len(pnl), int((pnl > 0).sum()), float(pnl[pnl > 0].sum()), float(-pnl[pnl < 0].sum()), float(pnl.sum()), fall, float(sharpe)


def run_all(bars: DataFrame, make: Callable[[Params], Strategy], runs: Sequence[Params]) -> DataFrame:
    """run, symbol and the figures of each run on each symbol, also of those without trades.

    Bars are dealt by symbol once, whatever the number of runs: they get a column a distinct condition, and a symbol's task replays all
    runs over those. What comes back is a row a run and symbol. Runs that cannot be made are left to faults().
    """
    if len(runs) > MOST_COMBINATIONS:
        raise ValueError(f"at most {MOST_COMBINATIONS} combinations")
    strategies = {k: s for k, (s, fault) in enumerate(_made(make, runs)) if fault is None}
    specs: dict[str, tuple] = {}
    name_of = lambda spec: specs.setdefault(repr((spec[0], sorted(dict(spec[1] or {}).items()))), (f"_s{len(specs)}", spec))[0]
    used = {k: ([name_of(x) for x in s.entry], [name_of(x) for x in s.exit]) for k, s in strategies.items()}
    columns = ["symbol", "ts", "open", "high", "low", "close"]
    rows = with_conditions(bars, dict(specs.values()), columns)
    rows = rows.select(*columns, *(F.coalesce(c, F.lit(False)).alias(c) for c, _ in specs.values()))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        symbol, span = pdf["symbol"].iloc[0], (pdf["ts"].iloc[-1] - pdf["ts"].iloc[0]).days
        flags, out = {c: pdf[c].to_numpy(bool) for c, _ in specs.values()}, []
        ts, prices, none = pdf["ts"].tolist(), prices_of(pdf), np.zeros(len(pdf), bool)
        for k, s in strategies.items():
            enter, leave = ([flags[c] for c in names] for names in used[k])
            enter, leave = np.logical_and.reduce(enter) if enter else none, np.logical_or.reduce(leave) if leave else none
            if s.hold:
                events = replay(pdf.assign(_entry=enter, _exit=leave), s)
                moved, curve = events, np.array([e[15] for e in events if e[0] == "equity"], float)
            else:
                moved, curve = moves(ts, prices, enter, leave, s)
            out.append((k, symbol, *_figures(moved, curve, span)))
        return pd.DataFrame(out, columns=["run", "symbol", "trades", "wins", "gain", "loss", "total_pnl", "max_drawdown", "sharpe"])

    return rows.groupBy("symbol").applyInPandas(one, FIGURES.format(symbol=bars.schema["symbol"].dataType.simpleString()))


def _made(make: Callable[[Params], Strategy], runs: Sequence[Params]) -> list[tuple[Strategy | None, str | None]]:
    """The strategy of each run, or what is wrong with it."""
    out = []
    for p in runs:
        try:
            s = make(p)
            for spec in (*s.entry, *s.exit):
                compiled(spec)
            faults = s.problems()
            out.append((None, "; ".join(faults)) if faults else (s, None))
        except (ValueError, KeyError, TypeError) as e:
            out.append((None, f"{type(e).__name__}: {e}"))
    return out


def ranked(results: DataFrame, objective: str = "total_pnl", least_trades: int = 1) -> DataFrame:
    """results (run, trades and the objectives) with eligible and score, best first; runs with too few trades and faulty ones come last."""
    if objective not in OBJECTIVES:
        raise ValueError(f"the objectives are {', '.join(OBJECTIVES)}")
    value = F.when(F.col(objective) == float("inf"), 1e12).otherwise(F.col(objective))
    score = -value if objective in MINIMISED else value
    rows = results.withColumn("eligible", F.col("trades") >= least_trades).withColumn("score", score)
    return rows.orderBy(F.desc("eligible"), F.desc("score"), "run")


def totals(figures: DataFrame, make: Callable[[Params], Strategy], runs: Sequence[Params]) -> DataFrame:
    """run, trades, wins, total_pnl, profit_factor, expectancy, win_rate, max_drawdown, sharpe and fault of every run over all symbols.

    The drawdown is the deepest of a symbol and the Sharpe ratio the mean over symbols. A run without trades has zeros, a run that cannot
    be made too, and what is wrong with it.
    """
    faults = [(k, fault) for k, (_, fault) in enumerate(_made(make, runs))]
    every = figures.sparkSession.createDataFrame(faults, "run int, fault string")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = figures.groupBy("run").agg(*(F.sum(c).alias(c) for c in ("trades", "wins", "gain", "loss", "total_pnl")), F.max("max_drawdown").alias("max_drawdown"), F.avg("sharpe").alias("sharpe"))
    # One row a run, at most MOST_COMBINATIONS of them.
    rows = every.join(F.broadcast(sums), "run", "left").fillna(0, ["trades", "wins", "gain", "loss", "total_pnl", "max_drawdown", "sharpe"])
    factor = F.when(F.col("loss") > 0, F.try_divide("gain", "loss")).otherwise(F.when(F.col("gain") > 0, float("inf")).otherwise(0.0))
    return rows.select(
        "run", "trades", "wins", "total_pnl", factor.alias("profit_factor"), zero(F.try_divide("total_pnl", "trades")).alias("expectancy"),
        zero(F.try_divide(F.col("wins") * 100, F.col("trades"))).alias("win_rate"), "max_drawdown", "sharpe", "fault",
    )


def walk_forward(bars: DataFrame, make: Callable[[Params], Strategy], params: Params, share: float = 0.7) -> DataFrame:
    """part (in or out), trades, wins, total_pnl ...: one split of each series of 20 bars or more, 10 on each side at least."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("symbol"))
    k = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    rows = bars.withColumns({"_n": n, "_k": k}).withColumn("_cut", F.floor(F.col("_n") * share))
    rows = rows.where((F.col("_n") >= 20) & (F.col("_cut") >= 10) & (F.col("_n") - F.col("_cut") >= 10))
    parts = []
    for name, test in (("in", F.col("_k") <= F.col("_cut")), ("out", F.col("_k") > F.col("_cut"))):
        part = rows.where(test).drop("_n", "_k", "_cut")
        parts.append(totals(run_all(part, make, [params]), make, [params]).select(F.lit(name).alias("part"), "trades", "wins", "total_pnl", "profit_factor", "expectancy", "win_rate"))
    return parts[0].unionByName(parts[1])
