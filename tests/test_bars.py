"""Frames by hand: edges of buckets, no look-ahead, stops, and plans."""

import datetime as dt
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspark.functions import scalars as S
from barspark.functions.conditions import CONDITIONS
from barspark.functions.scan import Scan, ewm, with_scans
from barspark.operators import account, asof, band, levels, patterns, resample, strategy, sweep
from barspark.plans.compiler import FlowDataMissing, combined, faults, with_conditions
from barspark.queries import QUERIES
from barspark.sources import barstore
from barspark.sources import tables as T


def frame(n=120, symbols=("a", "b"), seed=1):
    draw = np.random.default_rng(seed)
    out = []
    for s in symbols:
        x = np.arange(n)
        close = 100 + 8 * np.sin(x / 5) + 3 * np.cos(x / 17) + draw.normal(0, 1, n)
        op = close + draw.normal(0, 1, n)
        out.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n).date, "open": op, "high": np.maximum(op, close) + 1, "low": np.minimum(op, close) - 1, "close": close, "volume": 800.0 + 150 * (x % 11)}))
    return pd.concat(out, ignore_index=True)


def _make(p):
    spec = {"fast": int(p["fast"]), "slow": int(p["slow"])}
    return strategy.Strategy(entry=(("ma_cross_up", spec),), exit=(("ma_cross_down", spec),))


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(frame()).cache()


def test_session_day_edges(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 5, 13, 45),), (dt.datetime(2024, 1, 5, 13, 46),)], "ts timestamp_ntz")
    days = [r[0] for r in rows.select(resample.session_day(F.col("ts"))).collect()]
    assert days == [dt.date(2024, 1, 5), dt.date(2024, 1, 6)]  # a Friday's night belongs to Saturday


def test_small_hours_belong_to_the_day_before(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 6, 2),), (dt.datetime(2024, 1, 8, 2),), (dt.datetime(2024, 1, 5, 16),)], "ts timestamp_ntz")
    assert [r[0] for r in rows.select(S.session("future", F.col("ts"))).collect()] == ["night", "closed", "night"]


def test_ewm_with_gaps():
    assert ewm(pd.Series([np.nan, 1, np.nan, np.nan, 4]), 0.5).iloc[-1] == pytest.approx(3.4)


def test_conditions_do_not_see_the_future(spark):
    names = [n for n, c in CONDITIONS.items() if not c.flow]
    whole, cut = frame(90, ("a",)), frame(90, ("a",))
    cut.loc[60:, ["open", "high", "low", "close", "volume"]] *= 7
    results = []
    for f in (whole, cut):
        rows = with_conditions(spark.createDataFrame(f), {n: (n, {}) for n in names}, ["ts"]).orderBy("ts").limit(60).toPandas()
        results.append(rows)
    pd.testing.assert_frame_equal(*results)


def test_replay_does_not_see_the_future():
    s = strategy.Strategy(entry=(("always_true", {}),), exit=(("always_true", {}),), stop_pct=2.0)
    a = frame(60, ("a",)).assign(_entry=lambda d: d.index % 7 == 0, _exit=lambda d: d.index % 5 == 0)
    b = a.copy()
    b.loc[40:, ["open", "high", "low", "close"]] *= 3
    before = [e for e in strategy.replay(a, s) if e[1] < 40]
    assert before == [e for e in strategy.replay(b, s) if e[1] < 40]


def test_flow_needs_its_column(bars):
    with pytest.raises(FlowDataMissing):
        with_conditions(bars, {"x": ("chip_foreign_turn_buy", {})})


def test_empty_list_of_conditions_is_false(spark):
    assert spark.range(1).select(combined([], "AND")).first()[0] is False


def test_touch_exit_prefers_the_stop_and_fills_gaps_at_the_open():
    s = strategy.Strategy(entry=(("always_true", {}),), stop_abs=5.0, take_abs=5.0)
    assert strategy.touched(s, True, 100, 99, 106, 94) == (95.0, "stop")
    assert strategy.touched(s, True, 100, 90, 91, 89) == (90, "stop")
    assert strategy.touched(s, False, 100, 101, 102, 94) == (95.0, "take")


def test_order_of_stops():
    s = strategy.Strategy(entry=(("always_true", {}),), stop_abs=1.0, take_pct=1.0)
    assert strategy.stopped(s, True, 100, 98.0) == "stop_abs"
    assert strategy.stopped(s, True, 100, 102.0) == "take_pct"
    assert strategy.stopped(s, True, 0.0, 102.0) is None


def test_short_only_for_futures():
    assert strategy.Strategy(entry=(("always_true", {}),), exit=(("always_true", {}),), direction="short").problems() == ["only futures are sold short"]


def test_dca_carries_the_rest():
    f = frame(60, ("a",)).assign(_entry=True, _exit=False)
    s = strategy.Strategy(entry=(("always_true", {}),), hold="dca", dca_amount=250.0, kind="odd", costs=None)
    lots = [e for e in strategy.replay(f, s) if e[0] == "trade"]
    assert len(lots) == 2 and all(e[7] >= 2 for e in lots)


def test_bars_are_summed_before_they_are_shuffled(spark, small):
    rows = T.daily_bars(spark, small)
    plan = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffle = next(k for k, line in enumerate(plan) if "Exchange hashpartitioning(symbol" in line)
    assert any("partial_min_by" in line for line in plan[shuffle + 1 :]) and not any("REPARTITION_BY" in line for line in plan)


def test_conditions_deal_bars_by_symbol_once_or_twice(spark, small):
    windows = {"a": ("ma_cross_up", {}), "c": ("bb_squeeze", {}), "d": ("consecutive_up", {})}
    # One shuffle makes the bars, one deals them; a grouped pass hides how its rows are dealt, so windows over its columns shuffle once more.
    for named, shuffles in ((windows, 2), (windows | {"b": ("kd_cross_up", {}), "e": ("macd_cross_up", {})}, 3)):
        plan = with_conditions(T.daily_bars(spark, small), named, ["symbol", "ts"])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_sweep_deals_bars_once_whatever_its_runs(spark, small):
    plans = []
    for n in (1, 6):
        runs = [{"fast": 3 + k, "slow": 20} for k in range(n)]
        figures = sweep.run_all(T.daily_bars(spark, small), _make, runs)
        plans.append(figures._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert plans[0] == plans[1]


def test_runs_without_trades_and_faulty_runs_stay(spark, bars):
    runs = [{"fast": 5, "slow": 20}, {"fast": 3, "slow": 400}, {"fast": "x", "slow": 9}]
    for objective in sweep.OBJECTIVES:
        out = sweep.ranked(sweep.totals(sweep.run_all(bars, _make, runs), _make, runs), objective).collect()
        assert [r["run"] for r in out][0] == 0 and {r["run"] for r in out} == {0, 1, 2}
        by = {r["run"]: r for r in out}
        assert by[1]["trades"] == 0 and not by[1]["eligible"] and by[1]["fault"] is None
        assert "ValueError" in by[2]["fault"]
    with pytest.raises(ValueError):
        sweep.ranked(bars, "luck")


def test_a_faulty_condition_is_false_and_told(bars):
    named = {"good": ("always_true", {}), "unknown": ("no_such", {}), "broken": ("ma_cross_up", {"fast": "x"})}
    assert set(faults(named)) == {"unknown", "broken"}
    row = with_conditions(bars, named, ["symbol"]).agg(*(F.count_if(c).alias(c) for c in named)).first()
    assert (row["good"], row["unknown"], row["broken"]) == (240, 0, 0)


def levels_by_hand(r, swings, s):
    """Candidates in order of strength, each put into the first level near it; then the strongest of each price."""
    bins = r["bins"]
    v, mid = [b["volume"] for b in bins], [(b["bin_lo"] + b["bin_hi"]) / 2 for b in bins]
    inner = range(1, len(v) - 1)
    def spread(ks, key):
        out = []
        for k in sorted(ks, key=key):
            out += [k] if all(abs(k - j) >= s.apart for j in out) else []
        return out
    flat = {k for k in inner if v[k - 1] == v[k] == v[k + 1]}
    full = spread([k for k in inner if v[k] >= max(v[k - 1], v[k + 1]) and k not in flat], lambda k: -v[k])
    empty = spread([k for k in inner if v[k] <= min(v[k - 1], v[k + 1]) and k not in flat], lambda k: v[k])
    found = [(r["poc"], "POC", 1.0), (r["vah"], "VAH", 0.75), (r["val"], "VAL", 0.75)]
    found += [(mid[k], "HVN", min(0.95, max(0.15, v[k] / max(v)))) for k in full if mid[k] != r["poc"]]
    found += [(x["price"], "SwingHigh" if kind == "high" else "SwingLow", 0.5) for kind in ("high", "low") for x in swings if x["kind"] == kind]
    tick = next((t for limit, t in S.SHARE_TICKS if r["current"] < limit), S.SHARE_TOP_TICK)
    reach = max(2 * tick, (bins[0]["bin_hi"] - bins[0]["bin_lo"]) / 2)
    groups = []
    for price, kind, strength in sorted(found, key=lambda x: -x[2]):
        home = [g for g in groups if abs(g[0] - price) < reach][:1]
        if home:
            home[0][2] = min(1.0, home[0][2] + strength / 4)
        else:
            groups.append([price, kind, strength])
    return [(p, k, x) for p, k, x in sorted(groups, key=lambda g: -g[2])], [mid[k] for k in empty]


def test_levels_by_hand(spark, bars):
    s = levels.LevelSettings(most=99)
    profile = levels.histogram(bars)
    packed = profile.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("bin", "bin_lo", "bin_hi", "volume"))).alias("bins"))
    rows = packed.join(levels.value_area(profile), "symbol").join(bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("current")), "symbol").collect()
    got = levels.support_resistance(bars, s).collect()
    swings = levels.swing_points(bars).orderBy("ts").collect()
    to_tick = lambda ps: [r[0] for r in spark.createDataFrame([(k, float(p)) for k, p in enumerate(ps)], "k int, p double").orderBy("k").select(S.round_to_tick(F.col("p"))).collect()]
    for r in rows:
        main, gaps = levels_by_hand(r, [x for x in swings if x["symbol"] == r["symbol"]], s)
        want = {}
        for price, (_, kind, strength) in zip(to_tick([p for p, _, _ in main]), main, strict=True):
            want.setdefault(price, (kind, round(strength, 3)))
        for price in to_tick(gaps):
            want.setdefault(price, ("LVN", 0.25))
        mine = {x["price"]: (x["kind"], x["strength"]) for x in got if x["symbol"] == r["symbol"]}
        assert {p: k for p, (k, _) in mine.items()} == {p: k for p, (k, _) in want.items()}
        assert all(abs(mine[p][1] - want[p][1]) < 0.0011 for p in want)
    assert {x["role"] for x in got} <= {"support", "resistance", "current"}


def test_user_code_is_told_of_its_position_parameters_and_errors(spark):
    code = """
def on_bar(ctx):
    ctx.state['n'] = ctx.state.get('n', 0) + 1
    if ctx.i == 5:
        return ctx.buy()
    if ctx.position == 'long' and ctx.bars_in_position >= ctx.param('hold', 3):
        return 'close'
    if ctx.i == 20:
        ctx.log('half way')
    if ctx.i == 21:
        1 / 0
    k, d = ctx.kd()
    dif, sig, hist = ctx.macd()
    return ctx.hold()
"""
    table = spark.createDataFrame(frame(30, ("a",)))
    events = strategy.backtest_custom(table, code, {"hold": 4}, strategy.Strategy(entry=(("always_true", {}),), exit=(("always_true", {}),), costs=None))
    trades = strategy.trades(events).collect()
    f = frame(30, ("a",))
    assert [(t["entry_price"], t["exit_price"], t["bars_held"]) for t in trades] == [(f["open"][6], f["open"][10], 4)]
    assert [r["parameter"] for r in strategy.parameters(events).collect()] == ["hold=4 (given)"]
    told = [r["reason"] for r in events.where("event = 'log'").orderBy("i").collect()]
    assert told[0] == "half way" and "ZeroDivisionError" in told[1]


def test_daily_range_prunes_months_and_lists_codes(spark, tmp_path):
    f = spark.createDataFrame(frame()).withColumnRenamed("symbol", "code").withColumn("ym", F.date_format("ts", "yyyyMM").cast("int"))
    f.write.partitionBy("ym").parquet(str(tmp_path / "market"))
    rows = barstore.daily_range(spark.read.parquet(str(tmp_path / "market")), "2024-02-10", "2024-03-05", ["a"])
    assert rows.count() == 25
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "PushedFilters: [" in plan
    days = spark.createDataFrame([(dt.date(2024, 2, 10),), (dt.date(2025, 1, 1),)], "ts date")
    assert [r["ts"] for r in barstore.wanted_days(rows, days).collect()] == [dt.date(2025, 1, 1)]


def test_asof_plans_no_inequality_join(spark, small):
    rows = asof.with_flow(T.daily_bars(spark, small), T.stock_flow(spark, small), ["foreign_net"])
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_filters_down(spark, tmp_path):
    store = barstore.BarStore(spark, str(tmp_path / "store"))
    f = spark.createDataFrame(frame()).withColumns({"asset_type": F.lit("stock"), "timeframe": F.lit("day")})
    store.create(f)
    store.upsert(f.where("symbol = 'a'").withColumn("close", F.lit(1.0)))
    rows = store.read()
    assert rows.count() == 240 and rows.where("symbol = 'a' and close = 1").count() == 120
    plan = barstore.scan(rows, symbol="a", start="2024-02-01", timeframe="day")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(symbol)" in plan and "PartitionFilters: [isnotnull(timeframe" in plan


def test_recurrences_are_null_where_unknown(bars):
    rows = with_scans(bars.withColumns({"high": F.lit(5.0), "low": F.lit(5.0), "close": F.lit(5.0)}), [Scan("kdj", (9, 3, 3)), Scan("dmi", (14,)), Scan("rsi", (14,))])
    row = rows.agg(*(F.count(c).alias(c) for c in ("kdj_9_3_3_k", "dmi_14_adx", "rsi_14"))).first()
    assert tuple(row) == (0, 0, 0)


def test_swings_alternate():
    f = frame(80, ("a",))
    found = patterns.swings(f["high"].to_numpy(), f["low"].to_numpy(), 3)
    assert len(found) > 3 and all(a[1] != b[1] for a, b in zip(found, found[1:], strict=False))


def test_double_top_and_its_mirror():
    close = np.array([10, 12, 14, 16, 20, 16, 14, 13, 14, 16, 20, 16, 14, 13.5, 12.0] * 1, float)
    high, low = close + 0.2, close - 0.2
    s = patterns.Settings(swing_window=2, lookback=60)
    assert [n for n, _ in patterns.swing_signals(high, low, close, s)][:1] == ["double_top"]
    assert [n for n, _ in patterns.swing_signals(40 - low, 40 - high, 40 - close, s)][:1] == ["double_bottom"]


def test_value_area_grows_upwards_on_ties(spark):
    rows = spark.createDataFrame([("a", k, float(k), k + 1.0, v) for k, v in enumerate([1.0, 2.0, 5.0, 2.0, 1.0])], "symbol string, bin int, bin_lo double, bin_hi double, volume double")
    got = levels.value_area(rows, 0.6).first()
    assert (got["poc"], got["vah"], got["val"]) == (2.5, 4.0, 2.0)


def test_ticks_round_half_to_even_and_across_bands(spark):
    rows = spark.createDataFrame([(9.996,), (49.99,), (99.97,), (105.25,), (999.6,)], "p double")
    assert [r[0] for r in rows.select(S.round_to_tick(F.col("p"))).collect()] == [10.0, 50.0, 100.0, 105.0, 1000.0]


def test_grid_parses_lists_and_half_open_ranges():
    assert sweep.parse_grid("a=1,2.5; b=1:7:2; c=3:5") == {"a": [1, 2.5], "b": [1, 3, 5], "c": [3, 4]}
    assert len(list(sweep.combinations(sweep.parse_grid("a=1,2; b=1:4")))) == 6


def test_custom_strategy_runs_every_symbol(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/lineitem.parquet")
    rows.withColumn("l_suppkey", F.col("l_suppkey") + 100).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{small}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    shifted = sorted((r["symbol"] - 100, r["ts"], r["actions"]) for r in QUERIES["custom_strategy"](spark, str(tmp_path)).collect())
    assert shifted and shifted == sorted((r["symbol"], r["ts"], r["actions"]) for r in QUERIES["custom_strategy"](spark, small).collect())


def test_empty_bars(spark, bars):
    none = bars.where("false")
    assert with_conditions(none, {"x": ("ma_cross_up", {}), "y": ("kd_cross_up", {})}, ["ts"]).count() == 0
    assert strategy.backtest(none, strategy.Strategy(entry=(("always_true", {}),), exit=(("always_true", {}),))).count() == 0
    assert levels.histogram(none).count() == 0 and patterns.patterns(none).count() == 0


def test_band_needs_noon_to_confirm_and_a_minute_to_send():
    b, s = band.Band(line=100, stop=90, arm=10, step=5), band.State()
    band.on_close(b, s, "d1", 105, 99.0, 20)
    band.on_noon(b, s, "d2", 99, 0.0)
    assert s.proposed is None and s.order is None  # not confirmed
    band.on_close(b, s, "d2", 106, 99.0, 21)
    band.on_noon(b, s, "d3", 104, 1000.0)
    assert band.on_time(b, s, 104, 1030.0) is None
    assert band.on_time(b, s, 105, 1060.0) == ("open", "buy", 1, 105) and s.entry == 104
    band.on_close(b, s, "d3", 125, 130.0, 22)
    assert s.armed and s.trail == 104 + 2 * 5
    band.on_close(b, s, "d4", 112, 130.0, 23)
    assert s.proposed == "trail"
    band.on_noon(b, s, "d5", 111, 5000.0)
    assert band.on_time(b, s, 111, 5700.0) is None and s.discarded == ["close"] and s.position


def test_band_folds_few_rows_a_day_and_decides_as_all_prices_do(spark):
    draw = np.random.default_rng(4)
    start, prices, closes = dt.datetime(2024, 1, 1), [], []
    for day in range(120):
        at = {int(x) for x in draw.integers(11 * 3600 + 3000, 12 * 3600 + 1500, draw.integers(0, 60))} | {int(x) for x in draw.integers(0, 86400, 5)}
        prices += [(start + dt.timedelta(days=day, seconds=s), float(draw.integers(5, 40))) for s in sorted(at)]
        closes.append((start + dt.timedelta(days=day), float(draw.integers(5, 40))))
    b, s, want = band.Band(line=20.0, stop=15.0, arm=4.0, step=2.0), band.State(), []
    events = sorted([(t + dt.timedelta(days=1), 0, t, x) for t, x in closes] + [(t, 1, t, x) for t, x in prices])
    seen = []
    for at, order, t, x in events:
        now = (at - start).total_seconds()
        if order == 0:
            seen.append(x)
            band.on_close(b, s, t.date(), x, sum(seen[-20:]) / 20 if len(seen) >= 20 else None, len(seen))
            continue
        if band.NOON[0] <= at.hour * 60 + at.minute <= band.NOON[1]:
            band.on_noon(b, s, at.date(), x, now)
        if (done := band.on_time(b, s, x, now)) is not None:
            want.append((at, *done))
    intraday = spark.createDataFrame([("a", *p) for p in prices], "symbol string, ts timestamp_ntz, price double")
    daily = spark.createDataFrame([("a", t.date(), x) for t, x in closes], "symbol string, ts date, close double")
    got = band.run(daily, intraday, b).orderBy("ts").collect()
    assert len(want) > 5 and [tuple(r)[1:] for r in got] == want
    assert band.decisive(intraday).groupBy("symbol", F.to_date("ts")).count().where("count > 2").isEmpty()


def test_band_short_mirrors_long():
    long, short = band.Band(100, 90, 10, 5), band.Band(100, 110, 10, 5, "short")
    a, z = band.State(), band.State()
    for k, x in enumerate([105, 104, 125, 131, 112]):
        for b, s, price in ((long, a, x), (short, z, 200 - x)):
            band.on_close(b, s, k, price, 100.0, 20 + k)
            band.on_noon(b, s, k, price, k * 1000.0)
            band.on_time(b, s, price, k * 1000.0 + 70)
    assert (a.position, a.armed, a.by_average, a.proposed) == (z.position, z.armed, z.by_average, z.proposed)
    assert a.trail - 100 == 100 - z.trail


def test_account_averages_closes_and_values(spark):
    rows = [("a", "X", 1, 1, "share", "odd", True, True, 2, 10.0), ("a", "X", 2, 2, "share", "odd", True, True, 2, 20.0), ("a", "X", 3, 3, "share", "odd", False, False, 1, 30.0), ("a", "TMF1", 1, 4, "future", None, True, False, 1, 100.0), ("a", "TMF1", 2, 5, "future", None, False, True, 3, 90.0)]
    fills = spark.createDataFrame(rows, "account string, symbol string, ts int, seq int, market string, kind string, opens boolean, buys boolean, quantity int, price double")
    out = account.history(fills)
    x = {r["seq"]: r for r in out.collect()}
    assert (x[2]["held"], x[2]["average"]) == (4, 15.0)
    assert x[3]["pnl"] == pytest.approx(15 - 0.13, abs=0.01) and x[3]["held"] == 3
    assert x[5]["pnl"] == pytest.approx(100 - 150) and x[5]["held"] == 0
    now = account.equity(out, spark.createDataFrame([("X", 16.0)], "symbol string, mark double"), 1000.0).first()
    assert now["unrealized"] == pytest.approx(3.0)
    assert now["equity"] == pytest.approx(now["cash"] + 48.0)
    believed = spark.createDataFrame([("a", "X", "long", 3), ("a", "TMF1", "short", 1), ("a", "Q", "flat", 0)], "account string, symbol string, state string, quantity int")
    assert [r["symbol"] for r in account.mismatches(believed, account.positions(out)).collect()] == ["TMF1"]


def test_an_account_folds_one_customers_orders(spark, small):
    rows = QUERIES["account_history"](spark, small).groupBy("account").count().collect()
    orders = spark.read.parquet(f"{small}/orders.parquet").groupBy("o_custkey").count().collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in orders}
    assert QUERIES["account_equity"](spark, small).count() == len(orders)


def test_limits_bind_entries_only(spark):
    why = lambda opens, n, pnl, since, q=1: spark.range(1).select(account.blocked(F.lit(opens), F.lit(q), F.lit(n), F.lit(pnl), F.lit(since), account.Limits(3, 100.0, 60.0))).first()[0]
    assert [why(True, 3, 0.0, 99.0), why(True, 0, -100.0, 99.0), why(True, 0, 0.0, 59.0), why(False, 9, -999.0, 0.0), why(False, 0, 0.0, 99.0, 0)] == ["trades a day", "daily loss", "cooling down", None, "no quantity"]


def test_accounts_fold_in_one_streaming_pass(spark, small):
    """F1, F8: no frame a group, one pass over fills for all figures, and an account longer than a batch of rows."""
    plan = QUERIES["account_equity"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 1
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    rows = [(a, "X", k, k, "share", "odd", True, True, 1, float(k)) for a in ("a", None, "b") for k in range(1, 12)]
    fills = spark.createDataFrame(rows, "account string, symbol string, ts int, seq int, market string, kind string, opens boolean, buys boolean, quantity int, price double")
    try:
        spark.conf.set(name, "4")
        last = account.positions(account.history(fills)).collect()
    finally:
        spark.conf.set(name, before)
    assert sorted((str(r["account"]), r["held"], round(r["average"], 9)) for r in last) == [("None", 11, 6.0), ("a", 11, 6.0), ("b", 11, 6.0)]


def test_forward_asof_never_folds_a_frame_anew(spark, small):
    """no frame reaches from a row to the end of its series, and trades are read once a side."""
    plan = QUERIES["asof_forward"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert plan.count("FileScan") == 2


def test_lines_of_user_code_are_series_that_are_cut_when_used():
    """a bar that only asks for a cross cuts no series; every other use sees the bars so far and no later one."""
    whole = pd.Series([1.0, 3.0, 2.0, 5.0, 9.0])
    bars = pd.DataFrame({"ts": range(5), "open": whole, "high": whole, "low": whole, "close": whole, "volume": whole})
    ctx = strategy.Context(bars, {}, {})
    ctx.i = 3
    line, cut = ctx.close, whole.iloc[:4]
    assert ctx.cross_up(line, 4.0) and not ctx.cross_down(line, ctx.sma(2)) and line._line_cut is None
    assert isinstance(line, pd.Series) and len(line) == 4 and line.iloc[-1] == 5.0 and list(line) == list(cut) and max(line) == 5.0
    for f in (lambda x: x + x, lambda x: 1 - x, lambda x: x > cut, lambda x: cut * x, lambda x: x.rolling(2).mean(), lambda x: pd.concat([x, x]), np.sqrt, lambda x: np.maximum(x, 2.0), abs):
        pd.testing.assert_series_equal(f(ctx.close), f(cut), check_names=False)


def test_events_are_typed_columns():
    """what a replay gives to Arrow has numbers as numbers, with gaps where an event has none."""
    none = [None] * 11
    frame = strategy.event_frame([("equity", 2, 20, *none, None, 1.5), ("fill", 3, 30, None, 9.0, None, "buy", 4, *[None] * 6, "open", None)], 7)
    assert frame["i"].dtype == "Int64" and frame["entry_price"].dtype == float and list(frame["symbol"]) == [7, 7]
    assert frame["quantity"].tolist() == [pd.NA, 4] or (frame["quantity"].isna().tolist() == [True, False] and frame["quantity"].iloc[1] == 4)
    assert strategy.event_frame([], 7).empty and list(strategy.event_frame([], 7).columns) == ["symbol", *strategy.EVENT]


def test_bars_on_which_nothing_can_happen_are_passed_over():
    """A replay's Python goes with the trades, not with the bars."""
    n, lines = 5_000, [0]
    prices = {x: np.linspace(10, 20, n) for x in ("open", "high", "low", "close", "exec_open", "exec_close")}
    enter, leave = np.zeros(n, bool), np.zeros(n, bool)
    enter[[100, 3_000]] = leave[[2_000, 4_000]] = True
    s = strategy.Strategy(entry=(("ma_cross_up", {}),), exit=(("ma_cross_down", {}),))
    ts = list(pd.date_range("2000-01-01", periods=n).date)

    def count(frame, event, arg):
        lines[0] += 1
        return count

    before = sys.gettrace()
    sys.settrace(count)
    try:
        moved, curve = strategy.moves(ts, prices, enter, leave, s)
    finally:
        sys.settrace(before)
    assert [(e[1], e[13]) for e in moved if e[0] == "trade"] == [(2_001, 1_900), (4_001, 1_000)] and lines[0] < 1_000
    frame = pd.DataFrame({"ts": ts, **prices, "_entry": enter, "_exit": leave})
    assert [e[15] for e in strategy.replay(frame, s) if e[0] == "equity"] == curve.tolist()
    a, b = strategy.moves_frame(moved, ts, curve, "x"), strategy.event_frame(strategy.replay(frame, s), "x")
    order = lambda f: f.sort_values(["event", "i"], ignore_index=True, kind="stable")
    pd.testing.assert_frame_equal(order(a), order(b))
