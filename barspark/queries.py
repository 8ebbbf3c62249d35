"""The queries of the driver contract, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.functions import indicators as I
from barspark.functions import scalars as S
from barspark.functions.conditions import CONDITIONS
from barspark.functions.scan import Scan, with_scans
from barspark.functions.trailing import Trailing, dealt, with_trailing
from barspark.operators import account, asof, band, detect, difference, intents, isolated, levels, metrics, orders, patterns, progress, resample, screener, strategy, sweep
from barspark.plans.compiler import with_conditions
from barspark.sources import barstore, contracts, periodstore, sqlite
from barspark.sources import tables as T
from barspark.sources.scratch import folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BARS = """bars AS (
  SELECT symbol, ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume
  FROM (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS px, l_quantity AS q,
               row(l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k FROM lineitem)
  GROUP BY symbol, ts)"""
NUMBERED = BARS + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM bars)"
W = "(PARTITION BY symbol ORDER BY ts)"


def last(n: int, back: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + back} PRECEDING AND {f'{back} PRECEDING' if back else 'CURRENT ROW'})"


def full(f: str, x: str, n: int, back: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {last(n, back)} = {n} THEN {f}({x}) OVER {last(n, back)} END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


OHLCV = ("open", "high", "low", "close", "volume")
# Prices of single trades are quotients that both engines compute alike; they are compared as they are.
R_OHLCV = ", ".join(OHLCV)


# ---------------------------------------------------------------- bars


@query("entry_ma_cross", f"""WITH {BARS}, m AS (SELECT symbol, ts, close, {full('avg', 'close', 5)} AS fast, {full('avg', 'close', 20)} AS slow FROM bars),
 p AS (SELECT *, lag(fast) OVER {W} AS pf, lag(slow) OVER {W} AS ps FROM m)
 SELECT symbol, ts, close, round(fast, 4) AS fast, round(slow, 4) AS slow FROM p WHERE pf <= ps AND fast > slow""")  # fmt: skip
def entry_ma_cross(spark: SparkSession, d: str) -> DataFrame:
    rows = T.daily_bars(spark, d).select("symbol", "ts", "close", I.sma("close", 5).alias("fast"), I.sma("close", 20).alias("slow"))
    rows = rows.withColumn("_up", I.cross_up("fast", "slow")).where("_up").drop("_up")
    return rounded(rows, "fast", "slow")


@query("bars_daily", f"WITH {BARS} SELECT symbol, ts, {R_OHLCV} FROM bars")
def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return T.daily_bars(spark, d)


def _tick_sql(bucket: str, where: str = "true") -> str:
    return f"""SELECT event_type AS symbol, {bucket} AS ts, round(arg_min(value, row(ts, event_id)), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low,
 round(arg_max(value, row(ts, event_id)), 4) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE {where} GROUP BY 1, 2"""


MINUTE = "(date_part('hour', ts) * 60 + date_part('minute', ts))"
TICK_BARS = {
    "bars_15m": ("15m", False, _tick_sql("time_bucket(INTERVAL 15 MINUTE, ts)")),
    "bars_hour": ("1h", False, _tick_sql("time_bucket(INTERVAL 1 HOUR, ts)")),
    "bars_week": ("week", False, _tick_sql("CAST(date_trunc('week', ts) AS DATE)")),
    "bars_month": ("month", False, _tick_sql("CAST(date_trunc('month', ts) AS DATE)")),
    "bars_session": ("session", False, _tick_sql(f"CAST(ts AS DATE) + CASE WHEN {MINUTE} > 825 THEN 1 ELSE 0 END")),
    "bars_day_session": ("day", True, _tick_sql("CAST(ts AS DATE)", f"{MINUTE} BETWEEN 525 AND 825")),
}
for _name, (_frame, _day, _sql) in TICK_BARS.items():
    query(_name, _sql)(lambda spark, d, f=_frame, o=_day: rounded(resample.from_ticks(T.ticks(spark, d), f, o), *OHLCV))


@query("bars_two_level", f"""WITH {BARS} SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")  # fmt: skip
def bars_two_level(spark: SparkSession, d: str) -> DataFrame:
    return resample.coarser(T.daily_bars(spark, d), "month")


RAW_FUTURES = """raw AS (SELECT CAST(ts AS DATE) AS day, event_type AS product, strftime(CAST(ts AS DATE) + to_months(CAST(user_id % 3 AS INTEGER)), '%Y%m') AS month,
 CASE WHEN date_part('hour', ts) < 14 THEN 'regular' ELSE 'after' END AS session, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2, 3, 4)"""


@query("continuous_contract", f"""WITH {RAW_FUTURES}, r AS (SELECT *, dense_rank() OVER (PARTITION BY product, day ORDER BY month) AS k FROM raw),
 m AS (SELECT *, max(k) OVER (PARTITION BY product, day) AS most FROM r)
 SELECT product AS symbol, day AS ts, coalesce(max(open) FILTER (session = 'after'), max(open) FILTER (session = 'regular')) AS open, max(high) AS high, min(low) AS low,
 coalesce(max(close) FILTER (session = 'regular'), max(close) FILTER (session = 'after')) AS close, sum(volume) AS volume
 FROM m WHERE k = least(2, most) GROUP BY 1, 2""")  # fmt: skip
def continuous_contract(spark: SparkSession, d: str) -> DataFrame:
    return resample.continuous_contract(T.raw_futures(spark, d), rank=2)


SERIES_SQL = f"""{RAW_FUTURES}, rk AS (SELECT *, dense_rank() OVER (PARTITION BY product, day ORDER BY month) AS k FROM raw), mo AS (SELECT *, max(k) OVER (PARTITION BY product, day) AS most FROM rk),
 series AS (SELECT upper(product) AS product, s AS session, CAST(r AS INTEGER) AS rank, day AS ts, coalesce(max(open) FILTER (session = 'after'), max(open) FILTER (session = 'regular')) AS open, max(high) AS high, min(low) AS low,
  coalesce(max(close) FILTER (session = 'regular'), max(close) FILTER (session = 'after')) AS close, sum(volume) AS volume
  FROM mo, (SELECT unnest([1, 2, 3]) AS r), (SELECT unnest(['all', 'day']) AS s) WHERE k = least(r, most) AND (s = 'all' OR session = 'regular') GROUP BY ALL)"""


@query("contract_series", f"WITH {SERIES_SQL} SELECT * FROM series")
def contract_series(spark: SparkSession, d: str) -> DataFrame:
    return contracts.contract_bars(T.raw_futures(spark, d))


@query("contract_load", f"WITH {SERIES_SQL} SELECT ts, open, high, low, CASE WHEN dayofmonth(ts) = 5 THEN close + 1 ELSE close END AS close, volume FROM series WHERE product = 'CLICK' AND session = 'day' AND rank = 2")
def contract_load(spark: SparkSession, d: str) -> DataFrame:
    """All series saved but their last days, those and corrected fifths merged in two loads, one series read back."""
    store = contracts.ContractStore(spark, folder(spark, "contracts"))
    series = written(contracts.contract_bars(T.raw_futures(spark, d)), "series")
    store.save(series.where("dayofmonth(ts) < 20"))
    store.merge(series.where("dayofmonth(ts) >= 15"))
    store.merge(series.where("dayofmonth(ts) = 5").withColumn("close", F.col("close") + 1))
    return store.load("click", session="day", rank=2)


@query("contract_extend", f"""WITH {SERIES_SQL}, d AS (SELECT product AS symbol, * EXCLUDE (product) FROM series WHERE session = 'all' AND rank = 1), t AS (SELECT upper(event_type) AS symbol, * FROM events WHERE CAST(ts AS DATE) >= (SELECT min(CAST(ts AS DATE)) + 10 FROM events)),
 p AS (SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t WHERE symbol <> 'CLICK' GROUP BY 1, 2),
 w AS (SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS bar, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM d GROUP BY 1, 2), f AS (SELECT symbol, min(ts) AS a FROM p GROUP BY 1)
 SELECT * FROM p UNION ALL SELECT w.* FROM w LEFT JOIN f USING (symbol) WHERE a IS NULL OR bar < a""")  # fmt: skip
def contract_extend(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars from ticks that begin on the eleventh day, and for one product never, behind weeks of daily bars."""
    ticks = T.ticks(spark, d).withColumn("symbol", F.upper("symbol"))
    first = ticks.agg(F.date_add(F.min(F.to_date("ts")), 10).alias("_first"))  # one row
    own = resample.from_ticks(ticks.crossJoin(F.broadcast(first)).where("to_date(ts) >= _first and symbol <> 'CLICK'"), "week")
    daily = contracts.contract_bars(T.raw_futures(spark, d), ranks=(1,), sessions=("all",)).withColumnRenamed("product", "symbol")
    return contracts.extended(own, daily, "week")


@query("session_regime", f"""WITH {BARS}, g AS (SELECT symbol, ts, ts < DATE '1998-05-15' AS early, abs(open - lag(close) OVER {W}) / lag(close) OVER {W} * 100 AS gap FROM bars),
 a AS (SELECT symbol, count(*) AS b, count(gap) AS c, max(ts) AS hi, count(gap) FILTER (early) AS x, count(gap) FILTER (NOT early) AS y,
  quantile_cont(gap, 0.5) FILTER (early) AS p, quantile_cont(gap, 0.5) FILTER (NOT early) AS q, quantile_cont(gap, 0.5) AS m FROM g GROUP BY symbol)
 SELECT symbol, CASE WHEN b < 30 OR c = 0 THEN 'unknown' WHEN x >= 20 AND y >= 20 THEN CASE WHEN q > 1e-9 AND p / q >= 2.5 THEN 'mixed' ELSE 'day_only' END
  WHEN hi < DATE '1998-05-15' THEN 'day_only' WHEN m < 0.2 THEN 'all_session' ELSE 'day_only' END AS regime,
  round(CASE WHEN x >= 20 AND y >= 20 THEN p END, 4) AS pre_gap, round(CASE WHEN x >= 20 AND y >= 20 THEN q WHEN hi >= DATE '1998-05-15' THEN m END, 4) AS post_gap,
  round(CASE WHEN x >= 20 AND y >= 20 AND q > 1e-9 THEN p / q END, 4) AS ratio FROM a""")  # fmt: skip
def session_regime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.session_regime(T.daily_bars(spark, d), "1998-05-15"), "pre_gap", "post_gap", "ratio")


@query("price_adjust", f"""WITH {BARS}, j AS (SELECT *, CASE WHEN dayofmonth(ts) <= 20 THEN close * (1 - 0.0001::DOUBLE * date_diff('day', ts, DATE '2002-01-01')) / close END AS r FROM bars),
 f AS (SELECT *, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts), first_value(r IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS s FROM j),
 l AS (SELECT *, last_value(s) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM f)
 SELECT symbol, ts, {', '.join(f'{c} * (CASE WHEN z > 0 THEN s / z ELSE s END) AS {c}' for c in OHLCV[:4])}, volume / (CASE WHEN z > 0 THEN s / z ELSE s END) AS volume FROM l""")  # fmt: skip
def price_adjust(spark: SparkSession, d: str) -> DataFrame:
    bars = T.daily_bars(spark, d)
    fall = 1 - 0.0001 * F.datediff(F.lit("2002-01-01").cast("date"), "ts")
    adjusted = bars.where(F.dayofmonth("ts") <= 20).select("symbol", "ts", (F.col("close") * fall).alias("adj_close"))
    return resample.adjusted(bars, adjusted)


# ---------------------------------------------------------------- store


@query("store_scan", f"WITH {BARS} SELECT symbol, ts, {R_OHLCV} FROM bars WHERE symbol = 3 AND ts BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def store_scan(spark: SparkSession, d: str) -> DataFrame:
    return barstore.scan(T.daily_bars(spark, d), symbol=3, start="1996-01-01", end="1997-06-30")


@query("store_coverage", f"WITH {BARS} SELECT symbol, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS bars FROM bars GROUP BY symbol")
def store_coverage(spark: SparkSession, d: str) -> DataFrame:
    return barstore.coverage(T.daily_bars(spark, d))


@query("store_missing", f"""WITH {BARS}, c AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol)
 SELECT symbol, b AS covered_to, CASE WHEN a > DATE '1995-01-15' THEN DATE '1995-01-15' WHEN b >= DATE '2001-10-25' THEN NULL ELSE b + 1 END AS need_from FROM c""")  # fmt: skip
def store_missing(spark: SparkSession, d: str) -> DataFrame:
    return barstore.missing_ranges(T.daily_bars(spark, d), "1995-01-15", "2001-10-25")


def _loads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars = T.daily_bars(spark, d)
    old = bars.where("ts < date'1999-01-01'")
    return old, bars.where("ts >= date'1998-10-01'").withColumn("close", F.col("close") + 1)


@query("store_upsert", f"WITH {BARS} SELECT symbol, ts, open, high, low, CASE WHEN ts >= DATE '1998-10-01' THEN close + 1 ELSE close END AS close, volume FROM bars")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    return barstore.upserted(*_loads(spark, d), key=["symbol", "ts"])


_REPLACE = "SELECT symbol, ts, close FROM (SELECT * FROM o WHERE {keep} UNION ALL SELECT * FROM x)"
_REPLACE_CTE = BARS + ", o AS (SELECT symbol, ts, close FROM bars WHERE ts < DATE '1999-01-01'), x AS (SELECT symbol, ts, close + 1 AS close FROM bars WHERE ts >= DATE '1998-10-01' AND symbol % 2 = 0)"


@query("store_replace_dates", f"WITH {_REPLACE_CTE} " + _REPLACE.format(keep="ts NOT IN (SELECT ts FROM x)"))
def store_replace_dates(spark: SparkSession, d: str) -> DataFrame:
    old, new = _loads(spark, d)
    return barstore.replaced(old, new.where("symbol % 2 = 0"), ["ts"]).select("symbol", "ts", "close")


@query("store_replace_keys", f"WITH {_REPLACE_CTE} " + _REPLACE.format(keep="(symbol, ts) NOT IN (SELECT (symbol, ts) FROM x)"))
def store_replace_keys(spark: SparkSession, d: str) -> DataFrame:
    old, new = _loads(spark, d)
    return barstore.replaced(old, new.where("symbol % 2 = 0"), ["symbol", "ts"]).select("symbol", "ts", "close")


@query("store_prepend", f"""WITH {BARS}, p AS (SELECT symbol, ts, close + 1 AS close FROM bars WHERE ts >= DATE '1998-10-01'), f AS (SELECT symbol, min(ts) AS a FROM p GROUP BY symbol)
 SELECT symbol, ts, close FROM p UNION ALL SELECT b.symbol, b.ts, b.close FROM bars b LEFT JOIN f USING (symbol) WHERE b.ts < DATE '1999-01-01' AND (f.a IS NULL OR b.ts < f.a)""")  # fmt: skip
def store_prepend(spark: SparkSession, d: str) -> DataFrame:
    old, new = _loads(spark, d)
    return barstore.prepended(new, old).select("symbol", "ts", "close")


# ---------------------------------------------------------------- indicators


@query("ind_window", f"""WITH {BARS}, t AS (SELECT *, close - lag(close) OVER {W} AS dc,
  greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr, CASE WHEN volume = 0 THEN 1 ELSE volume END AS v FROM bars),
 u AS (SELECT *, greatest(dc, 0) AS g, greatest(-dc, 0) AS l FROM t),
 s AS (SELECT symbol, ts, close, {full('avg', 'close', 20)} AS sma, {full('stddev_samp', 'close', 20)} AS sd, {full('max', 'high', 20)} AS hi, {full('min', 'low', 20)} AS lo,
  {full('avg', 'tr', 14)} AS atr, (close / lag(close, 10) OVER {W} - 1) * 100 AS roc,
  sum((high + low + close) / 3 * v) OVER {W} / sum(v) OVER {W} AS vwap,
  CASE WHEN count(dc) OVER {last(14)} = 14 THEN avg(g) OVER {last(14)} END AS ga, CASE WHEN count(dc) OVER {last(14)} = 14 THEN avg(l) OVER {last(14)} END AS la FROM u)
 SELECT symbol, ts, round(sma, 4) AS sma, round(sd, 4) AS sd, hi, lo, round(atr, 4) AS atr, round(roc, 4) AS roc, round(vwap, 4) AS vwap,
  round(sma + 2 * sd, 4) AS upper, round(sma - 2 * sd, 4) AS lower, round(4 * sd / sma * 100, 4) AS width, round(CASE WHEN la > 0 THEN 100 - 100 / (1 + ga / la) END, 4) AS rsi FROM s""")  # fmt: skip
def ind_window(spark: SparkSession, d: str) -> DataFrame:
    # What looks at one bar before or at all is cheap as a window; trailing lines come from kernels.
    rows = dealt(T.daily_bars(spark, d)).withColumns({"delta": I.difference("close"), "true_range": I.true_range(), "roc": I.roc("close", 10), "vwap": I.vwap()})
    moves = {name: F.when(F.col("delta").isNotNull(), F.greatest(x, F.lit(0.0))) for name, x in (("up", F.col("delta")), ("down", -F.col("delta")))}
    rows = rows.withColumns(moves).select("symbol", "ts", "high", "low", "close", "true_range", "up", "down", "roc", "vwap")
    lines = {
        "sma": Trailing("mean", "close", 20), "sd": Trailing("deviation", "close", 20), "hi": Trailing("highest", "high", 20), "lo": Trailing("lowest", "low", 20),
        "atr": Trailing("mean", "true_range", 14), "gain": Trailing("mean", "up", 14), "loss": Trailing("mean", "down", 14),
    }
    upper, lower = F.col("sma") + F.col("sd") * 2.0, F.col("sma") - F.col("sd") * 2.0
    rsi = 100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("gain", "loss"))
    out = with_trailing(rows, lines).select(
        "symbol", "ts", "sma", "sd", "hi", "lo", "atr", "roc", "vwap", upper.alias("upper"), lower.alias("lower"), (F.try_divide(upper - lower, F.col("sma")) * 100).alias("width"), rsi.alias("rsi")
    )
    return rounded(out, *[c for c in out.columns if c not in ("symbol", "ts", "hi", "lo")])


MA_PERIODS = (5, 10, 20, 60, 120, 240)
_WMA = lambda n: f"CASE WHEN count(close) OVER {last(n)} = {n} THEN ({' + '.join(f'{n - k} * lag(close, {k}) OVER {W}' for k in range(n))}) / {n * (n + 1) / 2} END"


@query("ind_multi_ma", f"WITH {BARS} SELECT symbol, ts, {', '.join(f'round({full(chr(97) + chr(118) + chr(103), chr(99) + chr(108) + chr(111) + chr(115) + chr(101), n)}, 7) AS sma_{n}' for n in MA_PERIODS)}, round({_WMA(5)}, 7) AS wma_5, round({_WMA(20)}, 7) AS wma_20 FROM bars")
def ind_multi_ma(spark: SparkSession, d: str) -> DataFrame:
    lines = {f"sma_{n}": Trailing("mean", "close", n) for n in MA_PERIODS} | {f"wma_{n}": Trailing("weighted", "close", n) for n in (5, 20)}
    out = with_trailing(dealt(T.daily_bars(spark, d).select("symbol", "ts", "close")), lines).select("symbol", "ts", *lines)
    # Averages of so many prices in cents are multiples of fractions none of which lies half way at the seventh place.
    return rounded(out, *out.columns[2:], places=7)


def scanned(spark: SparkSession, d: str, *scans: Scan) -> DataFrame:
    """symbol, ts and the lines of daily bars; a bar has a trade at least."""
    bars = T.daily_bars(spark, d).select("symbol", "ts", *dict.fromkeys(c for s in scans for c in s.inputs))
    return with_scans(bars, scans, made_of=T.trades(spark, d).select("symbol"))


EMA_SQL = f"""WITH RECURSIVE {NUMBERED}, r AS (SELECT symbol, i, ts, close AS e20, close AS e12, close AS e26, 0.0::DOUBLE AS sig FROM n WHERE i = 1
 UNION ALL SELECT n.symbol, n.i, n.ts, r.e20 + 2.0 / 21 * (n.close - r.e20), r.e12 + 2.0 / 13 * (n.close - r.e12), r.e26 + 2.0 / 27 * (n.close - r.e26),
  r.sig + 0.2 * ((r.e12 + 2.0 / 13 * (n.close - r.e12)) - (r.e26 + 2.0 / 27 * (n.close - r.e26)) - r.sig) FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)"""


@query("ind_ema_macd", EMA_SQL + " SELECT symbol, ts, round(e20, 4) AS ema_20, round(e12 - e26, 4) AS dif, round(sig, 4) AS signal, round(e12 - e26 - sig, 4) AS hist FROM r")
def ind_ema_macd(spark: SparkSession, d: str) -> DataFrame:
    s = Scan("macd", (12, 26, 9))
    rows = scanned(spark, d, Scan("ema", (20,)), s)
    out = rows.select("symbol", "ts", "ema_20", *(F.col(f"{s.prefix}_{x}").alias(x) for x in ("dif", "signal", "hist")))
    return rounded(out, *out.columns[2:])


KD_SQL = f"""WITH RECURSIVE {BARS}, h AS (SELECT symbol, ts, high, low, close, {full('max', 'high', 9)} AS hh, {full('min', 'low', 9)} AS ll FROM bars),
 n AS (SELECT *, CASE WHEN hh > ll THEN 100 * (close - ll) / (hh - ll) END AS rsv, row_number() OVER {W} AS i FROM h),
 r AS (SELECT symbol, i, ts, rsv, rsv AS k, rsv AS d, 1.0::DOUBLE AS w FROM n WHERE i = 1
  UNION ALL SELECT symbol, i, ts, rsv, k2, CASE WHEN k2 IS NULL THEN NULL WHEN d IS NULL THEN k2 ELSE d + (k2 - d) / 3 END, w2 FROM (
   SELECT n.symbol, n.i, n.ts, n.rsv, r.d, CASE WHEN n.rsv IS NULL THEN r.w * 2 / 3 ELSE 1.0 END AS w2,
    CASE WHEN n.rsv IS NULL THEN r.k WHEN r.k IS NULL THEN n.rsv ELSE (r.w * 2 / 3 * r.k + n.rsv / 3) / (r.w * 2 / 3 + 1.0 / 3) END AS k2
   FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1))"""


@query("ind_kdj", KD_SQL + " SELECT symbol, ts, round(rsv, 4) AS rsv, round(k, 4) AS k, round(d, 4) AS d, round(3 * k - 2 * d, 4) AS j FROM r")
def ind_kdj(spark: SparkSession, d: str) -> DataFrame:
    s = Scan("kdj", (9, 3, 3))
    out = scanned(spark, d, s).select("symbol", "ts", *(F.col(f"{s.prefix}_{x}").alias(x) for x in ("rsv", "k", "d", "j")))
    return rounded(out, *out.columns[2:])


DMI_SQL = f"""WITH RECURSIVE {BARS}, p AS (SELECT *, lag(high) OVER {W} AS ph, lag(low) OVER {W} AS pl, lag(close) OVER {W} AS pc, row_number() OVER {W} AS i FROM bars),
 n AS (SELECT symbol, ts, i, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
   CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM p),
 r AS (SELECT symbol, i, ts, tr AS a, pdm AS p, mdm AS m FROM n WHERE i = 1 UNION ALL
  SELECT n.symbol, n.i, n.ts, r.a + 2.0 / 15 * (n.tr - r.a), r.p + 2.0 / 15 * (n.pdm - r.p), r.m + 2.0 / 15 * (n.mdm - r.m) FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1),
 x AS (SELECT symbol, i, ts, CASE WHEN a <> 0 THEN 100 * p / a END AS pdi, CASE WHEN a <> 0 THEN 100 * m / a END AS mdi FROM r),
 y AS (SELECT *, CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM x),
 z AS (SELECT symbol, i, ts, pdi, mdi, dx AS adx, 1.0::DOUBLE AS w FROM y WHERE i = 1 UNION ALL
  SELECT y.symbol, y.i, y.ts, y.pdi, y.mdi, CASE WHEN y.dx IS NULL THEN z.adx WHEN z.adx IS NULL THEN y.dx ELSE (z.w * 13 / 15 * z.adx + 2.0 / 15 * y.dx) / (z.w * 13 / 15 + 2.0 / 15) END,
   CASE WHEN y.dx IS NULL THEN z.w * 13 / 15 ELSE 1.0 END FROM z JOIN y ON y.symbol = z.symbol AND y.i = z.i + 1)"""


@query("ind_dmi", DMI_SQL + " SELECT symbol, ts, round(pdi, 4) AS plus, round(mdi, 4) AS minus, round(adx, 4) AS adx FROM z")
def ind_dmi(spark: SparkSession, d: str) -> DataFrame:
    s = Scan("dmi", (14,))
    out = scanned(spark, d, s).select("symbol", "ts", *(F.col(f"{s.prefix}_{x}").alias(x) for x in ("plus", "minus", "adx")))
    return rounded(out, *out.columns[2:])


JAE_SQL = f"""WITH RECURSIVE {NUMBERED}, c AS (SELECT symbol, ts, i, close - lag(close) OVER {W} AS dc FROM n),
 r AS (SELECT symbol, i, ts, greatest(dc, 0) AS g, greatest(-dc, 0) AS l FROM c WHERE i = 2 UNION ALL
  SELECT c.symbol, c.i, c.ts, r.g + (greatest(c.dc, 0) - r.g) / 14, r.l + (greatest(-c.dc, 0) - r.l) / 14 FROM r JOIN c ON c.symbol = r.symbol AND c.i = r.i + 1),
 a AS (SELECT n.symbol, n.i, n.ts, CASE WHEN l = 0 AND g = 0 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS a FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i),
 z AS (SELECT symbol, i, ts, a, a AS e, 1.0::DOUBLE AS w FROM a WHERE i = 1 UNION ALL
  SELECT a.symbol, a.i, a.ts, a.a, CASE WHEN a.a IS NULL THEN z.e WHEN z.e IS NULL THEN a.a ELSE (z.w * 59 / 61 * z.e + 2.0 / 61 * a.a) / (z.w * 59 / 61 + 2.0 / 61) END,
   CASE WHEN a.a IS NULL THEN z.w * 59 / 61 ELSE 1.0 END FROM z JOIN a ON a.symbol = z.symbol AND a.i = z.i + 1)"""


@query("ind_rsi_wilder", JAE_SQL + " SELECT symbol, ts, round(a, 4) AS a, round(e, 4) AS e FROM z")
def ind_rsi_wilder(spark: SparkSession, d: str) -> DataFrame:
    s = Scan("jae", (14, 9, 3, 3, 60))
    out = scanned(spark, d, s).select("symbol", "ts", *(F.col(f"{s.prefix}_{x}").alias(x) for x in ("a", "e")))
    return rounded(out, *out.columns[2:])


def jae_signals(bars: DataFrame, band: float = 5.0, eps: float = 0.5, look: int = 5, made_of: DataFrame | None = None) -> DataFrame:
    """symbol, ts, a, j, e, trend and the three crosses of the lines: position of e first, its slope within the band. made_of is that of with_scans."""
    s = Scan("jae", (14, 9, 3, 3, 60))
    rows = with_scans(bars.select("symbol", "ts", *s.inputs), [s], made_of=made_of).select("symbol", "ts", *(F.col(f"{s.prefix}_{x}").alias(x) for x in "aje"))
    # Each look back once: a window that several expressions name is computed for each of them.
    rows = rows.withColumns({f"_p{x}": I.lag(x) for x in "aje"} | {"_then": F.coalesce(I.lag("e", look), F.first("e", True).over(I.BARS.upto()))})
    slope = F.col("e") - F.col("_then")
    trend = F.when(F.col("e").isNull(), "flat").when(F.col("e") >= 50 + band, "up").when(F.col("e") <= 50 - band, "down").when(slope > eps, "up").when(slope < -eps, "down").otherwise("flat")

    def cross(x: str, y: str) -> Column:
        was, now = (F.col(f"_p{x}"), F.col(f"_p{y}")), (F.col(x), F.col(y))
        return F.when((was[0] <= was[1]) & (now[0] > now[1]), 1).when((was[0] >= was[1]) & (now[0] < now[1]), -1).otherwise(0).alias(f"{x}_{y}")

    return rows.select("symbol", "ts", "a", "j", "e", trend.alias("trend"), cross("j", "a"), cross("a", "e"), cross("j", "e"))


KD_PART = KD_SQL.removeprefix("WITH RECURSIVE " + BARS + ", ").replace("h AS (", "kh AS (", 1).replace("n AS (", "kn AS (", 1).replace(" FROM h)", " FROM kh)").replace("r AS (", "kr AS (", 1).replace("FROM n WHERE", "FROM kn AS n WHERE").replace("FROM r JOIN n ON", "FROM kr AS r JOIN kn AS n ON")
JAE_TREND_SQL = JAE_SQL + ", " + KD_PART + f""", l AS (SELECT z.symbol, z.ts, z.i, z.a, z.e, 3 * k - 2 * d AS j FROM z JOIN kr ON kr.symbol = z.symbol AND kr.i = z.i),
 m AS (SELECT *, e - coalesce(lag(e, 5) OVER {W}, first_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS slope,
  lag(a) OVER {W} AS pa, lag(e) OVER {W} AS pe, lag(j) OVER {W} AS pj FROM l)
 SELECT symbol, ts, round(a, 4) AS a, round(j, 4) AS j, round(e, 4) AS e, CASE WHEN e IS NULL THEN 'flat' WHEN e >= 55 THEN 'up' WHEN e <= 45 THEN 'down' WHEN slope > 0.5 THEN 'up' WHEN slope < -0.5 THEN 'down' ELSE 'flat' END AS trend,
  """ + ", ".join(f"CAST(CASE WHEN p{x} <= p{y} AND {x} > {y} THEN 1 WHEN p{x} >= p{y} AND {x} < {y} THEN -1 ELSE 0 END AS INTEGER) AS {x}_{y}" for x, y in ("ja", "ae", "je")) + " FROM m"


@query("ind_jae_trend", JAE_TREND_SQL)
def ind_jae_trend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jae_signals(T.daily_bars(spark, d), made_of=T.trades(spark, d).select("symbol")), "a", "j", "e")


# ---------------------------------------------------------------- conditions

FLOW = ("foreign_net", "trust_net", "inst_total")


def with_all_flow(spark: SparkSession, d: str) -> DataFrame:
    """Bars with flow of the day before, the market's margin and the foreign position in futures."""
    bars = asof.with_flow(T.daily_bars(spark, d), T.stock_flow(spark, d), FLOW)
    bars = asof.with_market_series(bars, T.market_margin(spark, d), ["margin_balance"])
    # The month of events is spread over the years of trades, a day of theirs to 80 of these.
    futures = T.futures_by_investor(T.futures_flow(spark, d), "purchase").withColumn("ts", F.date_add(F.lit("1995-01-02").cast("date"), F.datediff("ts", F.lit("2024-01-01").cast("date")) * 80))
    return asof.with_market_series(bars, futures, ["fut_foreign_oi"])


def _tests_sql(tests: dict[str, str], source: str) -> str:
    return f"{source} SELECT symbol, ts, {', '.join(f'coalesce({p}, false) AS {n}' for n, p in tests.items())} FROM q"


def _tested(bars: DataFrame, names: list[str], params: dict[str, dict] | None = None) -> DataFrame:
    """symbol, ts and each condition on every bar."""
    rows = with_conditions(bars, {n: (n, (params or {}).get(n, {})) for n in names}, ["symbol", "ts"])
    return rows.select("symbol", "ts", *(F.coalesce(n, F.lit(False)).alias(n) for n in names))


def _counted(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy("symbol").agg(*(F.count_if(n).alias(n) for n in names))


def _up(a: str, b: str) -> str:
    return f"lag({a}) OVER {W} <= lag({b}) OVER {W} AND {a} > {b}"


_A = lambda n: full("avg", "close", n)
PRICE_SQL_COLUMNS = {
    "s5": _A(5), "s20": _A(20), "s60": _A(60), "sd": full("stddev_samp", "close", 20), "hb": full("max", "high", 20, 1), "lb": full("min", "low", 20, 1), "v20": full("avg", "volume", 20),
    "up3": f"CASE WHEN count(*) OVER {last(3)} = 3 THEN min(CASE WHEN close > open THEN 1 ELSE 0 END) OVER {last(3)} END", "dn3": f"CASE WHEN count(*) OVER {last(3)} = 3 THEN min(CASE WHEN close < open THEN 1 ELSE 0 END) OVER {last(3)} END",
    "ga": f"CASE WHEN count(dc) OVER {last(14)} = 14 THEN avg(greatest(dc, 0)) OVER {last(14)} END", "la": f"CASE WHEN count(dc) OVER {last(14)} = 14 THEN avg(greatest(-dc, 0)) OVER {last(14)} END",
}
PRICE_SQL_TESTS = {
    "ma_cross_up": "s5 > s20 AND p_s5 <= p_s20", "ma_cross_down": "s5 < s20 AND p_s5 >= p_s20", "price_break_high": "close > hb", "price_break_low": "close < lb",
    "price_above": "close > 2000", "price_below": "close < 1500", "bb_cross_upper": "close > s20 + 2 * sd AND p_close <= p_s20 + 2 * p_sd", "bb_cross_lower": "close < s20 - 2 * sd AND p_close >= p_s20 - 2 * p_sd",
    "rsi_above": "rsi > 70", "rsi_below": "rsi < 30", "price_cross_up_ma": "close > s20 AND p_close <= p_s20", "price_cross_down_ma": "close < s20 AND p_close >= p_s20",
    "price_above_ma": "close > s20", "price_below_ma": "close < s20", "ma_slope_up": "s20 > s20_3", "ma_slope_down": "s20 < s20_3", "ma_align_bull": "s5 > s20 AND s20 > s60", "ma_align_bear": "s5 < s20 AND s20 < s60",
    "volume_above_ma": "i >= 21 AND v20 > 0 AND volume > v20 * 1.5", "volume_below_ma": "i >= 21 AND v20 > 0 AND volume < v20 * 0.7", "consecutive_up": "up3 = 1", "consecutive_down": "dn3 = 1",
    "pct_change_above": "p_close <> 0 AND (close / p_close - 1) * 100 >= 3", "pct_change_below": "p_close <> 0 AND (close / p_close - 1) * 100 <= -3", "rsi_cross_up": "rsi > 50 AND p_rsi <= 50", "rsi_cross_down": "rsi < 50 AND p_rsi >= 50",
    "bb_squeeze": "s20 <> 0 AND 4 * sd / s20 * 100 < 8", "bb_expand": "s20 <> 0 AND 4 * sd / s20 * 100 > 15", "always_true": "true", "inside_bar": "high <= p_high AND low >= p_low",
    "gap_up": "p_high <> 0 AND open > p_high", "gap_down": "p_low <> 0 AND open < p_low",
}
PRICE_SQL = f"""WITH {BARS}, c AS (SELECT *, close - lag(close) OVER {W} AS dc, row_number() OVER {W} AS i FROM bars),
 m AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in PRICE_SQL_COLUMNS.items())} FROM c), x AS (SELECT *, CASE WHEN la > 0 THEN 100 - 100 / (1 + ga / la) END AS rsi FROM m),
 q AS (SELECT *, lag(s20, 3) OVER {W} AS s20_3, {', '.join(f'lag({k}) OVER {W} AS p_{k}' for k in ('close', 'high', 'low', 's5', 's20', 'sd', 'rsi'))} FROM x)"""
SCANNED = ("kd_cross_up", "kd_cross_down", "kd_above", "kd_below", "kd_cross_up_low", "kd_cross_down_high", "macd_cross_up", "macd_cross_down", "macd_hist_above_zero", "macd_hist_below_zero")


@query("cond_price", _tests_sql(PRICE_SQL_TESTS, PRICE_SQL))
def cond_price(spark: SparkSession, d: str) -> DataFrame:
    return _tested(T.daily_bars(spark, d), list(PRICE_SQL_TESTS), {"price_above": {"value": 2000}, "price_below": {"value": 1500}})


KD_TESTS = {"kd_cross_up": "k > d AND p_k <= p_d", "kd_cross_down": "k < d AND p_k >= p_d", "kd_above": "k > 80", "kd_below": "k < 20", "kd_cross_up_low": "k > d AND p_k <= p_d AND k < 30", "kd_cross_down_high": "k < d AND p_k >= p_d AND k > 70"}


@query("cond_kd", _tests_sql(KD_TESTS, KD_SQL + f", q AS (SELECT *, lag(k) OVER {W} AS p_k, lag(d) OVER {W} AS p_d FROM r)"))
def cond_kd(spark: SparkSession, d: str) -> DataFrame:
    return _tested(T.daily_bars(spark, d), list(KD_TESTS))


MACD_TESTS = {"macd_cross_up": "dif > sig AND p_dif <= p_sig", "macd_cross_down": "dif < sig AND p_dif >= p_sig", "macd_hist_above_zero": "dif - sig > 0 AND p_dif - p_sig <= 0", "macd_hist_below_zero": "dif - sig < 0 AND p_dif - p_sig >= 0"}


@query("cond_macd", _tests_sql(MACD_TESTS, EMA_SQL + f", y AS (SELECT symbol, ts, e12 - e26 AS dif, sig FROM r), q AS (SELECT *, lag(dif) OVER {W} AS p_dif, lag(sig) OVER {W} AS p_sig FROM y)"))
def cond_macd(spark: SparkSession, d: str) -> DataFrame:
    return _tested(T.daily_bars(spark, d), list(MACD_TESTS))


FLOW_SQL = """flow AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ts,
  CAST(sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS BIGINT) AS foreign_net,
  CAST(sum(CASE l_linestatus WHEN 'O' THEN l_quantity ELSE -l_quantity END) AS BIGINT) AS trust_net,
  CAST(sum(CASE l_returnflag WHEN 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS dealer_net FROM lineitem GROUP BY 1, 2)"""
MARGIN_SQL = """md AS (SELECT CAST(o_orderdate AS DATE) AS ts, CAST(sum(CASE o_orderstatus WHEN 'O' THEN floor(o_totalprice) WHEN 'F' THEN -floor(o_totalprice) ELSE 0 END) AS BIGINT) AS x FROM orders GROUP BY 1),
 margin AS (SELECT ts, CAST(sum(x) OVER (ORDER BY ts) AS BIGINT) AS margin_balance FROM md)"""
JOINED_SQL = f"""WITH {BARS}, {FLOW_SQL}, {MARGIN_SQL}, f1 AS (SELECT symbol, ts + 1 AS at, foreign_net, trust_net, foreign_net + trust_net + dealer_net AS inst_total FROM flow),
 b1 AS (SELECT b.*, f1.foreign_net, f1.trust_net, f1.inst_total FROM bars b ASOF LEFT JOIN f1 ON b.symbol = f1.symbol AND b.ts >= f1.at),
 fut AS (SELECT CAST(DATE '1995-01-02' + CAST(80 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS DATE) + 1 AS at, CAST(sum(floor(value) - 50) FILTER (user_id % 3 = 0) AS BIGINT) AS oi FROM events WHERE event_type = 'purchase' GROUP BY 1),
 b2 AS (SELECT b1.*, m.margin_balance FROM b1 ASOF LEFT JOIN (SELECT ts + 1 AS at, margin_balance FROM margin) m ON b1.ts >= m.at),
 j AS (SELECT b2.*, fut.oi FROM b2 ASOF LEFT JOIN fut ON b2.ts >= fut.at)"""


@query("asof_flow", JOINED_SQL + " SELECT symbol, ts, foreign_net, trust_net, inst_total, margin_balance FROM j")
def asof_flow(spark: SparkSession, d: str) -> DataFrame:
    return with_all_flow(spark, d).select("symbol", "ts", *FLOW, "margin_balance")


_STREAK = lambda c, s, n=3: f"CASE WHEN count({c}) OVER {last(n)} = {n} THEN min(CASE WHEN {c} {s} 0 THEN 1 ELSE 0 END) OVER {last(n)} END"
FLOW_COLUMNS = {"fb": _STREAK("foreign_net", ">"), "fs": _STREAK("foreign_net", "<"), "tb": _STREAK("trust_net", ">"), "tsell": _STREAK("trust_net", "<"), "mf": _STREAK("dm", "<"), "mr": _STREAK("dm", ">"), "p_f": f"lag(foreign_net) OVER {W}", "p_o": f"lag(oi) OVER {W}"}
FLOW_TESTS = {
    "chip_foreign_buy_streak": "fb = 1", "chip_foreign_sell_streak": "fs = 1", "chip_trust_buy_streak": "tb = 1", "chip_trust_sell_streak": "tsell = 1", "chip_inst_buy_over": "inst_total >= 50", "chip_inst_sell_over": "inst_total <= -50",
    "chip_foreign_turn_buy": "p_f <= 0 AND foreign_net > 0", "chip_foreign_turn_sell": "p_f >= 0 AND foreign_net < 0", "chip_foreign_vol_ratio": "volume > 0 AND foreign_net / volume * 100 >= 10", "chip_margin_decrease_streak": "mf = 1", "chip_margin_increase_streak": "mr = 1",
    "chip_fut_foreign_oi_above": "oi >= 0", "chip_fut_foreign_oi_below": "oi <= 0", "chip_fut_foreign_turn_long": "p_o <= 0 AND oi > 0", "chip_fut_foreign_turn_short": "p_o >= 0 AND oi < 0",
}


@query("flow_range", f"""WITH {FLOW_SQL} SELECT symbol, ts, CASE WHEN month(ts) = 6 THEN foreign_net + 1 ELSE foreign_net END AS foreign_net, trust_net, dealer_net FROM flow WHERE ts BETWEEN DATE '1995-03-10' AND DATE '1996-02-20'""")
def flow_range(spark: SparkSession, d: str) -> DataFrame:
    """Flow of all shares saved by month, its Junes corrected in a second load, and a range of days read back."""
    flow = written(T.stock_flow(spark, d).select("symbol", "ts", "foreign_net", "trust_net", "dealer_net"), "flow")
    store = periodstore.PeriodStore(spark, folder(spark, "flow"), flow.schema, ["symbol"])
    store.save(flow)
    store.save(flow.where("month(ts) = 6").withColumn("foreign_net", F.col("foreign_net") + 1))
    return store.range("1995-03-10", "1996-02-20")


@query("futures_flow_range", """WITH f AS (SELECT CAST(DATE '1995-01-02' + CAST(80 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS DATE) AS ts, user_id % 3 AS who, CAST(floor(value) AS BIGINT) - 50 AS x FROM events WHERE event_type = 'purchase')
 SELECT ts, CAST(sum(x) FILTER (who = 0) AS BIGINT) AS fut_foreign_oi, CAST(sum(x) FILTER (who = 1) AS BIGINT) AS fut_trust_oi, CAST(sum(x) FILTER (who = 2) AS BIGINT) AS fut_dealer_oi FROM f WHERE ts BETWEEN DATE '1996-03-01' AND DATE '1999-06-30' GROUP BY ts""")  # fmt: skip
def futures_flow_range(spark: SparkSession, d: str) -> DataFrame:
    """Flow of all products saved by year, with a day every 80 days, and a range of one product read back and pivoted."""
    spread = F.date_add(F.lit("1995-01-02").cast("date"), (F.datediff("ts", F.lit("2024-01-01").cast("date")) * 80).cast("int"))
    flow = written(T.futures_flow(spark, d).withColumn("ts", spread), "futures-flow")
    store = periodstore.PeriodStore(spark, folder(spark, "futures-flow"), flow.schema, ["product", "investor"], by="year")
    store.save(flow)
    return T.futures_by_investor(store.range("1996-03-01", "1999-06-30"), "purchase")


@query("cond_flow", _tests_sql(FLOW_TESTS, JOINED_SQL + f", k AS (SELECT *, margin_balance - lag(margin_balance) OVER {W} AS dm FROM j), q AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in FLOW_COLUMNS.items())} FROM k)"))
def cond_flow(spark: SparkSession, d: str) -> DataFrame:
    params = {"chip_inst_buy_over": {"value": 0.05}, "chip_inst_sell_over": {"value": -0.05}}
    return _tested(with_all_flow(spark, d), list(FLOW_TESTS), params)


assert set(PRICE_SQL_TESTS) | set(KD_TESTS) | set(MACD_TESTS) | set(FLOW_TESTS) == set(CONDITIONS)


@query("asof_forward", f"""WITH {BARS}, w AS (SELECT * FROM bars WHERE symbol % 2 = 1), t AS (SELECT symbol - 1 AS symbol, ts, open, close FROM bars WHERE symbol % 2 = 0), l AS (SELECT symbol, arg_max(close, ts) AS z FROM t GROUP BY symbol)
 SELECT w.symbol, w.ts, coalesce(t.open, l.z) AS exec_open, coalesce(t.close, l.z) AS exec_close FROM w ASOF LEFT JOIN t ON w.symbol = t.symbol AND w.ts <= t.ts LEFT JOIN l ON l.symbol = w.symbol""")  # fmt: skip
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    bars = T.daily_bars(spark, d)
    traded = bars.where("symbol % 2 = 0").withColumn("symbol", F.col("symbol") - 1)
    out = asof.executed_elsewhere(bars.where("symbol % 2 = 1").select("symbol", "ts"), traded, ["symbol"])
    return out.select("symbol", "ts", "exec_open", "exec_close")


# ---------------------------------------------------------------- scalars


def _band_sql(bands, top) -> str:
    return "CASE " + " ".join(f"WHEN p < {limit} THEN {tick}" for limit, tick in bands) + f" ELSE {top} END"


@query("scalar_ticks", f"""WITH q AS (SELECT p_partkey, p_retailprice * (p_partkey % 13) / 10 AS p FROM part), t AS (SELECT *, {_band_sql(S.SHARE_TICKS, S.SHARE_TOP_TICK)} AS tick FROM q),
 u AS (SELECT p_partkey, p AS price, tick, round(round_even(p / tick, 0) * tick, 4) AS p FROM t), v AS (SELECT *, {_band_sql(S.SHARE_TICKS, S.SHARE_TOP_TICK)} AS tick2 FROM u)
 SELECT p_partkey, round(price, 4) AS price, CAST(tick AS DOUBLE) AS tick, CASE WHEN tick2 <> tick THEN round(round_even(p / tick2, 0) * tick2, 4) ELSE p END AS aligned FROM v""")  # fmt: skip
def scalar_ticks(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_retailprice") * (F.col("p_partkey") % 13) / 10
    return T.table(spark, d, "part").select("p_partkey", F.round(p, 4).alias("price"), S.tick_size(p).alias("tick"), S.round_to_tick(p).alias("aligned"))


ORDER_KEPT = ("o_orderkey", "symbol", "kind", "price_type", "quantity", "price", "limit_price", "tick", "lot", "label", "broker", "account", "text", "target")


@query("order_build", f"""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'TXFR1' WHEN 1 THEN '00' || (o_custkey % 900) ELSE CAST(1000 + o_custkey % 9000 AS VARCHAR) END AS symbol, o_orderstatus <> 'F' AS buys, 1 + o_orderkey % 7 AS quantity,
  CASE WHEN o_orderkey % 11 = 0 THEN o_totalprice / 700 ELSE o_totalprice / 900 END AS p, CASE WHEN o_orderkey % 4 = 3 THEN 'odd' WHEN o_orderkey % 4 = 0 THEN 'future' ELSE 'share' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'market' WHEN 1 THEN 'range' ELSE 'limit' END AS asked, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE o_orderkey % 6 END AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'B' || o_custkey % 3 ELSE 'default' END AS broker, CASE WHEN o_orderkey % 6 = 1 THEN 'A1' END AS account FROM orders),
 t AS (SELECT *, CAST(CASE WHEN kind = 'future' THEN 1 WHEN symbol LIKE '00%' THEN {_band_sql(S.FUND_TICKS, S.FUND_TOP_TICK)} ELSE {_band_sql(S.SHARE_TICKS, S.SHARE_TOP_TICK)} END AS DOUBLE) AS tick,
  CASE WHEN kind = 'odd' OR (asked = 'range' AND kind <> 'future') THEN 'limit' ELSE asked END AS price_type FROM s),
 u AS (SELECT *, round(round_even((p + CASE WHEN buys THEN n ELSE -n END * tick) / tick, 0) * tick, 4) + 0 AS limit_price FROM t),
 v AS (SELECT *, CASE WHEN price_type = 'limit' THEN 'limit ' || regexp_replace(printf('%.4f', limit_price), '\\.?0+$', '') ELSE price_type END AS label FROM u)
 SELECT o_orderkey, symbol, kind, price_type, quantity, CASE WHEN price_type = 'limit' THEN limit_price ELSE 0 END AS price, limit_price, tick, CASE WHEN kind = 'odd' THEN 'odd' ELSE 'common' END AS lot, label, broker, account,
  CASE WHEN buys THEN 'buy ' ELSE 'sell ' END || symbol || ' ' || quantity || ' (' || kind || ') ' || label AS text, broker || ' / ' || coalesce(account, 'default account') AS target FROM v""")  # fmt: skip
def order_build(spark: SparkSession, d: str) -> DataFrame:
    """Orders of all intents that the orders table gives: funds, shares, odd lots and futures, watched or traded prices, unknown settings."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = T.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 4 == 0, "txfr1 ").when(k % 4 == 1, F.concat(F.lit("00"), (c % 900).cast("string"))).otherwise((1000 + c % 9000).cast("string")).alias("symbol"),
        (F.col("o_orderstatus") != "F").alias("buys"),
        (1 + k % 7 + 0.5).alias("quantity"),
        (F.col("o_totalprice") / 900).alias("price"),
        F.when(k % 11 == 0, F.col("o_totalprice") / 700).alias("exec_price"),
        F.when(k % 4 == 3, "odd").when(k % 8 == 1, "none such").alias("kind"),
        F.when(k % 5 == 0, "market").when(k % 5 == 1, "range").when(k % 5 == 2, "other").alias("price_type"),
        F.when(k % 3 != 0, k % 6).cast("int").alias("ticks"),
        F.when(k % 2 == 0, F.concat(F.lit(" B"), (c % 3).cast("string"))).when(k % 5 == 0, "  ").alias("broker"),
        F.when(k % 6 == 1, "A1").when(k % 6 == 2, " ").alias("account"),
    )
    return orders.orders(rows).select(*ORDER_KEPT)


@query("scalar_costs", """WITH q AS (SELECT o_orderkey, o_totalprice / 1000 AS a, o_totalprice / 1000 * 1.05::DOUBLE AS b, 1 + o_orderkey % 5 AS n, o_custkey % 4 = 0 AS fund FROM orders)
 SELECT o_orderkey, greatest(a * n * 1000 * 0.001425::DOUBLE, 20) + greatest(b * n * 1000 * 0.001425::DOUBLE, 20) AS fee, b * n * 1000 * CASE WHEN fund THEN 0.001::DOUBLE ELSE 0.003::DOUBLE END AS tax,
  CAST(100 * n AS DOUBLE) AS lot_fee, a * n * 200 * 0.00002::DOUBLE + b * n * 200 * 0.00002::DOUBLE AS lot_tax FROM q""")  # fmt: skip
def scalar_costs(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("o_totalprice") / 1000
    rows = T.table(spark, d, "orders").select("o_orderkey", a.alias("a"), (a * 1.05).alias("b"), (1 + F.col("o_orderkey") % 5).alias("n"), F.when(F.col("o_custkey") % 4 == 0, "0050").otherwise("2330").alias("code"))
    share = S.round_trip_cost("share", F.col("code"), F.col("a"), F.col("b"), F.col("n"), 1000, F.lit(False))
    future = S.round_trip_cost("future", F.col("code"), F.col("a"), F.col("b"), F.col("n"), 200, F.lit(False))
    return rows.select("o_orderkey", share["fee"].alias("fee"), share["tax"].alias("tax"), future["fee"].alias("lot_fee"), future["tax"].alias("lot_tax"))


@query("scalar_sessions", f"""WITH q AS (SELECT event_id, {MINUTE} AS m, isodow(ts) AS w FROM events) SELECT event_id, CASE WHEN w < 6 AND m BETWEEN 540 AND 810 THEN 'regular' ELSE 'closed' END AS share,
 CASE WHEN w < 6 AND m BETWEEN 525 AND 825 THEN 'day' WHEN w < 6 AND m >= 900 THEN 'night' WHEN m < 300 AND w BETWEEN 2 AND 6 THEN 'night' ELSE 'closed' END AS future FROM q""")  # fmt: skip
def scalar_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", S.session("share", F.col("ts")).alias("share"), S.session("future", F.col("ts")).alias("future"))


@query("scalar_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS roc, CAST(floor(o_totalprice) AS BIGINT) AS whole, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS number,
 CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter FROM orders""")  # fmt: skip
def scalar_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    roc = F.concat((F.year(day) - 1911).cast("string"), F.lit("/"), F.date_format(day, "MM/dd"))
    number = F.when(F.col("o_orderkey") % 3 == 0, "--").otherwise(F.format_number("o_totalprice", 2))
    rows = T.table(spark, d, "orders").select("o_orderkey", "o_totalprice", day.alias("day"), F.date_format(day, "yyyyMMdd").alias("a"), roc.alias("b"), number.alias("c"), F.format_number(F.floor("o_totalprice"), 0).alias("w"))
    return rows.select("o_orderkey", S.iso_date(F.col("a")).alias("iso"), S.iso_date(F.col("b")).alias("roc"), S.whole_number(F.col("w")).alias("whole"), F.round(S.real_number(F.col("c")), 2).alias("number"), S.period_key(F.col("day"), "quarter").alias("quarter"))


# ---------------------------------------------------------------- screens

FUND_SQL = """fund AS (SELECT s_suppkey AS code, s_name AS name, n_name AS industry, CASE WHEN s_acctbal > 0 THEN s_acctbal / 400 END AS pe, abs(s_acctbal) / 2500 AS pb,
 CASE WHEN s_suppkey % 7 <> 0 THEN abs(s_acctbal) / 2000 END AS yield_pct, s_acctbal / 1000 AS eps FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query("fundamentals_merge", f"""WITH {BARS}, {FUND_SQL}, c AS (SELECT symbol AS code, arg_max(close, ts) AS close FROM bars GROUP BY symbol)
 SELECT coalesce(a.code, b.code) AS code, a.pe, b.eps, c.close FROM (SELECT code, pe FROM fund WHERE code % 5 <> 0) a FULL JOIN (SELECT code, eps FROM fund WHERE code % 3 <> 0) b ON a.code = b.code LEFT JOIN c ON c.code = coalesce(a.code, b.code)""")  # fmt: skip
def fundamentals_merge(spark: SparkSession, d: str) -> DataFrame:
    f = T.fundamentals(spark, d)
    closes = T.daily_bars(spark, d).groupBy(F.col("symbol").alias("code")).agg(F.max_by("close", "ts").alias("close"))
    return screener.merge_fundamentals([f.where("code % 5 <> 0").select("code", "pe"), f.where("code % 3 <> 0").select("code", "pe", "eps")], closes)


@query("screen_fundamental", f"WITH {FUND_SQL} SELECT code, industry, pe, yield_pct FROM fund WHERE pe <= 15 AND yield_pct >= 1 ORDER BY code LIMIT 200")
def screen_fundamental(spark: SparkSession, d: str) -> DataFrame:
    return screener.screen(T.fundamentals(spark, d), T.daily_bars(spark, d), fundamental=[("pe", "at_most", 15.0), ("yield_pct", "at_least", 1.0)]).select("code", "industry", "pe", "yield_pct")


@query("screen_technical", f"""WITH {BARS}, {FUND_SQL}, m AS (SELECT symbol, ts, close, {_A(20)} AS s20, {_A(60)} AS s60, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, count(*) OVER (PARTITION BY symbol) AS b FROM bars),
 t AS (SELECT * FROM m WHERE k = 1 AND b >= 30 AND (close > s20 OR close > s60))
 SELECT code, ts, close AS last_close, concat_ws(',', CASE WHEN close > s20 THEN 'price_above_ma n=20' END, CASE WHEN close > s60 THEN 'price_above_ma n=60' END) AS matched FROM fund JOIN t ON t.symbol = code WHERE pb <= 3 ORDER BY code LIMIT 200""")  # fmt: skip
def screen_technical(spark: SparkSession, d: str) -> DataFrame:
    out = screener.screen(T.fundamentals(spark, d), T.daily_bars(spark, d), [("price_above_ma", {"n": 20}), ("price_above_ma", {"n": 60})], [("pb", "at_most", 3.0)], logic="OR")
    return out.select("code", "ts", "last_close", F.array_join("matched", ",").alias("matched"))


def _portfolio(spark: SparkSession, d: str, bars: DataFrame | None = None) -> DataFrame:
    bars = written(T.daily_bars(spark, d), "bars") if bars is None else bars
    days = screener.rebalance_days(bars)
    return screener.portfolio(screener.picks(bars, [("price_above_ma", {"n": 20})], days), days)


DAYS_SQL = f"""{BARS}, a AS (SELECT DISTINCT ts FROM bars), b AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS n, lead(ts) OVER (ORDER BY ts) AS nx, max(ts) OVER () AS la FROM a),
 c AS (SELECT *, row_number() OVER (ORDER BY n) AS period, coalesce(lead(nx) OVER (ORDER BY n), la) AS ex FROM b WHERE n >= 60 AND (n - 60) % 20 = 0), days AS (SELECT CAST(period AS INTEGER) AS period, ts AS signal_day, nx AS entry_day, ex AS exit_day FROM c WHERE nx IS NOT NULL AND ex > nx)"""


@query("rebalance_days", f"WITH {DAYS_SQL} SELECT * FROM days")
def rebalance_days(spark: SparkSession, d: str) -> DataFrame:
    return screener.rebalance_days(T.daily_bars(spark, d))


_FEE = "CASE WHEN {0} * lots * 1000 > 0 THEN greatest({0} * lots * 1000 * 0.001425::DOUBLE, 20) ELSE 0 END"
PORTFOLIO_SQL = f"""WITH RECURSIVE {DAYS_SQL}, m AS (SELECT symbol, ts, close > {_A(20)} AS ok, row_number() OVER {W} AS nb, lead(ts) OVER {W} AS nxt FROM bars),
 hit AS (SELECT d.*, m.symbol, row_number() OVER (PARTITION BY d.period ORDER BY m.symbol) AS rank FROM days d JOIN m ON m.ts <= signal_day AND (nxt IS NULL OR nxt > signal_day) WHERE ok AND nb >= 60),
 pk AS (SELECT period, count(*) AS n, list({{'buy': x.open, 'sell': y.open}} ORDER BY rank) FILTER (x.open > 0 AND y.open IS NOT NULL) AS held FROM hit LEFT JOIN bars x ON x.symbol = hit.symbol AND x.ts = entry_day LEFT JOIN bars y ON y.symbol = hit.symbol AND y.ts = exit_day WHERE rank <= 10 GROUP BY period),
 s AS (SELECT days.*, coalesce(n, 0) AS n, coalesce(held, []) AS held, row_number() OVER (ORDER BY days.period) AS k FROM days LEFT JOIN pk USING (period)),
 r AS (SELECT 0::BIGINT AS k, 1000000::DOUBLE AS base, 1000000::DOUBLE AS money, [0::DOUBLE] AS pnl
  UNION ALL SELECT k, money, money + coalesce(list_sum(pnl), 0), pnl FROM (SELECT s.k, r.money, list_transform(list_filter(list_transform(s.held, lambda h: {{'h': h, 'q': floor(r.money / s.n / h.buy)}}), lambda z: z.q > 0),
   lambda z: (z.h.sell - z.h.buy) * z.q - ({_FEE.format('z.h.buy')} + {_FEE.format('z.h.sell')} + z.h.sell * lots * 1000 * 0.003::DOUBLE)) AS pnl FROM r JOIN s ON s.k = r.k + 1)),
 o AS (SELECT period, signal_day, entry_day, exit_day, n AS picks, len(r.pnl) AS trades, len(list_filter(r.pnl, lambda x: round(x, 2) > 0)) AS wins, round(coalesce(list_sum(r.pnl), 0), 2) AS pnl, round(coalesce(list_sum(r.pnl), 0) / base * 100, 2) AS return_pct, round(money, 2) AS equity FROM s JOIN r USING (k))""".replace("lots", "floor(z.q / 1000)")  # fmt: skip

query("portfolio_periods", PORTFOLIO_SQL + " SELECT * FROM o")(_portfolio)


@query("portfolio_metrics", PORTFOLIO_SQL + """, w AS (SELECT *, greatest(1000000, max(equity) OVER (ORDER BY period)) AS peak FROM o), g AS (SELECT min(ts) AS a, max(ts) AS b FROM bars),
 h AS (SELECT coalesce(round(avg((y.close / x.close - 1) * 100), 2), 0) AS hold FROM g JOIN bars x ON x.ts = g.a JOIN bars y ON y.ts = g.b AND y.symbol = x.symbol WHERE x.close > 0),
 f AS (SELECT count(*) AS periods, round(sum(pnl), 2) AS total_pnl, round(sum(pnl) / 1000000 * 100, 2) AS total_return_pct, coalesce(round(sum(wins) / sum(trades) * 100, 2), 0) AS win_rate, round(max((peak - equity) / peak * 100), 2) AS max_drawdown_pct, CAST(sum(trades) AS BIGINT) AS trades,
  round(avg(picks), 1) AS avg_picks, round(avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) * 100, 2) AS period_win_rate, max(return_pct) AS best_period_pct, min(return_pct) AS worst_period_pct FROM w)
 SELECT f.*, hold AS buy_hold_pct, round(total_return_pct - hold, 2) AS excess_pct FROM f, h""")
def portfolio_metrics(spark: SparkSession, d: str) -> DataFrame:
    bars = written(T.daily_bars(spark, d), "bars")
    return screener.portfolio_metrics(_portfolio(spark, d, bars), bars)


# ---------------------------------------------------------------- strategies

CROSSING = strategy.Strategy(entry=(("ma_cross_up", {"fast": 5, "slow": 20}),), exit=(("ma_cross_down", {"fast": 5, "slow": 20}),), stop_pct=8.0, take_pct=15.0)
RW = "(PARTITION BY run, symbol ORDER BY ts)"
SHARE_COSTS = "greatest(abs(entry_price) * quantity * 1000 * 0.001425::DOUBLE, 20) + greatest(abs(exit_price) * quantity * 1000 * 0.001425::DOUBLE, 20) AS fee, abs(exit_price) * quantity * 1000 * 0.003::DOUBLE AS tax"


def averages_sql(runs: list[tuple[int, int]], source: str = "bars") -> str:
    """m: bars of each run with its two averages."""
    parts = (f"SELECT {k} AS run, symbol, ts, open, close, {full('avg', 'close', a)} AS f, {full('avg', 'close', b)} AS s FROM {source.format(run=k)}" for k, (a, b) in enumerate(runs))
    return f"m AS ({' UNION ALL '.join(parts)})"


def crossing_sql(source: str, stop: float = 0, take: float = 0) -> str:
    """c: the trades of crossings in each run and symbol of m, and e: their equity. A position is (entry price, time, number)."""
    why = "".join(f" WHEN (q.dc - r.ep) / r.ep * 100 {op} {x} THEN '{name}'" for op, x, name in (("<=", -stop, "stop_pct"), (">=", take, "take_pct")) if x)
    return f"""WITH RECURSIVE {source}, m1 AS (SELECT *, row_number() OVER {RW} - 1 AS i, count(*) OVER (PARTITION BY run, symbol) AS n FROM m),
 p AS (SELECT *, coalesce(lag(f) OVER {RW} <= lag(s) OVER {RW} AND f > s, false) AS en, coalesce(lag(f) OVER {RW} >= lag(s) OVER {RW} AND f < s, false) AS ex FROM m1),
 q AS (SELECT *, lag(en) OVER {RW} AS den, lag(ex) OVER {RW} AS dex, lag(close) OVER {RW} AS dc FROM p),
 r AS (SELECT run, symbol, i, CAST(NULL AS DOUBLE) AS ep, CAST(NULL AS DATE) AS et, CAST(NULL AS BIGINT) AS ei, CAST(NULL AS DOUBLE) AS xe, CAST(NULL AS DATE) AS xet, CAST(NULL AS BIGINT) AS xi, CAST(NULL AS DOUBLE) AS xp, CAST(NULL AS VARCHAR) AS why FROM q WHERE i = 2 AND n > 2
  UNION ALL SELECT run, symbol, i, CASE WHEN ep IS NULL AND den THEN open WHEN why IS NOT NULL THEN NULL ELSE ep END, CASE WHEN ep IS NULL AND den THEN ts WHEN why IS NOT NULL THEN NULL ELSE et END,
   CASE WHEN ep IS NULL AND den THEN i WHEN why IS NOT NULL THEN NULL ELSE ei END, CASE WHEN why IS NOT NULL THEN ep END, CASE WHEN why IS NOT NULL THEN et END, CASE WHEN why IS NOT NULL THEN ei END, CASE WHEN why IS NOT NULL THEN open END, why FROM (
   SELECT q.*, r.ep, r.et, r.ei, CASE WHEN r.ep IS NULL THEN NULL{why} WHEN q.dex THEN 'signal' END AS why
   FROM r JOIN q ON q.run = r.run AND q.symbol = r.symbol AND q.i = r.i + 1)),
 t AS (SELECT run, symbol, xet AS entry_ts, xe AS entry_price, i AS j, xp AS exit_price, i - xi AS bars_held, why FROM r WHERE why IS NOT NULL
  UNION ALL SELECT r.run, r.symbol, r.et, r.ep, r.i, q.close, r.i - r.ei, 'settled' FROM r JOIN q ON q.run = r.run AND q.symbol = r.symbol AND q.i = r.i WHERE r.i = q.n - 1 AND r.ep IS NOT NULL),
 c0 AS (SELECT t.*, q.ts AS exit_ts, 1 AS quantity, (exit_price - entry_price) * 1 * 1000 AS gross FROM t JOIN q ON q.run = t.run AND q.symbol = t.symbol AND q.i = t.j), c1 AS (SELECT *, {SHARE_COSTS} FROM c0), c AS (SELECT *, gross - fee - tax AS pnl FROM c1),
 e AS (SELECT r.run, r.symbol, r.i, q.ts, q.n, coalesce(sum(g.pnl) OVER (PARTITION BY r.run, r.symbol ORDER BY r.i), 0) + CASE WHEN r.ep IS NOT NULL AND r.i < q.n - 1 THEN (q.close - r.ep) * 1000 ELSE 0 END AS equity
  FROM r JOIN q ON q.run = r.run AND q.symbol = r.symbol AND q.i = r.i LEFT JOIN (SELECT run, symbol, j, sum(pnl) AS pnl FROM c GROUP BY ALL) g ON g.run = r.run AND g.symbol = r.symbol AND g.j = r.i),
 e1 AS (SELECT *, max(equity) OVER (PARTITION BY run, symbol ORDER BY i) - equity AS fall, equity - lag(equity) OVER (PARTITION BY run, symbol ORDER BY i) AS d FROM e),
 years AS (SELECT run, symbol, greatest(date_diff('day', min(ts), max(ts)), 1) / 365.0::DOUBLE AS years FROM m GROUP BY ALL),
 curve AS (SELECT e1.run, e1.symbol, any_value(years) AS years, max(fall) AS max_drawdown, CASE WHEN count(d) > 2 AND stddev_pop(d) > 1e-12 THEN avg(d) / stddev_pop(d) * sqrt(count(*) / any_value(years)) ELSE 0 END AS sharpe FROM e1 JOIN years USING (run, symbol) GROUP BY e1.run, e1.symbol)"""


CROSSING_SQL = crossing_sql(f"{BARS}, {averages_sql([(5, 20)])}", 8, 15)


@query("backtest_trades", CROSSING_SQL + " SELECT symbol, entry_ts, entry_price, exit_ts, exit_price, CAST(bars_held AS BIGINT) AS bars_held, why AS exit_reason, pnl FROM c")
def backtest_trades(spark: SparkSession, d: str) -> DataFrame:
    rows = strategy.trades(strategy.backtest(T.daily_bars(spark, d), CROSSING))
    return rows.select("symbol", "entry_ts", "entry_price", "exit_ts", "exit_price", "bars_held", "exit_reason", "pnl")


def _figures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bars = T.daily_bars(spark, d)
    events = written(strategy.backtest(bars, CROSSING), "events")
    trades = strategy.trades(events)
    return trades, metrics.metrics(trades, strategy.equity(events), bars, CROSSING.unit)


METRICS_SQL = CROSSING_SQL + """, w AS (SELECT *, sign(pnl) AS sg FROM c), w1 AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER (PARTITION BY symbol ORDER BY exit_ts, entry_ts) THEN 1 ELSE 0 END AS fresh FROM w),
 w2 AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY exit_ts, entry_ts) AS streak FROM w1), w3 AS (SELECT symbol, streak, any_value(sg) AS sg, count(*) AS k, sum(pnl) AS x FROM w2 GROUP BY 1, 2),
 st AS (SELECT symbol, coalesce(max(k) FILTER (sg > 0), 0) AS max_consec_wins, coalesce(max(k) FILTER (sg < 0), 0) AS max_consec_losses, coalesce(max(x) FILTER (sg > 0), 0) AS max_consec_win_amount, coalesce(min(x) FILTER (sg < 0), 0) AS max_consec_loss_amount FROM w3 GROUP BY symbol),
 b AS (SELECT symbol, count(*) AS nb, arg_max(close, ts) AS z, max(close) FILTER (i = 2) AS a FROM m1 GROUP BY symbol),
 f AS (SELECT symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, sum(pnl) AS total_pnl, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gross_profit, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS gross_loss, sum(gross) AS gross_pnl,
  sum(fee) AS total_fee, sum(tax) AS total_tax, max(pnl) AS best_trade, min(pnl) AS worst_trade, CAST(max(bars_held) AS BIGINT) AS max_bars_held, sum(bars_held) AS held, max(abs(entry_price) * 1 * 1000) AS cost_basis_max, avg(abs(entry_price) * 1 * 1000) AS base FROM c GROUP BY symbol)"""
WHOLE_METRICS = ("trades", "wins", "losses", "max_consec_wins", "max_consec_losses", "max_bars_held")
MONEY_METRICS = ("total_pnl", "gross_profit", "gross_loss", "gross_pnl", "total_fee", "total_tax", "best_trade", "worst_trade", "max_consec_win_amount", "max_consec_loss_amount", "max_drawdown", "cost_basis_max", "buy_hold_pnl", "expectancy", "avg_win", "avg_loss")
RATIO_METRICS = ("profit_factor", "sharpe", "total_return_pct", "ann_return_pct", "exposure_pct", "buy_hold_pct", "win_loss_ratio", "years", "win_rate", "avg_bars_held")
DERIVED_SQL = {
    "buy_hold_pnl": "(z - a) * 1 * 1000", "expectancy": "total_pnl / trades", "avg_win": "CASE WHEN wins > 0 THEN gross_profit / wins ELSE 0 END", "avg_loss": "CASE WHEN losses > 0 THEN -gross_loss / losses ELSE 0 END",
    "profit_factor": "CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss WHEN gross_profit > 0 THEN 'inf'::DOUBLE ELSE 0 END", "total_return_pct": "total_pnl / base * 100", "ann_return_pct": "total_pnl / base * 100 / years",
    "exposure_pct": "held / nb * 100", "buy_hold_pct": "(z - a) / a * 100", "win_loss_ratio": "CASE WHEN losses > 0 AND gross_loss > 0 THEN CASE WHEN wins > 0 THEN gross_profit / wins ELSE 0 END / (gross_loss / losses) WHEN wins > 0 THEN 'inf'::DOUBLE ELSE 0 END",
    "win_rate": "wins / trades * 100", "avg_bars_held": "held / trades",
}


@query("backtest_metrics", METRICS_SQL + " SELECT symbol, " + ", ".join([f"{c}" for c in WHOLE_METRICS] + [f"round({DERIVED_SQL.get(c, c)}, 2) AS {c}" for c in MONEY_METRICS] + [f"round({DERIVED_SQL.get(c, c)}, 5) AS {c}" for c in RATIO_METRICS]) + " FROM f JOIN st USING (symbol) JOIN b USING (symbol) JOIN curve USING (symbol)")
def backtest_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = _figures(spark, d)[1]
    return f.select("symbol", *WHOLE_METRICS, *(F.round(c, 2).alias(c) for c in MONEY_METRICS), *(F.round(c, 5).alias(c) for c in RATIO_METRICS))


#: Further figures: name, SQL over trades (c), and places; then those over the columns of f, g, curve and the equity.
TRADE_FIGURES = {
    "max_single_loss": ("coalesce(min(pnl) FILTER (pnl < 0), 0)", 2), "max_single_win": ("coalesce(max(pnl) FILTER (pnl > 0), 0)", 2), "long_trades": ("count(*)", None), "short_trades": ("CAST(0 AS BIGINT)", None), "long_pnl": ("sum(pnl)", 2),
    "short_pnl": ("0.0::DOUBLE", 2), "long_win_rate": ("count(*) FILTER (pnl > 0) / count(*) * 100", 5), "short_win_rate": ("0.0::DOUBLE", 5), "cost_basis_first": ("arg_min(abs(entry_price) * 1000, row(entry_ts, exit_ts))", 2), "cost_basis_total": ("sum(abs(entry_price) * 1000)", 2),
}
ROW_FIGURES = {
    "base": ("base", 2), "total_cost": ("total_fee + total_tax", 2), "max_drawdown_pct": ("fall_pct", 5), "trades_per_year": ("trades / years", 5), "cost_per_year": ("(total_fee + total_tax) / years", 2),
    "cost_ratio_pct": ("CASE WHEN abs(gross_pnl) > 1e-9 THEN (total_fee + total_tax) / abs(gross_pnl) * 100 ELSE 0 END", 5), "avg_cost_per_trade": ("(total_fee + total_tax) / trades", 2),
}
_PLACES = {c: 2 for c in MONEY_METRICS} | {c: 5 for c in RATIO_METRICS} | {c: n for c, (_, n) in (TRADE_FIGURES | ROW_FIGURES).items()} | dict.fromkeys(WHOLE_METRICS)


def _placed_sql(c: str, x: str) -> str:
    return f"{x} AS {c}" if _PLACES[c] is None else f"round({x}, {_PLACES[c]}) AS {c}"


@query("backtest_all_metrics", METRICS_SQL + f""", g AS (SELECT symbol, {", ".join(f"{x} AS {c}" for c, (x, _) in TRADE_FIGURES.items())} FROM c GROUP BY symbol),
 e2 AS (SELECT e.symbol, base + equity AS worth, max(base + equity) OVER (PARTITION BY e.symbol ORDER BY i) AS top FROM e JOIN f ON f.symbol = e.symbol), e3 AS (SELECT symbol, coalesce(max(CASE WHEN top > 0 THEN (top - worth) / top * 100 END), 0) AS fall_pct FROM e2 GROUP BY symbol)
 SELECT symbol, """ + ", ".join(_placed_sql(c, x) for c, x in {**{c: DERIVED_SQL.get(c, c) for c in (*WHOLE_METRICS, *MONEY_METRICS, *RATIO_METRICS)}, **{c: f"g.{c}" for c in TRADE_FIGURES}, **{c: x for c, (x, _) in ROW_FIGURES.items()}}.items()) + """
 FROM f JOIN g USING (symbol) JOIN e3 USING (symbol) JOIN st USING (symbol) JOIN b USING (symbol) JOIN curve USING (symbol)""")  # fmt: skip
def backtest_all_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = _figures(spark, d)[1]
    return f.select("symbol", *(F.round(c, n).alias(c) if (n := _PLACES[c]) is not None else F.col(c) for c in f.columns if c != "symbol"))


#: Faults that the audit must find: what is changed in the figures of which symbols, and the check that fails there.
TAMPERED = {
    "sum_of_trades": ("total_pnl", "total_pnl + 1", "symbol % 2 = 0"), "number_of_trades": ("trades", "trades + 1", "symbol % 3 = 0"), "wins_and_losses": ("wins", "wins - 1", "symbol % 4 = 1"), "rate_of_wins": ("win_rate", "win_rate + 0.2", "symbol % 5 = 0"),
    "losing_streak": ("max_consec_loss_amount", "max_consec_loss_amount - 0.5", "symbol % 6 = 1"), "drawdown_over_worst": ("max_drawdown", "-1D", "symbol % 7 = 0"),
}
AUDIT_SQL = METRICS_SQL + """, l AS (SELECT symbol, coalesce(-min(pnl) FILTER (pnl < 0), 0) AS worst, count(*) FILTER (exit_price < entry_price AND pnl > 0) AS odd, count(*) FILTER (exit_ts < entry_ts) AS late, count(*) FILTER (bars_held < 0) AS held_wrong FROM c GROUP BY symbol)
 SELECT f.symbol, """ + ", ".join(f"NOT ({where.replace('symbol', 'f.symbol')}) AS {c}" for c, (_, _, where) in TAMPERED.items() if c != "drawdown_over_worst") + """, CASE WHEN f.symbol % 7 = 0 THEN -1 ELSE max_drawdown END + 0.01 >= worst AS drawdown_over_worst,
  NOT (gross_loss > 0 AND f.symbol % 8 = 3) AS gain_over_loss, odd = 0 AS direction_of_gains, late = 0 AS exit_after_entry, held_wrong = 0 AS bars_not_negative FROM f JOIN l ON l.symbol = f.symbol JOIN curve ON curve.symbol = f.symbol"""


@query("backtest_audit", AUDIT_SQL)
def backtest_audit(spark: SparkSession, d: str) -> DataFrame:
    trades, figures = _figures(spark, d)
    for column, value, where in (*TAMPERED.values(), ("profit_factor", "profit_factor + 0.5", "symbol % 8 = 3")):
        figures = figures.withColumn(column, F.when(F.expr(where), F.expr(value)).otherwise(F.col(column)))
    return metrics.audit(trades, figures)


HOLD_SQL = f"""WITH RECURSIVE {BARS}, m AS (SELECT *, close > {_A(20)} AS ok, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, arg_max(close, ts) OVER (PARTITION BY symbol) AS z FROM bars),
 q AS (SELECT symbol, ts, open, i, z, lag(close) OVER {W} AS dc, date_trunc('month', lag(ts) OVER {W}) AS mo, coalesce(lag(ok) OVER {W}, false) AS due FROM m), d AS (SELECT *, row_number() OVER {W} AS k FROM q WHERE i >= 3 AND due)"""
HOLD_LOTS = {
    "single": ", lots AS (SELECT symbol, ts, open, z, 1 AS quantity FROM d WHERE k = 1)",
    "accumulate": ", lots AS (SELECT symbol, ts, open, z, 1 AS quantity FROM d)",
    "dca": """, f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS j FROM (SELECT *, row_number() OVER (PARTITION BY symbol, mo ORDER BY ts) AS first FROM d) WHERE first = 1),
 a AS (SELECT symbol, j, ts, open, z, floor(3000000 / (dc * 1000)) AS quantity, 3000000 - floor(3000000 / (dc * 1000)) * (dc * 1000) AS carry FROM f WHERE j = 1
  UNION ALL SELECT f.symbol, f.j, f.ts, f.open, f.z, floor((a.carry + 3000000) / (f.dc * 1000)), (a.carry + 3000000) - floor((a.carry + 3000000) / (f.dc * 1000)) * (f.dc * 1000) FROM a JOIN f ON f.symbol = a.symbol AND f.j = a.j + 1),
 lots AS (SELECT symbol, ts, open, z, quantity FROM a WHERE quantity > 0)""",
}
HOLD_END = f""", c0 AS (SELECT symbol, ts AS entry_ts, open AS entry_price, z AS exit_price, quantity, (z - open) * quantity * 1000 AS gross FROM lots), c AS (SELECT *, {SHARE_COSTS} FROM c0)
 SELECT symbol, entry_ts, entry_price, CAST(quantity AS BIGINT) AS quantity, gross - fee - tax AS pnl FROM c"""


def _hold(mode: str) -> Query:
    s = strategy.Strategy(entry=(("price_above_ma", {"n": 20}),), hold=mode, dca_amount=3_000_000.0)
    return lambda spark, d: strategy.trades(strategy.backtest(T.daily_bars(spark, d), s)).select("symbol", "entry_ts", "entry_price", "quantity", "pnl")


for _mode in ("single", "accumulate", "dca"):
    query(f"backtest_hold_{_mode}", HOLD_SQL + HOLD_LOTS[_mode] + HOLD_END)(_hold(_mode))


TOUCH_SQL = f"""WITH RECURSIVE {BARS}, m AS (SELECT *, coalesce(close > {full('max', 'high', 10, 1)}, false) AS en, coalesce(CASE WHEN count(*) OVER {last(3)} = 3 THEN max(CASE WHEN close < open THEN 0 ELSE 1 END) OVER {last(3)} = 0 END, false) AS ex, row_number() OVER {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 q AS (SELECT *, lag(en) OVER {W} AS den, lag(ex) OVER {W} AS dex, lag(close) OVER {W} AS dc FROM m),
 r AS (SELECT symbol, i, CAST(NULL AS DOUBLE) AS sp, CAST(NULL AS DATE) AS et, CAST(NULL AS BIGINT) AS ei, CAST(NULL AS DOUBLE) AS xe, CAST(NULL AS DATE) AS xet, CAST(NULL AS BIGINT) AS xi, CAST(NULL AS DOUBLE) AS xp, CAST(NULL AS VARCHAR) AS why FROM q WHERE i = 2
  UNION ALL SELECT symbol, i, CASE WHEN sp IS NULL AND den THEN open WHEN why IS NULL THEN sp END, CASE WHEN sp IS NULL AND den THEN ts WHEN why IS NULL THEN et END, CASE WHEN sp IS NULL AND den THEN i WHEN why IS NULL THEN ei END,
   CASE WHEN why IS NOT NULL THEN sp END, CASE WHEN why IS NOT NULL THEN et END, CASE WHEN why IS NOT NULL THEN ei END, CASE why WHEN 'touch_stop' THEN least(open, sp - 60) WHEN 'touch_take' THEN greatest(open, sp + sp * 6 / 100) ELSE CASE WHEN why IS NOT NULL THEN open END END, why FROM (
   SELECT q.*, r.sp, r.et, r.ei, CASE WHEN r.sp IS NULL THEN NULL WHEN q.dc - r.sp <= -60 THEN 'stop_abs' WHEN (q.dc - r.sp) / r.sp * 100 >= 6 THEN 'take_pct' WHEN q.dex THEN 'signal' WHEN q.low <= r.sp - 60 THEN 'touch_stop' WHEN q.high >= r.sp + r.sp * 6 / 100 THEN 'touch_take' END AS why
   FROM r JOIN q ON q.symbol = r.symbol AND q.i = r.i + 1)),
 t AS (SELECT symbol, xet AS entry_ts, xe + 1 AS entry_price, i AS j, xp - 1 AS exit_price, i - xi AS bars_held, why FROM r WHERE why IS NOT NULL UNION ALL SELECT r.symbol, r.et, r.sp + 1, r.i, q.close, r.i - r.ei, 'settled' FROM r JOIN q ON q.symbol = r.symbol AND q.i = r.i WHERE r.i = q.n - 1 AND r.sp IS NOT NULL),
 c AS (SELECT t.*, q.ts AS exit_ts, (exit_price - entry_price) * 1 * 10 AS gross, 100.0::DOUBLE AS fee, abs(entry_price) * 1 * 10 * 0.00002::DOUBLE + abs(exit_price) * 1 * 10 * 0.00002::DOUBLE AS tax FROM t JOIN q ON q.symbol = t.symbol AND q.i = t.j)
 SELECT symbol, entry_ts, entry_price, exit_ts, exit_price, 'long' AS direction, CAST(1 AS BIGINT) AS quantity, gross, fee, tax, gross - fee - tax AS pnl, (gross - fee - tax) / (abs(entry_price) * 1 * 10) * 100 AS pnl_pct, CAST(bars_held AS BIGINT) AS bars_held, why AS exit_reason FROM c"""


@query("backtest_touch", TOUCH_SQL)
def backtest_touch(spark: SparkSession, d: str) -> DataFrame:
    s = strategy.Strategy(entry=(("price_break_high", {"n": 10}),), exit=(("consecutive_down", {"n": 3}),), kind="future", product="TMF", stop_abs=60.0, take_pct=6.0, slippage_ticks=1.0)
    return strategy.trades(strategy.backtest(T.daily_bars(spark, d), s))


def _make(p: dict) -> strategy.Strategy:
    spec = {"fast": int(p["fast"]), "slow": int(p["slow"])}
    return strategy.Strategy(entry=(("ma_cross_up", spec),), exit=(("ma_cross_down", spec),))


GRID = "fast=3:9:3; slow=15,25"
TRIALS = sweep.sampled({"fast": (3, 8, True), "slow": (15, 30, True)}, 4, seed=7)
_RUNS = lambda runs: [(int(p["fast"]), int(p["slow"])) for p in runs]
TOTALS = """f AS (SELECT run, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, sum(pnl) AS total, coalesce(sum(pnl) FILTER (pnl > 0), 0) AS gain, coalesce(-sum(pnl) FILTER (pnl < 0), 0) AS loss FROM c GROUP BY run),
 g AS (SELECT run, max(max_drawdown) AS deep, avg(sharpe) AS ratio FROM curve GROUP BY run),
 y AS (SELECT CAST(run AS INTEGER) AS run, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, round(coalesce(total, 0), 2) AS total_pnl, round(CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN 'inf'::DOUBLE ELSE 0 END, 4) AS profit_factor, round(coalesce(total / trades, 0), 2) AS expectancy,
  coalesce(wins * 100 / trades, 0) AS win_rate, round(deep, 2) AS max_drawdown, round(ratio, 6) AS sharpe, CAST(NULL AS VARCHAR) AS fault FROM g LEFT JOIN f USING (run))"""


def _totalled(df: DataFrame) -> DataFrame:
    return rounded(rounded(rounded(df, "total_pnl", "expectancy", "max_drawdown", places=2), "profit_factor"), "sharpe", places=6)


@query("sweep_grid", crossing_sql(f"{BARS}, {averages_sql(_RUNS(sweep.combinations(sweep.parse_grid(GRID))))}") + f", {TOTALS} SELECT *, trades >= 1 AS eligible, sharpe AS score FROM y")
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    runs = list(sweep.combinations(sweep.parse_grid(GRID)))
    return sweep.ranked(_totalled(sweep.totals(sweep.run_all(T.daily_bars(spark, d), _make, runs), _make, runs)), "sharpe")


@query("sweep_parts", ORACLE_SQL["sweep_grid"])
def sweep_parts(spark: SparkSession, d: str) -> DataFrame:
    """The same sweep as a job that tells its progress and could be cancelled, here run to its end."""
    runs = list(sweep.combinations(sweep.parse_grid(GRID)))
    job = progress.SweepJob(T.daily_bars(spark, d), _make, runs, per_job=8).start()
    job.wait()
    return sweep.ranked(_totalled(sweep.totals(job.results(), _make, runs)), "sharpe")


@query("sweep_random", crossing_sql(f"{BARS}, {averages_sql(_RUNS(TRIALS))}") + f", {TOTALS} SELECT *, trades >= 1 AS eligible, -max_drawdown AS score FROM y")
def sweep_random(spark: SparkSession, d: str) -> DataFrame:
    return sweep.ranked(_totalled(sweep.totals(sweep.run_all(T.daily_bars(spark, d), _make, TRIALS), _make, TRIALS)), "max_drawdown")


SPLIT = f"""w AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER {W} AS k FROM bars), w0 AS (SELECT * FROM w WHERE n >= 20 AND floor(n * 0.7::DOUBLE) >= 10 AND n - floor(n * 0.7::DOUBLE) >= 10 AND k <= floor(n * 0.7::DOUBLE)),
 w1 AS (SELECT * FROM w WHERE n >= 20 AND floor(n * 0.7::DOUBLE) >= 10 AND n - floor(n * 0.7::DOUBLE) >= 10 AND k > floor(n * 0.7::DOUBLE))"""


@query("walk_forward", crossing_sql(f"{BARS}, {SPLIT}, {averages_sql([(5, 20), (5, 20)], 'w{run}')}") + f", {TOTALS} SELECT CASE run WHEN 0 THEN 'in' ELSE 'out' END AS part, trades, wins, total_pnl, profit_factor, expectancy, win_rate FROM y")
def walk_forward(spark: SparkSession, d: str) -> DataFrame:
    out = sweep.walk_forward(T.daily_bars(spark, d), _make, {"fast": 5, "slow": 20})
    return rounded(rounded(out, "total_pnl", "expectancy", places=2), "profit_factor")


ON_BAR = """
def on_bar(ctx):
    fast, slow = ctx.ema(ctx.param('fast', 7)), ctx.sma(ctx.param('slow', 25))
    if ctx.cross_up(fast, slow):
        return ctx.buy()
    if ctx.cross_down(fast, slow):
        return ctx.sell()
    return ctx.hold()
"""


ON_BAR_SQL = f"""WITH RECURSIVE {NUMBERED}, r AS (SELECT symbol, i, ts, close AS f FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.ts, 0.75 * r.f + 0.25 * n.close FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1),
 x AS (SELECT n.symbol, n.ts, n.i - 1 AS i, n.open, n.close, r.f, {{slow}} AS s, count(*) OVER (PARTITION BY n.symbol) AS n FROM n JOIN r ON r.symbol = n.symbol AND r.i = n.i),
 g AS (SELECT *, CASE WHEN lag(f) OVER {W} <= lag(s) OVER {W} AND f > s THEN 1 WHEN lag(f) OVER {W} >= lag(s) OVER {W} AND f < s THEN -1 END AS side FROM x),
 h AS (SELECT *, lag(side) OVER {W} AS before FROM g WHERE side IS NOT NULL AND i >= 2{{end}}), ch AS (SELECT * FROM h WHERE before IS NULL OR before <> side)"""
_SLOW = lambda n: full("avg", "n.close", n).replace("PARTITION BY symbol ORDER BY ts", "PARTITION BY n.symbol ORDER BY n.ts")
BOTH_WAYS = strategy.Strategy(entry=(("always_true", {}),), exit=(("always_true", {}),), kind="future")


@query("custom_strategy", ON_BAR_SQL.format(slow=_SLOW(20), end="") + " SELECT symbol, ts, CASE side WHEN 1 THEN 'BUY' ELSE 'SELL' END AS decision, CASE WHEN before IS NULL THEN '' WHEN side = 1 THEN 'CLOSE buy,' ELSE 'CLOSE sell,' END || CASE side WHEN 1 THEN 'OPEN buy' ELSE 'OPEN sell' END AS actions, close AS price FROM ch")
def custom_strategy(spark: SparkSession, d: str) -> DataFrame:
    return strategy.run_custom(T.daily_bars(spark, d), ON_BAR, {"slow": 20}, BOTH_WAYS)


@query("custom_isolated", ORACLE_SQL["custom_strategy"].replace("close AS price FROM ch", "close AS price, NULL AS fault FROM ch"))
def custom_isolated(spark: SparkSession, d: str) -> DataFrame:
    return isolated.run_isolated(T.daily_bars(spark, d), ON_BAR, {"slow": 20}, BOTH_WAYS)


@query("backtest_custom", ON_BAR_SQL.format(slow=_SLOW(25), end=" AND i + 1 < n") + """, tr AS (SELECT symbol, side, i + 1 AS since, lead(i + 1) OVER (PARTITION BY symbol ORDER BY i) AS until, n FROM ch),
 t AS (SELECT tr.symbol, side, a.ts AS entry_ts, a.open AS entry_price, z.ts AS exit_ts, CASE WHEN until IS NULL THEN z.close ELSE z.open END AS exit_price, z.i - a.i AS bars_held, CASE WHEN until IS NULL THEN 'settled' ELSE 'signal' END AS exit_reason
  FROM tr JOIN x a ON a.symbol = tr.symbol AND a.i = since JOIN x z ON z.symbol = tr.symbol AND z.i = coalesce(until, tr.n - 1))
 SELECT symbol, entry_ts, entry_price, exit_ts, exit_price, CASE side WHEN 1 THEN 'long' ELSE 'short' END AS direction, CAST(bars_held AS BIGINT) AS bars_held, exit_reason,
  (exit_price - entry_price) * side * 1 * 1 - 100 - (abs(entry_price) * 1 * 1 * 0.00002::DOUBLE + abs(exit_price) * 1 * 1 * 0.00002::DOUBLE) AS pnl FROM t""")  # fmt: skip
def backtest_custom(spark: SparkSession, d: str) -> DataFrame:
    events = strategy.backtest_custom(T.daily_bars(spark, d), ON_BAR, {}, BOTH_WAYS)
    return strategy.trades(events).select("symbol", "entry_ts", "entry_price", "exit_ts", "exit_price", "direction", "bars_held", "exit_reason", "pnl")


# ---------------------------------------------------------------- accounts and the band strategy


def _fills(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return T.table(spark, d, "orders").select(
        F.col("o_custkey").alias("account"), F.concat(F.lit("S"), (F.col("o_custkey") % 7).cast("string")).alias("symbol"), F.col("o_orderdate").alias("ts"), key.alias("seq"), F.lit("share").alias("market"),
        F.lit("odd").alias("kind"), (key % 3 != 0).alias("opens"), (key % 3 != 0).alias("buys"), (1 + key % 4).alias("quantity"), (F.col("o_totalprice") / 1000).alias("price"),
    )


ACCOUNT_SQL = """WITH RECURSIVE o AS (SELECT o_custkey AS account, 'S' || (o_custkey % 7) AS symbol, o_orderdate AS ts, o_orderkey AS seq, 'share' AS market, 'odd' AS kind, o_orderkey % 3 <> 0 AS opens, o_orderkey % 3 <> 0 AS buys, 1 + o_orderkey % 4 AS quantity, o_totalprice / 1000 AS price,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
 r AS (SELECT account, i, CASE WHEN opens THEN quantity ELSE 0 END AS held, CASE WHEN opens THEN price ELSE 0 END AS average, 0::BIGINT AS closed, 0.0::DOUBLE AS basis FROM o WHERE i = 1
  UNION ALL SELECT o.account, o.i, CASE WHEN o.opens THEN r.held + o.quantity ELSE r.held - least(r.held, o.quantity) END, CASE WHEN o.opens THEN (CASE WHEN r.held > 0 THEN r.average * r.held + o.price * o.quantity ELSE o.price * o.quantity END) / (r.held + o.quantity) ELSE r.average END,
   CASE WHEN o.opens THEN 0 ELSE least(r.held, o.quantity) END, r.average FROM r JOIN o ON o.account = r.account AND o.i = r.i + 1),
 a AS (SELECT o.*, r.held, r.average, r.closed, r.basis, price * quantity AS gross, CASE WHEN buys THEN price * quantity * 0.001425::DOUBLE ELSE price * quantity * 0.004425::DOUBLE END AS f FROM o JOIN r ON r.account = o.account AND r.i = o.i),
 h AS (SELECT *, round(f, 2) AS fee, CASE WHEN closed > 0 THEN round((price - basis) * closed - f, 2) ELSE 0 END AS pnl, CASE WHEN buys THEN -gross ELSE gross END - f AS cash_flow FROM a)"""


@query("account_history", ACCOUNT_SQL + " SELECT account, symbol, ts, seq, market, kind, opens, buys, quantity, price, fee, pnl, cash_flow, held, CASE WHEN held > 0 THEN true END AS held_long, CASE WHEN held > 0 THEN average END AS average FROM h")
def account_history(spark: SparkSession, d: str) -> DataFrame:
    return account.history(_fills(spark, d))


@query("account_equity", ACCOUNT_SQL + """, p AS (SELECT account, symbol, arg_max(held, i) AS held, arg_max(average, i) AS average FROM h GROUP BY 1, 2), k AS (SELECT symbol, avg(price) AS mark FROM h GROUP BY 1), c AS (SELECT account, 1000000 + sum(cash_flow) AS cash, sum(pnl) AS realized FROM h GROUP BY 1)
 SELECT account, round(cash, 2) AS cash, round(realized, 2) AS realized, round(CASE WHEN held > 0 THEN (mark - average) * held ELSE 0 END, 2) AS unrealized, round(cash + CASE WHEN held > 0 THEN mark * held ELSE 0 END, 2) AS equity FROM c JOIN p USING (account) JOIN k USING (symbol)""")
def account_equity(spark: SparkSession, d: str) -> DataFrame:
    marks = _fills(spark, d).groupBy("symbol").agg(F.avg("price").alias("mark"))
    return rounded(account.equity(account.history(_fills(spark, d)), marks), "cash", "realized", "unrealized", "equity", places=2)


# The band strategy as a recursion over a symbol's events: closes (c), each day's first price at noon (n) and the first that is due after it (d).
BAND_SQL = """WITH RECURSIVE {prices}, t AS (SELECT *, CAST(ts AS DATE) AS day, date_part('hour', ts) * 60 + date_part('minute', ts) AS m FROM prices),
 closes AS (SELECT symbol, CAST(day + 1 AS TIMESTAMP) AS ts, 'c' AS typ, p, count(*) OVER w AS nb, CASE WHEN count(*) OVER w >= 20 THEN avg(p) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS a FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY day)),
 noon AS (SELECT symbol, day, min(row(ts, price)) AS f FROM t WHERE m BETWEEN 720 AND 724 GROUP BY ALL),
 due AS (SELECT t.symbol, t.day, min(row(t.ts, t.price)) AS f FROM t JOIN noon n ON n.symbol = t.symbol AND n.day = t.day WHERE t.ts >= n.f[1] + INTERVAL 60 SECOND AND t.ts < n.f[1] + INTERVAL 600 SECOND AND m BETWEEN 720 AND 734 GROUP BY ALL),
 ev AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, CASE typ WHEN 'c' THEN 0 ELSE 1 END) AS i, epoch_us(ts) / 1e6 AS now FROM (SELECT * FROM closes UNION ALL SELECT symbol, f[1], 'n', f[2], 0, NULL FROM noon UNION ALL SELECT symbol, f[1], 'd', f[2], 0, NULL FROM due)),
 r AS (SELECT symbol, 0::BIGINT AS i, false AS pos, 0::DOUBLE AS entry, NULL::VARCHAR AS proposed, 0::DOUBLE AS ref, false AS armed, 0::DOUBLE AS trail, false AS by_avg, NULL::VARCHAR AS okind, 0::DOUBLE AS since, NULL::VARCHAR AS kind, NULL::TIMESTAMP AS ts, 0::DOUBLE AS price FROM (SELECT DISTINCT symbol FROM ev)
  UNION ALL SELECT symbol, i, CASE WHEN sent IS NULL THEN pos ELSE sent = 'open' END, entry3, proposed3, ref2, armed3, trail3, by_avg3, CASE WHEN typ = 'c' OR now - since3 < 60 THEN okind3 END, since3, sent, ts, p FROM (
  SELECT *, CASE WHEN typ <> 'c' AND okind3 IS NOT NULL AND now - since3 >= 60 AND now - since3 < 600 THEN okind3 END AS sent FROM (
  SELECT *, CASE WHEN NOT fires THEN entry WHEN prop2 = 'enter' THEN p ELSE 0 END AS entry3, NOT fires AND armed2 AS armed3, CASE WHEN fires THEN 0 ELSE trail2 END AS trail3, NOT fires AND by_avg2 AS by_avg3,
   CASE WHEN typ <> 'n' THEN prop2 END AS proposed3, CASE WHEN NOT fires THEN okind WHEN prop2 = 'enter' THEN 'open' ELSE 'close' END AS okind3, CASE WHEN fires THEN now ELSE since END AS since3 FROM (
  SELECT *, typ = 'n' AND CASE prop2 WHEN 'enter' THEN p > {line} WHEN 'stop' THEN p < {stop} WHEN 'trail' THEN p <= trail2 WHEN 'average' THEN p < ref2 ELSE false END AS fires FROM (
  SELECT *, CASE WHEN typ = 'c' AND nb >= 20 AND NOT pos AND proposed IS NULL AND p > {line} THEN 'enter' WHEN stopped THEN 'stop' WHEN averaged THEN 'average' WHEN hit THEN 'trail' ELSE proposed END AS prop2,
   CASE WHEN averaged THEN a ELSE ref END AS ref2, by_avg OR (trails AND NOT hit AND profit > {arm} AND coalesce(p > a, false)) AS by_avg2 FROM (
  SELECT *, trails AND entry > 0 AND armed2 AND p < trail2 AS hit FROM (
  SELECT *, CASE WHEN trails AND entry > 0 AND armed2 AND floor((profit - {arm}) / {step}) > 0 THEN greatest(trail1, entry + floor((profit - {arm}) / {step}) * {step}) ELSE trail1 END AS trail2 FROM (
  SELECT *, CASE WHEN trails AND entry > 0 THEN armed OR profit > {arm} ELSE armed END AS armed2, CASE WHEN trails AND entry > 0 AND NOT armed AND profit > {arm} THEN entry ELSE trail END AS trail1 FROM (
  SELECT *, live AND p < {stop} AS stopped, live AND p >= {stop} AND by_avg AND coalesce(p < a, false) AS averaged, live AND p >= {stop} AND NOT by_avg AS trails, CASE WHEN entry > 0 THEN p - entry ELSE 0 END AS profit FROM (
  SELECT e.*, r.* EXCLUDE (symbol, i, kind, ts, price), typ = 'c' AND nb >= 20 AND pos AND proposed IS NULL AS live FROM r JOIN ev e ON e.symbol = r.symbol AND e.i = r.i + 1))))))))))
 SELECT symbol, ts, kind, CASE kind WHEN 'open' THEN 'buy' ELSE 'sell' END AS action, 1 AS quantity, price FROM r WHERE kind IS NOT NULL"""
_BAND = {"line": 1.0, "stop": 30.0, "arm": 5.0, "step": 5.0}
_BAND_TICKS = "prices AS (SELECT event_type AS symbol, ts, value AS price FROM events), daily AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, arg_max(value, row(ts, event_id)) AS p FROM events GROUP BY ALL)"
_BAND_SHARES = {"line": 1450.0, "stop": 1100.0, "arm": 60.0, "step": 25.0}
_NOON_SQL = "CAST(ts AS TIMESTAMP) + INTERVAL 12 HOUR + to_seconds(symbol % 5 * 55)"
_BAND_BARS = f"""{BARS}, daily AS (SELECT symbol, ts AS day, close AS p FROM bars), prices AS (SELECT symbol, {_NOON_SQL} AS ts, open AS price FROM bars WHERE dayofyear(ts) % 11 <> 0
  UNION ALL SELECT symbol, {_NOON_SQL} + to_seconds(30 + (symbol * 37 + dayofyear(ts) * 13) % 700), close FROM bars)"""


@query("band_shares", BAND_SQL.format(prices=_BAND_BARS, **_BAND_SHARES))
def band_shares(spark: SparkSession, d: str) -> DataFrame:
    """The band strategy on all shares: opens at noon but for every eleventh day, closes up to twelve minutes later, some of them too early or stale."""
    bars = written(T.daily_bars(spark, d), "bars")
    noon = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + 12 * 3600 + F.col("symbol") % 5 * 55)
    later = F.timestamp_seconds(F.unix_seconds(noon) + 30 + (F.col("symbol") * 37 + F.dayofyear("ts") * 13) % 700)
    first = bars.where(F.dayofyear("ts") % 11 != 0).select("symbol", noon.cast("timestamp_ntz").alias("ts"), F.col("open").alias("price"))
    prices = first.union(bars.select("symbol", later.cast("timestamp_ntz"), "close"))
    return band.run(bars.select("symbol", "ts", "close"), prices, band.Band(**_BAND_SHARES))


@query("band_strategy", BAND_SQL.format(prices=_BAND_TICKS, **_BAND))
def band_strategy(spark: SparkSession, d: str) -> DataFrame:
    ticks = T.ticks(spark, d)
    daily = resample.from_ticks(ticks, "day").select("symbol", "ts", "close")
    return band.run(daily, ticks.select("symbol", "ts", "price"), band.Band(**_BAND))


@query("scalar_opened", """WITH q AS (SELECT event_id, ts AS a, ts + INTERVAL 3 HOUR AS b FROM events), o AS (SELECT unnest([525, 540, 550, 900]) AS m), x AS (SELECT DISTINCT event_id FROM q, o, (SELECT unnest([0, 1]) AS k)
  WHERE isodow(CAST(a AS DATE) + k) < 6 AND CAST(CAST(a AS DATE) + k AS TIMESTAMP) + to_minutes(m) > a AND CAST(CAST(a AS DATE) + k AS TIMESTAMP) + to_minutes(m) <= b)
 SELECT event_id, event_id IN (SELECT event_id FROM x) AS opened FROM q""")  # fmt: skip
def scalar_opened(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").select("event_id", S.session_opened_between(F.col("ts"), F.col("ts") + F.expr("interval 3 hours")).alias("opened"))


_HOURS = "b AS (" + _tick_sql("time_bucket(INTERVAL 1 HOUR, ts)") + ")"
_GAIN, _NET = "(n.close - r.entry) * r.p", "CASE WHEN n.day <> r.day THEN 0 ELSE r.realized END"
_WHY = f"""CASE WHEN r.p = 0 THEN CASE WHEN n.up AND {{blocked}} = 0 THEN 1 ELSE 0 END WHEN {_GAIN} <= -(r.entry * 25 / 100) THEN 3 WHEN {_GAIN} >= r.entry * 80 / 100 THEN 4
  WHEN {_GAIN} <= -18 THEN 5 WHEN {_GAIN} >= 60 THEN 6 WHEN n.down THEN 2 ELSE 0 END"""
_BLOCKED = f"""CASE WHEN r.p <> 0 OR NOT n.up THEN 0 WHEN CASE WHEN n.day <> r.day THEN 0 ELSE r.trades END >= 2 THEN 7 WHEN {_NET} <= -40 THEN 8 WHEN n.ts - r.ordered < INTERVAL 3 HOUR THEN 9 ELSE 0 END"""
_WHY = _WHY.replace("{blocked}", f"({_BLOCKED})")


@query("strategy_intents", f"""WITH RECURSIVE {_HOURS}, m AS (SELECT *, {full('avg', 'close', 2)} AS f, {full('avg', 'close', 4)} AS s FROM b),
 n AS (SELECT symbol, ts, close, CAST(ts AS DATE) AS day, coalesce(f > s AND lag(f) OVER {W} <= lag(s) OVER {W}, false) AS up, coalesce(f < s AND lag(f) OVER {W} >= lag(s) OVER {W}, false) AS down, row_number() OVER {W} AS i FROM m),
 r AS (SELECT symbol, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::DATE AS day, 0 AS p, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS realized, 0 AS trades, NULL::TIMESTAMP AS ordered, 0 AS reason, 0 AS blocked, 0.0::DOUBLE AS price FROM (SELECT DISTINCT symbol FROM n)
  UNION ALL SELECT symbol, i, ts, day, CASE WHEN why = 1 THEN 1 WHEN why > 1 THEN 0 ELSE p END, CASE WHEN why = 1 THEN close WHEN why > 1 THEN 0 ELSE entry END, CASE WHEN why > 1 THEN net + (close - entry) * p ELSE net END,
   CASE WHEN fresh THEN 0 ELSE trades END + CASE WHEN why = 1 THEN 1 ELSE 0 END, CASE WHEN why = 1 THEN ts ELSE ordered END, why, blocked, close
   FROM (SELECT n.symbol, n.i, n.ts, n.day, n.close, r.p, r.entry, {_NET} AS net, r.trades, n.day <> r.day AS fresh, r.ordered, {_WHY} AS why, {_BLOCKED} AS blocked FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1))
 SELECT symbol, ts, CASE WHEN reason = 1 THEN 1 WHEN reason > 1 THEN 2 ELSE 0 END AS kind, CASE WHEN reason > 0 THEN price END AS price, reason, blocked, p AS state, entry AS entry_price, round(realized, 4) AS realized FROM r WHERE i > 0""")  # fmt: skip
def strategy_intents(spark: SparkSession, d: str) -> DataFrame:
    hours = rounded(resample.from_ticks(T.ticks(spark, d), "1h"), "open", "high", "low", "close")
    signals = with_conditions(hours, {"up": ("ma_cross_up", {"fast": 2, "slow": 4}), "down": ("ma_cross_down", {"fast": 2, "slow": 4})}, keep=["symbol", "ts", "close"])
    rules = intents.Rules(stop_pct=25, take_pct=80, stop_abs=18, take_abs=60, max_trades=2, daily_loss=40, cooldown=3 * 3600, stops_first=False)
    done = intents.intents(signals, F.col("up"), F.col("down"), rules).select("symbol", "ts", "kind", "price", "reason", "blocked", "state", "entry_price", "realized")
    return rounded(done, "realized")


# ---------------------------------------------------------------- patterns and levels

N60 = "ROWS BETWEEN 61 PRECEDING AND 2 PRECEDING"


@query("pattern_range", f"""WITH {BARS}, q AS (SELECT symbol, ts, close, lag(close) OVER {W} AS c1, row_number() OVER {W} AS n, max(close) OVER (PARTITION BY symbol ORDER BY ts {N60}) AS t, min(close) OVER (PARTITION BY symbol ORDER BY ts {N60}) AS b,
  min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING) AS s, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING) AS r, min(low) OVER {last(5)} AS l5, max(high) OVER {last(5)} AS h5 FROM bars)
 SELECT symbol, count(*) FILTER (n >= 62 AND close > t AND c1 <= t) AS range_breakout, count(*) FILTER (n >= 62 AND close < b AND c1 >= b) AS range_breakdown, count(*) FILTER (n >= 10 AND close > s AND c1 <= s AND l5 < s) AS undercut_reverse,
  count(*) FILTER (n >= 10 AND close < r AND c1 >= r AND h5 > r) AS false_breakout FROM q GROUP BY symbol""")  # fmt: skip
def pattern_range(spark: SparkSession, d: str) -> DataFrame:
    return _counted(patterns.range_signals(T.daily_bars(spark, d)), ["range_breakout", "range_breakdown", "undercut_reverse", "false_breakout"])


_GAP = lambda k, up: f"lag(low, {k}) OVER {W} > lag(high, {k + 1}) OVER {W} * (1 + 0.005::DOUBLE)" if up else f"lag(high, {k}) OVER {W} < lag(low, {k + 1}) OVER {W} * (1 - 0.005::DOUBLE)"


@query("pattern_islands", f"""WITH {BARS}, q AS (SELECT symbol, row_number() OVER {W} AS n, coalesce(high < lag(low) OVER {W} * (1 - 0.005::DOUBLE), false) AS fall, coalesce(low > lag(high) OVER {W} * (1 + 0.005::DOUBLE), false) AS rise,
  {' OR '.join(f'coalesce({_GAP(k, True)}, false)' for k in range(2, 6))} AS risen, {' OR '.join(f'coalesce({_GAP(k, False)}, false)' for k in range(2, 6))} AS fallen FROM bars)
 SELECT symbol, count(*) FILTER (n >= 8 AND fall AND risen) AS island_reversal_down, count(*) FILTER (n >= 8 AND NOT (fall AND risen) AND rise AND fallen) AS island_reversal_up FROM q GROUP BY symbol""")
def pattern_islands(spark: SparkSession, d: str) -> DataFrame:
    return _counted(patterns.range_signals(T.daily_bars(spark, d)), ["island_reversal_up", "island_reversal_down"])


@query("pattern_regime", f"""WITH {BARS}, a AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars), b AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS k FROM a WHERE n <= 60),
 c AS (SELECT symbol, max(close) AS hi, min(close) AS lo, arg_min(close, n) AS t, avg(close) FILTER (n > k - floor(k / 2)) AS x, avg(close) FILTER (n <= k - floor(k / 2)) AS y FROM b WHERE k >= 10 GROUP BY symbol)
 SELECT symbol, CASE WHEN (y - x) / x * 100 > 6 THEN 'up' WHEN (y - x) / x * 100 < -6 THEN 'down' ELSE 'range' END AS regime, hi AS range_high, lo AS range_low, t AS today_close,
  hi > lo AND (hi - t) / (hi - lo) * 100 <= 3 AS near_high, hi > lo AND (t - lo) / (hi - lo) * 100 <= 3 AS near_low FROM c""")  # fmt: skip
def pattern_regime(spark: SparkSession, d: str) -> DataFrame:
    return patterns.regime(T.daily_bars(spark, d))


# Swings of every bar's windows of 60 and 90 bars as sets: candidates in the window, islands of one kind, the best of each island, the last of each kind.
SWINGS_SQL = f"""{BARS}, n AS (SELECT symbol, ts, high, low, close, row_number() OVER {W} - 1 AS i FROM bars),
 e AS (SELECT *, count(*) OVER v AS c, max(high) OVER v AS mx, min(low) OVER v AS mn FROM n WINDOW v AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 cand AS (SELECT symbol, i, 1 AS k, high AS p FROM e WHERE c = 7 AND high >= mx UNION ALL SELECT symbol, i, -1, low FROM e WHERE c = 7 AND low <= mn),
 seen AS (SELECT b.symbol, b.i AS t, w, c.i, c.k, c.p FROM n b, (VALUES (60), (90)) AS s(w), cand c WHERE c.symbol = b.symbol AND b.i >= 9 AND c.i BETWEEN greatest(b.i - w + 1, 0) + 3 AND b.i - 3),
 isles AS (SELECT *, sum(turn) OVER (PARTITION BY symbol, t, w ORDER BY i, k DESC) AS run FROM (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY symbol, t, w ORDER BY i, k DESC) = k THEN 0 ELSE 1 END AS turn FROM seen)),
 sw AS (SELECT symbol, t, w, run, k, arg_min(i, row(-k * p, i)) AS i, k * max(k * p) AS p FROM isles GROUP BY symbol, t, w, run, k),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol, t, w, k ORDER BY run DESC) AS r FROM sw),
 tops AS (SELECT symbol, t, w, m, {', '.join(f"max(i) FILTER (k = m AND r = {r}) AS i{r}, max(m * p) FILTER (k = m AND r = {r}) AS p{r}" for r in (1, 2, 3))} FROM ranked, (VALUES (1), (-1)) AS s(m) GROUP BY symbol, t, w, m),
 inner_low AS (SELECT x.symbol, x.t, x.w, x.m, arg_max(x.m * s.p, s.i) FILTER (s.i > x.i2 AND s.i < x.i1) AS last21, arg_min(x.m * s.p, s.i) FILTER (s.i > x.i2 AND s.i < x.i1) AS first21, arg_max(x.m * s.p, s.i) FILTER (s.i > x.i3 AND s.i < x.i2) AS last32
  FROM tops x JOIN sw s ON s.symbol = x.symbol AND s.t = x.t AND s.w = x.w AND s.k = -x.m GROUP BY x.symbol, x.t, x.w, x.m),
 alike AS (SELECT symbol, t, m, i1, i2 FROM tops WHERE w = 60 AND i1 > i2 + 1 AND p2 <> 0 AND abs(p1 - p2) / abs(p2) * 100 <= 3),
 lines AS (SELECT a.symbol, a.t, a.m, 'double' AS what, a.i1 + 1 AS start, min(CASE WHEN a.m = 1 THEN b.low ELSE -b.high END) AS line FROM alike a JOIN n b ON b.symbol = a.symbol AND b.i > a.i2 AND b.i < a.i1 GROUP BY ALL
  UNION ALL SELECT x.symbol, x.t, x.m, 'shoulders', i1 + 1, (last32 + first21) / 2 FROM tops x JOIN inner_low y USING (symbol, t, w, m) WHERE w = 90 AND x.t >= 10 AND p2 > p3 + abs(p3) * 0.01 AND p2 > p1 + abs(p1) * 0.01 AND p3 <> 0 AND abs(p1 - p3) / abs(p3) * 100 <= 5
  UNION ALL SELECT x.symbol, x.t, x.m, 'n', i1 + 1, last21 FROM tops x JOIN inner_low y USING (symbol, t, w, m) WHERE w = 90 AND p1 < p2),
 broken AS (SELECT l.symbol, n.ts, l.t, l.what, l.m, l.m * l.line AS line FROM lines l JOIN n ON n.symbol = l.symbol AND n.i = l.t WHERE l.line IS NOT NULL AND l.m * n.close < l.line
  AND NOT EXISTS (SELECT 1 FROM n b WHERE b.symbol = l.symbol AND b.i BETWEEN l.start AND l.t - 1 AND l.m * b.close < l.line)),
 slopes AS (SELECT symbol, t, avg(p) AS level, regr_slope(p, i) FILTER (k = 1) AS up, regr_slope(p, i) FILTER (k = -1) AS down FROM ranked WHERE w = 90 AND t >= 11 AND r <= 4 GROUP BY symbol, t HAVING count(*) FILTER (k = 1) >= 3 AND count(*) FILTER (k = -1) >= 3),
 ways AS (SELECT symbol, t, CASE WHEN abs(up) <= level * 0.05 / 100 THEN 0 ELSE sign(up) END AS a, CASE WHEN abs(down) <= level * 0.05 / 100 THEN 0 ELSE sign(down) END AS b FROM slopes WHERE level > 0),
 swing_signals AS (SELECT symbol, ts, t, CASE what WHEN 'double' THEN CASE m WHEN 1 THEN 'double_top' ELSE 'double_bottom' END WHEN 'shoulders' THEN CASE m WHEN 1 THEN 'head_shoulders_top' ELSE 'head_shoulders_bottom' END ELSE CASE m WHEN 1 THEN 'n_down' ELSE 'n_up' END END AS pattern, NULL::VARCHAR AS label, line FROM broken
  UNION ALL SELECT w.symbol, n.ts, w.t, CASE WHEN a = -1 AND b = 1 THEN 'triangle_symmetrical' WHEN a = 0 AND b = 1 THEN 'triangle_ascending' WHEN a = -1 AND b = 0 THEN 'triangle_descending' WHEN a = 1 AND b = 1 THEN 'wedge_rising' WHEN a = -1 AND b = -1 THEN 'wedge_falling' END, NULL, NULL
   FROM ways w JOIN n ON n.symbol = w.symbol AND n.i = w.t)"""


@query("pattern_swings", f"WITH {SWINGS_SQL} SELECT symbol, ts, pattern, round(line, 4) AS line FROM swing_signals WHERE pattern IS NOT NULL AND (symbol, t) IN (SELECT (symbol, max(i)) FROM n GROUP BY symbol)")
def pattern_swings(spark: SparkSession, d: str) -> DataFrame:
    return rounded(patterns.patterns(T.daily_bars(spark, d)), "line")


_HALF = "list(close) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
_SPAN = "ROWS BETWEEN 59 PRECEDING AND 5 PRECEDING"
_FIRED = {
    "range_breakout": "n1 >= 62 AND close > t AND c1 <= t", "range_breakdown": "n1 >= 62 AND close < b AND c1 >= b", "undercut_reverse": "n1 >= 10 AND close > s AND c1 <= s AND l5 < s", "false_breakout": "n1 >= 10 AND close < r AND c1 >= r AND h5 > r",
    "island_reversal_down": "n1 >= 8 AND fall AND risen", "island_reversal_up": "n1 >= 8 AND NOT (fall AND risen) AND rise AND fallen",
}


@query("pattern_all", f"""WITH {SWINGS_SQL}, h AS (SELECT symbol, ts, close, {_HALF} AS c, i FROM n), g AS (SELECT *, len(c) AS k, list_max(c) AS hi, list_min(c) AS lo FROM h WHERE len(c) >= 10),
 reg AS (SELECT symbol, ts, close, hi, lo, (list_avg(c[k // 2 + 1:]) - list_avg(c[:k // 2])) / list_avg(c[:k // 2]) * 100 AS change FROM g),
 q AS (SELECT symbol, ts, close, i + 1 AS n1, lag(close) OVER {W} AS c1, max(close) OVER (PARTITION BY symbol ORDER BY ts {N60}) AS t, min(close) OVER (PARTITION BY symbol ORDER BY ts {N60}) AS b,
  min(low) OVER (PARTITION BY symbol ORDER BY ts {_SPAN}) AS s, max(high) OVER (PARTITION BY symbol ORDER BY ts {_SPAN}) AS r, min(low) OVER {last(5)} AS l5, max(high) OVER {last(5)} AS h5,
  coalesce(high < lag(low) OVER {W} * (1 - 0.005::DOUBLE), false) AS fall, coalesce(low > lag(high) OVER {W} * (1 + 0.005::DOUBLE), false) AS rise,
  {' OR '.join(f'coalesce({_GAP(k, True)}, false)' for k in range(2, 6))} AS risen, {' OR '.join(f'coalesce({_GAP(k, False)}, false)' for k in range(2, 6))} AS fallen FROM n)
 SELECT symbol, ts, pattern, label, line FROM (
  SELECT symbol, ts, pattern, label, line FROM swing_signals WHERE pattern IS NOT NULL
  UNION ALL SELECT symbol, ts, 'regime', CASE WHEN change > 6 THEN 'up' WHEN change < -6 THEN 'down' ELSE 'range' END, NULL FROM reg
  UNION ALL SELECT symbol, ts, 'near_range_high', NULL, hi FROM reg WHERE hi > lo AND (hi - close) / (hi - lo) * 100 <= 3
  UNION ALL SELECT symbol, ts, 'near_range_low', NULL, lo FROM reg WHERE hi > lo AND (close - lo) / (hi - lo) * 100 <= 3
  {' '.join(f"UNION ALL SELECT symbol, ts, '{name}', NULL, NULL FROM q WHERE {fired}" for name, fired in _FIRED.items())})""")  # fmt: skip
def pattern_all(spark: SparkSession, d: str) -> DataFrame:
    # Lines are prices or means of two, which both engines compute alike.
    return detect.detected(T.daily_bars(spark, d), made_of=T.trades(spark, d).select("symbol"))


_TICK_OF = "CASE " + " ".join(f"WHEN (hi + lo) / 2 < {limit} THEN {t}" for limit, t in S.SHARE_TICKS) + f" ELSE {S.SHARE_TOP_TICK} END"


PROFILE_SQL = f"""{BARS}, a AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM bars GROUP BY symbol HAVING max(high) > min(low)), b AS (SELECT *, greatest((hi - lo) / 40, {_TICK_OF}) AS w FROM a),
 c AS (SELECT *, greatest(1, CAST(round_even((hi - lo) / w, 0) AS INTEGER)) AS n FROM b), x AS (SELECT c.*, volume, least(n - 1, greatest(0, CAST(floor((low - lo) / w) AS INTEGER))) AS i0, least(n - 1, greatest(0, CAST(floor((high - lo) / w) AS INTEGER))) AS i1 FROM bars JOIN c USING (symbol) WHERE volume > 0),
 y AS (SELECT symbol, unnest(generate_series(i0, i1)) AS bin, volume / (i1 - i0 + 1) AS v FROM x), z AS (SELECT symbol, bin, round(sum(v), 6) AS v FROM y GROUP BY 1, 2), e AS (SELECT symbol, unnest(generate_series(0, n - 1)) AS bin FROM c),
 profile AS (SELECT e.symbol, CAST(e.bin AS INTEGER) AS bin, coalesce(z.v, 0) AS v, lo + w * e.bin AS bin_lo, CASE WHEN e.bin = n - 1 THEN greatest(hi, lo + w * n) ELSE lo + w * (e.bin + 1) END AS bin_hi, n FROM e JOIN c USING (symbol) LEFT JOIN z ON z.symbol = e.symbol AND z.bin = e.bin)"""


@query("volume_profile", f"WITH {PROFILE_SQL} SELECT symbol, bin, round(v, 4) AS volume FROM profile")
def volume_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(levels.histogram(T.daily_bars(spark, d)).select("symbol", "bin", "volume"), "volume")


@query("value_area", f"""WITH RECURSIVE {PROFILE_SQL}, t AS (SELECT symbol, sum(v) AS total, arg_max(bin, row(v, -bin)) AS p, max(n) AS n FROM profile GROUP BY symbol HAVING sum(v) > 0),
 g AS (SELECT t.symbol, p AS l, p AS h, v AS s FROM t JOIN profile x ON x.symbol = t.symbol AND x.bin = p
  UNION ALL SELECT symbol, CASE WHEN r >= q THEN l ELSE l - 1 END, CASE WHEN r >= q THEN h + 1 ELSE h END, s + CASE WHEN r >= q THEN r ELSE q END FROM (
   SELECT g.*, coalesce(a.v, -1) AS q, coalesce(b.v, -1) AS r FROM g JOIN t ON t.symbol = g.symbol LEFT JOIN profile a ON a.symbol = g.symbol AND a.bin = g.l - 1 LEFT JOIN profile b ON b.symbol = g.symbol AND b.bin = g.h + 1 WHERE g.s < t.total * 0.7::DOUBLE AND NOT (g.l = 0 AND g.h = t.n - 1))),
 w AS (SELECT symbol, min(l) AS l, max(h) AS h FROM g GROUP BY symbol)
 SELECT w.symbol, (c.bin_lo + c.bin_hi) / 2 AS poc, b.bin_hi AS vah, a.bin_lo AS val, round(total, 4) AS total_volume FROM w JOIN t USING (symbol) JOIN profile a ON a.symbol = w.symbol AND a.bin = l JOIN profile b ON b.symbol = w.symbol AND b.bin = h JOIN profile c ON c.symbol = w.symbol AND c.bin = p""")  # fmt: skip
def value_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(levels.value_area(levels.histogram(T.daily_bars(spark, d))), "total_volume")


# Levels as sets: thinned nodes and merged candidates are folds over numbered rows.
_AREA_CTES, _AREA_ROWS = ORACLE_SQL["value_area"].rsplit("\n SELECT w.symbol", 1)
_TICK_BANDS = _band_sql(S.SHARE_TICKS, S.SHARE_TOP_TICK)
LEVELS_SQL = f"""{_AREA_CTES}, area AS (SELECT w.symbol{_AREA_ROWS}), scale AS (SELECT symbol, max(v) AS most, arg_min(bin_hi - bin_lo, bin) AS width FROM profile GROUP BY symbol),
 cur AS (SELECT symbol, p AS current, CAST({_TICK_BANDS} AS DOUBLE) AS tick FROM (SELECT symbol, arg_max(close, ts) AS p FROM bars GROUP BY symbol)),
 about AS (SELECT * FROM area JOIN scale USING (symbol) JOIN cur USING (symbol)),
 sides AS (SELECT *, lag(v) OVER o AS l, lead(v) OVER o AS r FROM profile WINDOW o AS (PARTITION BY symbol ORDER BY bin)),
 peaks AS (SELECT symbol, bin, v, (bin_lo + bin_hi) / 2 AS price, v >= greatest(l, r) AS fl FROM sides WHERE l IS NOT NULL AND r IS NOT NULL AND NOT (v = l AND v = r) AND (v >= greatest(l, r) OR v <= least(l, r))),
 nd AS (SELECT *, row_number() OVER (PARTITION BY symbol, fl ORDER BY CASE WHEN fl THEN -v ELSE v END, bin) AS k FROM peaks),
 thinned AS (SELECT DISTINCT symbol, fl, 0::BIGINT AS k, CAST([] AS INTEGER[]) AS kept FROM nd
  UNION ALL SELECT n.symbol, n.fl, n.k, CASE WHEN len(list_filter(kept, lambda q: abs(q - n.bin) < 2)) > 0 THEN kept ELSE list_append(kept, n.bin) END FROM thinned r JOIN nd n ON n.symbol = r.symbol AND n.fl = r.fl AND n.k = r.k + 1),
 nodes AS (SELECT h.symbol, h.fl, h.place, nd.price, nd.v FROM (SELECT symbol, fl, unnest(kept) AS bin, unnest(range(len(kept))) AS place FROM (SELECT symbol, fl, arg_max(kept, k) AS kept FROM thinned GROUP BY ALL)) h JOIN nd USING (symbol, fl, bin)),
 around AS (SELECT *, count(*) OVER o AS c, max(high) OVER o AS mx, min(low) OVER o AS mn, avg(volume) OVER (PARTITION BY symbol) AS mean FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 turns AS (SELECT symbol, ts, unnest([CASE WHEN high = mx THEN 4 END, CASE WHEN low = mn THEN 5 END]) AS ord, unnest([high, low]) AS price FROM around WHERE c = 7 AND (mean <= 0 OR volume >= mean * 1.3::DOUBLE)),
 cand AS (SELECT symbol, 0 AS ord, 0 AS place, poc AS price, 'POC' AS kind, 1.0::DOUBLE AS strength FROM about UNION ALL SELECT symbol, 1, 0, vah, 'VAH', 0.75 FROM about UNION ALL SELECT symbol, 2, 0, val, 'VAL', 0.75 FROM about
  UNION ALL SELECT symbol, 3, place, n.price, 'HVN', greatest(0.15::DOUBLE, least(0.95::DOUBLE, v / most)) FROM nodes n JOIN about USING (symbol) WHERE fl AND abs(n.price - poc) > width / 2
  UNION ALL SELECT symbol, ord, row_number() OVER (PARTITION BY symbol, ord ORDER BY ts), price, CASE ord WHEN 4 THEN 'SwingHigh' ELSE 'SwingLow' END, 0.5 FROM turns WHERE ord IS NOT NULL),
 numbered AS (SELECT c.*, greatest(2 * tick, 0.5::DOUBLE * width) AS tol, row_number() OVER (PARTITION BY c.symbol ORDER BY -strength, ord, place) AS k FROM cand c JOIN about USING (symbol)),
 folded AS (SELECT DISTINCT symbol, 0::BIGINT AS k, CAST([] AS STRUCT(price DOUBLE, kind VARCHAR, strength DOUBLE, kinds VARCHAR[])[]) AS m FROM numbered
  UNION ALL SELECT symbol, k, CASE WHEN spot > 0 THEN list_transform(m, lambda q, j: CASE WHEN j = spot THEN {{'price': q.price, 'kind': q.kind, 'strength': least(1, q.strength + strength * 0.25::DOUBLE), 'kinds': CASE WHEN list_contains(q.kinds, kind) THEN q.kinds ELSE list_append(q.kinds, kind) END}} ELSE q END)
    ELSE list_append(m, {{'price': price, 'kind': kind, 'strength': strength, 'kinds': [kind]}}) END
   FROM (SELECT n.*, r.m, coalesce(list_position(list_transform(r.m, lambda q: abs(q.price - n.price) < n.tol), true), 0) AS spot FROM folded r JOIN numbered n ON n.symbol = r.symbol AND n.k = r.k + 1)),
 found AS (SELECT symbol, 0 AS grp, -x.strength AS rank, place, x.price AS p, x.kind AS kind, x.strength AS strength, array_to_string(x.kinds, ',') AS kinds FROM (SELECT symbol, unnest(m) AS x, unnest(range(len(m))) AS place FROM (SELECT symbol, arg_max(m, k) AS m FROM folded GROUP BY symbol))
  UNION ALL SELECT symbol, 1, 0, place, price, 'LVN', 0.25, 'LVN' FROM nodes WHERE NOT fl AND symbol IN (SELECT symbol FROM about)),
 once AS (SELECT * EXCLUDE (p), tick AS tick1, round(round_even(p / tick, 0) * tick, 4) AS p FROM (SELECT *, CAST({_TICK_BANDS} AS DOUBLE) AS tick FROM found)),
 aligned AS (SELECT * EXCLUDE (p), CASE WHEN tick2 <> tick1 THEN round(round_even(p / tick2, 0) * tick2, 4) ELSE p END AS price FROM (SELECT *, CAST({_TICK_BANDS} AS DOUBLE) AS tick2 FROM once)),
 firsts AS (SELECT * FROM aligned WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY symbol, grp, price ORDER BY rank, place) = 1), best AS (SELECT * FROM firsts QUALIFY grp = 1 OR row_number() OVER (PARTITION BY symbol, grp ORDER BY rank, place) <= 8),
 held AS (SELECT * FROM best QUALIFY grp = min(grp) OVER (PARTITION BY symbol, price))
 SELECT symbol, price, kind, kinds, CASE WHEN abs(price - current) < cur.tick THEN 'current' WHEN price > current THEN 'resistance' ELSE 'support' END AS role, round(strength, 3) AS strength, coalesce(round((price - current) / current * 100, 2), 0) AS distance_pct FROM held JOIN cur USING (symbol)"""


@query("support_resistance", LEVELS_SQL)
def support_resistance(spark: SparkSession, d: str) -> DataFrame:
    return levels.support_resistance(T.daily_bars(spark, d)).withColumn("kinds", F.array_join("kinds", ","))


@query("fibonacci", f"""WITH {BARS}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS n FROM bars), b AS (SELECT symbol, max(high) AS hi, min(low) AS lo, arg_max(ts, row(high, n)) AS ht, arg_min(ts, row(low, -n)) AS lt FROM a WHERE n <= 120 GROUP BY symbol HAVING count(*) >= 2 AND max(high) > min(low))
 SELECT symbol, CASE WHEN ht > lt THEN 'up' ELSE 'down' END AS trend, CAST(ratio AS DOUBLE) AS ratio, round(CASE WHEN ht > lt THEN hi - (hi - lo) * ratio ELSE lo + (hi - lo) * ratio END, 4) AS price FROM b, (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in levels.RATIOS)}]) AS ratio)""")  # fmt: skip
def fibonacci(spark: SparkSession, d: str) -> DataFrame:
    return rounded(levels.fibonacci(T.daily_bars(spark, d)).select("symbol", "trend", "ratio", "price"), "price")


# ---------------------------------------------------------------- other stores, differences


@query("store_sqlite", f"WITH {BARS} SELECT symbol::VARCHAR AS symbol, CAST(ts AS TIMESTAMP) AS ts, close, volume::DOUBLE AS volume FROM bars WHERE ts >= DATE '1994-01-01' AND ts <= DATE '1996-06-30'")
def store_sqlite(spark: SparkSession, d: str) -> DataFrame:
    where = folder(spark, "sqlite")
    bars = T.daily_bars(spark, d).withColumns({"symbol": F.col("symbol").cast("string"), "ts": F.col("ts").cast("timestamp_ntz"), "asset_type": F.lit("share"), "timeframe": F.lit("day")})
    sqlite.write_sqlite(bars.withColumns({c: F.col(c).cast("double") for c in OHLCV}), where)
    rows = sqlite.sqlite_bars(spark, where, ["symbol", "timeframe", "ts", "close", "volume"])
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("1994-01-01", "1996-06-30"))
    return rows.where((F.col("timeframe") == "day") & (F.col("ts") >= start) & (F.col("ts") <= end)).drop("timeframe")


@query("table_difference", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders),
 b AS (SELECT k, CASE WHEN k % 997 = 3 THEN 'X' ELSE s END AS s, CASE WHEN k % 499 = 7 THEN p + 1 ELSE p END AS p FROM a WHERE k % 1009 <> 5 UNION ALL SELECT -k, s, p FROM a WHERE k % 2003 = 11),
 j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS only_b, b.k IS NULL AS only_a, a.s AS s1, b.s AS s2, a.p AS p1, b.p AS p2 FROM a FULL JOIN b ON a.k = b.k),
 d AS (SELECT k, NULL AS "column", 'missing' AS kind FROM j WHERE only_a UNION ALL SELECT k, NULL, 'unexpected' FROM j WHERE only_b
  UNION ALL SELECT k, 'o_orderstatus', 'changed' FROM j WHERE s1 <> s2 UNION ALL SELECT k, 'o_totalprice', 'changed' FROM j WHERE p1 <> p2)
 SELECT '["' || k || '"]' AS key, "column", kind FROM d ORDER BY key, "column" NULLS FIRST LIMIT 50""")  # fmt: skip
def table_difference(spark: SparkSession, d: str) -> DataFrame:
    a = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    status, price = F.when(k % 997 == 3, "X").otherwise(F.col("o_orderstatus")), F.when(k % 499 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    b = a.where(k % 1009 != 5).withColumns({"o_orderstatus": status, "o_totalprice": price}).union(a.where(k % 2003 == 11).withColumn("o_orderkey", -k))
    return difference.differences(a, b, ["o_orderkey"]).select("key", "column", "kind")


# ---------------------------------------------------------------- streams


@query("stream_bars", "WITH b AS (" + _tick_sql("time_bucket(INTERVAL 1 HOUR, ts)") + ") SELECT symbol, CAST(ts AS TIMESTAMP) AS ts, open, high, low, close, volume FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    from barspark.streaming import bars as stream

    rows = stream.drained(stream.closed_bars(stream.tick_stream(spark, d)), folder(spark, "stream"))
    return rounded(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")), *OHLCV)


# What a stream has seen to the end: rows up to its last watermark, which has milliseconds.
SEEN = "seen AS (SELECT event_type AS symbol, ts, event_id, value FROM events WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events))"


@query("stream_signals", f"""WITH RECURSIVE {SEEN}, n AS (SELECT symbol, ts, event_id, value AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i FROM seen),
 r AS (SELECT symbol, i, ts, close, close AS f, close AS s FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.ts, n.close, r.f + 2.0::DOUBLE / 6 * (n.close - r.f), r.s + 2.0::DOUBLE / 21 * (n.close - r.s) FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1),
 g AS (SELECT *, f > s AS above, lag(f > s) OVER (PARTITION BY symbol ORDER BY i) AS before FROM r), h AS (SELECT *, above AND NOT before AS up, NOT above AND before AS down FROM g WHERE before IS NOT NULL),
 k AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i) AS opened, last_value(CASE WHEN up THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i) AS entry FROM h)
 SELECT symbol, ts, CASE WHEN up THEN 'open' ELSE 'close' END AS action, close AS price, CASE WHEN down THEN close - entry END AS pnl FROM k WHERE up OR (down AND opened > 0)""")  # fmt: skip
def stream_signals(spark: SparkSession, d: str) -> DataFrame:
    from barspark.streaming import bars as stream

    return _drained(stream.crossing_signals(stream.tick_stream(spark, d)))


def _drained(rows: DataFrame) -> DataFrame:
    from barspark.streaming import bars as stream

    out = stream.run_to_end(rows, folder(rows.sparkSession, "stream"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_sessions", """WITH p AS (SELECT event_type AS symbol, ts, event_id, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS k FROM p)
 SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS ticks FROM g GROUP BY symbol, k HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")  # fmt: skip
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    from barspark.streaming import bars as stream

    rows = stream.drained(stream.sessions(stream.tick_stream(spark, d)), folder(spark, "stream"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


STOP_RULE = {"stop_pct": 20.0, "stop_points": 15.0, "take_pct": 60.0, "take_points": 45.0}
_MOVE = "(CASE WHEN r.q > 0 THEN 1 ELSE -1 END * (n.value - r.e))"
_REASON = f"""CASE WHEN n.fill IS NOT NULL OR r.q = 0 OR r.e <= 0 OR n.value <= 0 THEN NULL WHEN -({_MOVE} / r.e * 100) >= 20 THEN 'stop_pct' WHEN -{_MOVE} >= 15 THEN 'stop_points'
  WHEN {_MOVE} / r.e * 100 >= 60 THEN 'take_pct' WHEN {_MOVE} >= 45 THEN 'take_points' END"""


@query("stream_stops", f"""WITH RECURSIVE {SEEN}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS i, (CASE WHEN event_id % 20 = 0 THEN CASE WHEN event_id % 40 = 0 THEN 1 ELSE -1 END * (1 + event_id % 3) END)::DOUBLE AS fill FROM seen),
 r AS (SELECT symbol, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS q, 0.0::DOUBLE AS e, NULL::VARCHAR AS reason, 0.0::DOUBLE AS held, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS price FROM (SELECT DISTINCT symbol FROM n)
  UNION ALL SELECT n.symbol, n.i, n.ts,
   CASE WHEN n.value <= 0 THEN r.q WHEN n.fill IS NOT NULL THEN r.q + n.fill WHEN {_REASON} IS NOT NULL THEN 0 ELSE r.q END,
   CASE WHEN n.value <= 0 THEN r.e WHEN n.fill IS NULL THEN CASE WHEN {_REASON} IS NOT NULL THEN 0 ELSE r.e END WHEN r.q + n.fill = 0 THEN 0
    WHEN r.q * n.fill >= 0 THEN (r.q * r.e + n.fill * n.value) / (r.q + n.fill) WHEN r.q * (r.q + n.fill) < 0 THEN n.value ELSE r.e END,
   {_REASON}, r.q, r.e, n.value FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
 SELECT symbol, ts, CASE WHEN held > 0 THEN 'sell' ELSE 'buy' END AS action, abs(held) AS quantity, price, round(entry, 6) AS entry, reason FROM r WHERE reason IS NOT NULL""")  # fmt: skip
def stream_stops(spark: SparkSession, d: str) -> DataFrame:
    from barspark.streaming import bars as stream
    from barspark.streaming.folds import LiveStops

    side = F.when(F.col("event_id") % 40 == 0, 1).otherwise(-1)
    filled = stream.tick_stream(spark, d).where("event_id % 20 = 0").withColumns({"side": side, "quantity": 1 + F.col("event_id") % 3})
    return rounded(_drained(stream.stops(filled, stream.tick_stream(spark, d).where("event_id % 20 <> 0"), LiveStops(**STOP_RULE))), "entry", places=6)


@query("stream_notices", f"""WITH {SEEN}, e AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN value < 30 THEN 'down' WHEN value > 80 THEN 'up' ELSE 'range' END END AS regime FROM seen),
 l AS (SELECT *, lag(regime) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before FROM e)
 SELECT symbol, ts, 'regime' AS pattern, regime AS label FROM l WHERE regime IS NOT NULL AND regime IS DISTINCT FROM before
 UNION ALL SELECT symbol, ts, 'spike', 'over 120' FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id) AS i FROM seen WHERE value > 120) WHERE i = 1""")  # fmt: skip
def stream_notices(spark: SparkSession, d: str) -> DataFrame:
    from barspark.streaming import bars as stream
    from barspark.streaming.folds import Notices

    return _drained(stream.notices(evaluations(stream.tick_stream(spark, d)), Notices()))


def evaluations(ticks: DataFrame) -> DataFrame:
    """symbol, ts, seq, pattern, label: what each tick says. The regime lasts, a spike does not; every seventh tick sees no regime."""
    signal = lambda p, label: F.struct(F.lit(p).alias("pattern"), label.alias("label"))
    regime = F.when(F.col("price") < 30, "down").when(F.col("price") > 80, "up").otherwise("range")
    found = F.array_compact(F.array(F.when(F.col("event_id") % 7 != 0, signal("regime", regime)), F.when(F.col("price") > 120, signal("spike", F.lit("over 120")))))
    return ticks.select("symbol", "ts", F.col("event_id").alias("seq"), F.explode_outer(found).alias("_s")).select("symbol", "ts", "seq", "_s.pattern", "_s.label")


@query("stream_daily_gate", f"WITH {SEEN} SELECT symbol, ts, event_id, value AS price FROM seen WHERE ts >= CAST(ts AS DATE) + INTERVAL 14 HOUR QUALIFY row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts, event_id) = 1")
def stream_daily_gate(spark: SparkSession, d: str) -> DataFrame:
    from barspark.streaming import bars as stream

    return _drained(stream.once_a_day(stream.tick_stream(spark, d)))
