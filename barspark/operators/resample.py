"""Bars from ticks and from finer bars: fixed, calendar and session buckets, continuous contracts and price adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.functions.scalars import DAY_SESSION
from barspark.sources.tables import ohlcv


def minute_bucket(ts: Column, minutes: int, offset_minutes: int = 0) -> Column:
    """Start of the bucket of so many minutes since the epoch, in the zone that offset gives; a TIMESTAMP_NTZ."""
    at = F.floor(F.unix_micros(ts.cast("timestamp")) / 60_000_000).cast("long") + offset_minutes
    start = at - F.pmod(at, F.lit(minutes)) - offset_minutes
    return F.timestamp_seconds(start * 60).cast("timestamp_ntz")


def session_day(ts: Column) -> Column:
    """The trading day: what is after the day session's close belongs to the next calendar day, a Friday's night to Saturday."""
    late = F.hour(ts) * 60 + F.minute(ts) > DAY_SESSION[1]
    return F.date_add(F.to_date(ts), F.when(late, 1).otherwise(0))


def in_day_session(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).between(*DAY_SESSION)


def bucket(ts: Column, frame: str) -> Column:
    """frame: `<n>m`, `<n>h`, day, week (from Monday), month or session."""
    from barspark.functions.scalars import timeframe_minutes

    if (minutes := timeframe_minutes(frame)) is not None:
        return minute_bucket(ts, minutes)
    if frame == "session":
        return session_day(ts)
    return F.date_trunc(frame, ts).cast("date")


def from_ticks(ticks: DataFrame, frame: str, day_session_only: bool = False) -> DataFrame:
    """symbol, ts, open, high, low, close, volume; ties of ts are ordered by event_id."""
    rows = ticks.where(in_day_session(F.col("ts"))) if day_session_only else ticks
    rows = rows.select("symbol", bucket(F.col("ts"), frame).alias("bar"), "price", "size", F.struct("ts", "event_id").alias("ord"))
    return rows.groupBy("symbol", F.col("bar").alias("ts")).agg(*ohlcv(F.col("price"), F.col("ord"), F.col("size")))


def coarser(bars: DataFrame, frame: str) -> DataFrame:
    """Bars of a longer frame from bars: first open, highest high, lowest low, last close, summed volume."""
    rows = bars.withColumn("_bar", bucket(F.col("ts"), frame))
    return rows.groupBy("symbol", F.col("_bar").alias("ts")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    )


def continuous_contract(raw: DataFrame, rank: int = 1, day_only: bool = False) -> DataFrame:
    """symbol, ts, open, high, low, close, volume of the rank-th contract month of each day, or the last there is.

    Rows have ts, product, month, session (regular or after). The after session opens the day and the regular one closes
    it; week contracts and spreads (months that are not six digits) are left out, as are days without a close.
    """
    rows = raw.where(F.col("month").rlike(r"^\d{6}$"))
    day = Window.partitionBy("product", "ts")
    rows = rows.withColumn("_rank", F.dense_rank().over(day.orderBy("month"))).withColumn("_most", F.max("_rank").over(day))
    rows = rows.where(F.col("_rank") == F.least(F.lit(rank), F.col("_most")))
    if day_only:
        rows = rows.where("session = 'regular'")
    of = lambda session, column: F.max(F.when(F.col("session") == session, F.col(column)))
    out = rows.groupBy(F.col("product").alias("symbol"), "ts").agg(
        F.coalesce(of("after", "open"), of("regular", "open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.coalesce(of("regular", "close"), of("after", "close")).alias("close"),
        F.sum("volume").alias("volume"),
    )
    out = out.where(F.col("close").isNotNull()).withColumn("open", F.coalesce("open", "close"))
    return out.withColumns({"high": F.coalesce("high", F.greatest("open", "close")), "low": F.coalesce("low", F.least("open", "close"))})


#: Fixed value: the day on which the night session began.
NIGHT_START = "2017-05-15"


def session_regime(bars: DataFrame, night_start: str = NIGHT_START) -> DataFrame:
    """symbol, regime, pre_gap, post_gap, ratio: from medians of the gaps between a close and the next open.

    With 20 gaps or more on both sides of night_start, a fall of 2.5 times or more says that the series mixes sessions; else
    a series that ends before is of the day alone, and a later one has the night if its median gap is under 0.2 percent.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    before = F.lag("close").over(w)
    gaps = bars.select("symbol", "ts", (F.abs(F.try_divide(F.col("open") - before, before)) * 100).alias("gap"))
    early = F.col("ts") < F.lit(night_start).cast("date")
    median = lambda c: F.percentile(F.when(c, F.col("gap")), 0.5)
    seen = F.col("gap").isNotNull()
    out = gaps.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count("gap").alias("gaps"), F.max("ts").alias("last"), F.count_if(early & seen).alias("n_pre"), F.count_if(~early & seen).alias("n_post"),
        median(early).alias("m_pre"), median(~early).alias("m_post"), F.percentile("gap", 0.5).alias("m_all"),
    )
    spans = (F.col("n_pre") >= 20) & (F.col("n_post") >= 20)
    ratio = F.when(spans & (F.col("m_post") > 1e-9), F.col("m_pre") / F.col("m_post"))
    regime = (
        F.when((F.col("bars") < 30) | (F.col("gaps") == 0), "unknown")
        .when(spans, F.when(ratio >= 2.5, "mixed").otherwise("day_only"))
        .when(F.col("last") < F.lit(night_start).cast("date"), "day_only")
        .otherwise(F.when(F.col("m_all") < 0.2, "all_session").otherwise("day_only"))
    )
    late = ~spans & (F.col("last") >= F.lit(night_start).cast("date"))
    return out.select("symbol", regime.alias("regime"), F.when(spans, F.col("m_pre")).alias("pre_gap"), F.when(spans, F.col("m_post")).when(late, F.col("m_all")).alias("post_gap"), ratio.alias("ratio"))


def adjusted(bars: DataFrame, adjusted_close: DataFrame) -> DataFrame:
    """bars with prices times, and volume over, the ratio of adjusted to plain close, anchored so that the last is 1.

    A day without an adjusted close takes the ratio of the day before, the first days that of the first one known, and a
    symbol without any 1. adjusted_close has symbol, ts, adj_close.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = bars.join(adjusted_close.select("symbol", "ts", "adj_close"), ["symbol", "ts"], "left")
    rows = rows.withColumn("_r", F.try_divide("adj_close", "close"))
    back = F.last("_r", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_r", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_r", F.coalesce(back, ahead, F.lit(1.0)))
    rows = rows.withColumn("_last", F.last("_r").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ratio = F.when(F.col("_last") > 0, F.col("_r") / F.col("_last")).otherwise(F.col("_r"))
    rows = rows.withColumn("_ratio", ratio)
    return rows.select("symbol", "ts", *((F.col(c) * F.col("_ratio")).alias(c) for c in ("open", "high", "low", "close")), (F.col("volume") / F.col("_ratio")).alias("volume"))
