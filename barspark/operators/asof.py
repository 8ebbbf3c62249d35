"""As-of joins by union and a window, one shuffle by key and no inequality join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], right_on: str | None = None, allow_exact: bool = True) -> DataFrame:
    """left with the values of the last right row whose time is at or before (allow_exact: else strictly before) its own.

    by may be empty only for a right side of bounded size, which is then joined through ranges of days (see flow).
    Of right rows with equal keys and times, the greatest values count.
    """
    right_on = right_on or on
    taken = F.struct(*values)
    rows = left.select(*[F.col(c) for c in by], F.col(on).alias("_at"), F.lit(1 if allow_exact else -1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(taken.alias("x")).schema["x"].dataType).alias("_right"))
    other = right.groupBy(*by, right_on).agg(F.max(taken).alias("_right")).select(*[F.col(c) for c in by], F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), "_right")
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.unionByName(other).withColumn("_found", F.last("_right", ignorenulls=True).over(w)).where(F.col("_left").isNotNull())
    return joined.select("_left.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], last: str | None = None) -> DataFrame:
    """left with the values of the first right row whose time is at or after its own, else null.

    last names a column with a struct of the values of the last right row of the same keys. The window goes back in time, so that its frame grows
    by a row at each step; one that looks forward would be folded anew at each row.
    """
    taken = F.struct(*values)
    rows = left.select(*[F.col(c) for c in by], F.col(on).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(taken.alias("x")).schema["x"].dataType).alias("_right"))
    other = right.groupBy(*by, on).agg(F.max(taken).alias("_right")).select(*[F.col(c) for c in by], F.col(on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"), "_right")
    w = Window.partitionBy(*by).orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = {"_found": F.last("_right", ignorenulls=True).over(w)}
    if last:
        found["_final"] = F.max_by("_right", F.when(F.col("_side") == 1, F.col("_at"))).over(Window.partitionBy(*by))
    joined = rows.unionByName(other).withColumns(found).where(F.col("_left").isNotNull())
    return joined.select("_left.*", *(F.col(f"_found.{v}").alias(v) for v in values), *([F.col("_final").alias(last)] if last else []))


def executed_elsewhere(watched: DataFrame, traded: DataFrame, by: Sequence[str]) -> DataFrame:
    """watched bars with exec_open and exec_close of the traded series: its first bar at or after; past its end its last close, twice."""
    renamed = traded.select(*by, "ts", F.col("open").alias("exec_open"), F.col("close").alias("exec_close"))
    out = asof_forward(watched, renamed, by, "ts", ["exec_open", "exec_close"], last="_last")
    return out.withColumns({c: F.coalesce(c, F.col("_last.exec_close")) for c in ("exec_open", "exec_close")}).drop("_last")


def with_flow(bars: DataFrame, flow: DataFrame, columns: Sequence[str], same_day: bool = False) -> DataFrame:
    """bars with a symbol's flow as known at the bar: of the calendar day before, or of the same day."""
    known = flow if same_day else flow.withColumn("ts", F.date_add("ts", 1))
    return asof_backward(bars, known, ["symbol"], "ts", columns)


def with_market_series(bars: DataFrame, series: DataFrame, columns: Sequence[str], same_day: bool = False) -> DataFrame:
    """bars with the last row of a series that all symbols share, one row a day.

    The series becomes intervals of days, exploded to a row for each day up to the next row of the series (at most
    span_days), and joined by equality on the day; the days of a market are bounded, whatever the number of symbols.
    """
    one = Window.orderBy("ts")
    shifted = series.groupBy("ts").agg(*(F.max(c).alias(c) for c in columns))
    shifted = shifted if same_day else shifted.withColumn("ts", F.date_add("ts", 1))
    end = bars.agg(F.max("ts").alias("_end"))
    # One row a day for the whole market: small by nature, and joined by day.
    spans = shifted.withColumn("_next", F.lead("ts").over(one)).crossJoin(end)
    until = F.coalesce(F.date_sub("_next", 1), F.greatest("ts", "_end"))
    days = spans.select(F.explode(F.sequence("ts", until)).alias("ts"), *columns)
    return bars.join(days, "ts", "left").select(*bars.columns, *columns)
