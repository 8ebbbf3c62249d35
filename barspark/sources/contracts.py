"""Daily bars of futures by product, session and rank of the contract month: built in one pass, stored by that key, loaded by it, and put
before a series of another source.

A series is named by product (upper case), session (`all`, with the after-hours session, or `day`) and rank (1 for the nearest month).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.operators.resample import bucket
from barspark.sources.barstore import prepended
from barspark.sources.scratch import removed

KEY = ("product", "session", "rank")
PRICES = ("open", "high", "low", "close")
SESSIONS = ("all", "day")
SCHEMA = "ts date, open double, high double, low double, close double, volume double, product string, session string, rank int"
#: Frames that daily bars can serve; minutes and hours they cannot.
DAILY_FRAMES = ("day", "week", "month")


def product_name(product: Column) -> Column:
    return F.upper(F.trim(product))


def contract_bars(raw: DataFrame, ranks: Sequence[int] = (1, 2, 3), sessions: Sequence[str] = SESSIONS) -> DataFrame:
    """product, session, rank, ts and a bar: all series of the given ranks and sessions.

    raw has ts, product, month, session (regular or after) and a bar a session. A day's months are ranked; a rank beyond them takes the last
    there is. Week contracts and spreads (months that are not six digits), rows without product or date and days without a close are left
    out. The after session opens the day and the regular one closes it; a missing extreme is that of open and close, a missing volume 0. Of a
    session that occurs twice the higher open and close count. An empty table gives none.

    Rows are dealt once, by product and day: ranking, folding sessions and forming all the series need no further shuffle.
    """
    rows = raw.where(F.col("month").rlike(r"^\d{6}$")).select(product_name(F.col("product")).alias("product"), F.col("ts").cast("date").alias("ts"), "month", "session", *PRICES, "volume")
    rows = rows.where("product is not null and ts is not null")
    day = Window.partitionBy("product", "ts")
    rows = rows.withColumn("_k", F.dense_rank().over(day.orderBy("month"))).withColumn("_most", F.max("_k").over(day))
    session = F.col("session")
    of = lambda name, f, c: f(F.when(session == name, F.col(c)))
    months = rows.groupBy("product", "ts", "_k", "_most").agg(
        *(of(s, f, c).alias(f"{s}_{c}") for s in ("regular", "after") for c, f in (("open", F.max), ("high", F.max), ("low", F.min), ("close", F.max), ("volume", F.sum)))
    )

    def bar(name: str) -> Column:
        both = lambda c: (F.col(f"regular_{c}"), F.col(f"after_{c}") if name == "all" else F.lit(None).cast("double"))
        (o, o2), (h, h2), (lo, lo2), (c, c2), (v, v2) = (both(x) for x in (*PRICES, "volume"))
        close = F.coalesce(c, c2)
        first = F.coalesce(o2, o, close)
        fields = (first, F.coalesce(F.greatest(h, h2), F.greatest(first, close)), F.coalesce(F.least(lo, lo2), F.least(first, close)), close, F.coalesce(v, F.lit(0.0)) + F.coalesce(v2, F.lit(0.0)))
        return F.struct(F.lit(name).alias("session"), *(x.cast("double").alias(n) for x, n in zip(fields, (*PRICES, "volume"), strict=True)))

    served = F.filter(F.array(*map(F.lit, ranks)), lambda r: F.least(r, F.col("_most")) == F.col("_k"))
    months = months.select("product", "ts", F.explode(served).alias("rank"), F.array(*map(bar, sessions)).alias("_bars"))
    return months.select("product", "rank", "ts", F.inline("_bars")).where("close is not null").select(*KEY, "ts", *PRICES, "volume")


def rolled(daily: DataFrame, frame: str) -> DataFrame:
    """Daily bars as bars of a week (from Monday) or a month, dated by its first day: the first open and last close that are known, the
    extremes and the sum. Bars of which a price stays unknown are left out."""
    if frame == "day":
        return daily
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("ts"))
    out = daily.groupBy("symbol", bucket(F.col("ts"), frame).alias("_bar")).agg(
        F.min_by("open", at("open")).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at("close")).alias("close"), F.coalesce(F.sum("volume"), F.lit(0.0)).alias("volume")
    )
    return out.withColumnRenamed("_bar", "ts").dropna(subset=list(PRICES))


def extended(primary: DataFrame, daily: DataFrame, frame: str) -> DataFrame:
    """primary, bars of a frame, with what daily bars of another source have before its first bar, rolled up to the frame first.

    The bar at the boundary is primary's, also if primary has only part of that week or month. A symbol that primary has no bar of takes all of
    the other source; a frame finer than a day takes nothing from it. Both have symbol, ts, prices and volume.
    """
    columns = ["symbol", "ts", *PRICES, "volume"]
    primary = primary.select(*columns)
    return prepended(primary, rolled(daily.select(*columns), frame)) if frame in DAILY_FRAMES else primary


class ContractStore:
    """Series at a path, a folder each. A series is replaced as a whole; others are left alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        """All series; none where nothing was saved yet."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def load(self, product: str, session: str = "all", rank: int = 1) -> DataFrame:
        """ts, prices and volume of a series, by ts; empty if it was never saved. Only its folder is read."""
        rows = self.read().where((F.col("product") == product.strip().upper()) & (F.col("session") == session) & (F.col("rank") == rank))
        return rows.select("ts", *PRICES, "volume").orderBy("ts")

    def has(self, product: str, session: str = "all", rank: int = 1) -> bool:
        return not self.load(product, session, rank).isEmpty()

    def save(self, bars: DataFrame) -> None:
        """Replaces the series that occur in bars by their rows there."""
        rows = bars.select(*(F.col(c) for c in ("ts", *PRICES, "volume")), product_name(F.col("product")).alias("product"), "session", F.col("rank").cast("int").alias("rank"))
        rows = rows.repartition(*KEY).sortWithinPartitions(*KEY, "ts")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(self.path)

    def merge(self, bars: DataFrame) -> None:
        """Adds bars to their series; a day that both have is replaced, of a day that repeats in bars the largest row counts.

        Only folders of series that occur in bars are read and written. The result is staged beside the store first, as Spark cannot overwrite
        what it reads, and a crash before the last write leaves the store as it was.
        """
        new = bars.select(product_name(F.col("product")).alias("product"), "session", F.col("rank").cast("int").alias("rank"), "ts", *PRICES, "volume")
        old = self.read().join(new.select(*KEY).distinct(), list(KEY), "left_semi").select(new.columns)
        both = old.withColumn("_load", F.lit(0)).union(new.withColumn("_load", F.lit(1)))
        order = F.struct("_load", *PRICES, "volume")
        w = Window.partitionBy(*KEY, "ts").orderBy(order.desc())
        merged = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(new.columns)
        staging = f"{self.path}__staging/{uuid.uuid4().hex}"
        try:
            merged.write.parquet(staging)
            self.save(self.spark.read.schema(merged.schema).parquet(staging))
        finally:
            removed(self.spark, staging)
