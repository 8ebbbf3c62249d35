"""A bar store on Parquet: range scans, coverage, upserts and the other ways of writing bars.

Files are partitioned by asset_type and timeframe, and sorted by symbol and ts inside, so a range scan prunes directories and row
groups. A table without a log has no MERGE; an upsert rewrites the partitions that new rows touch.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.functions.scalars import timeframe_minutes
from barspark.sources.scratch import removed

KEY = ("symbol", "asset_type", "timeframe", "ts")


def keep_last(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Of rows with equal keys the one that order puts last."""
    w = Window.partitionBy(*key).orderBy(order.desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """old with rows of new in place of those with their key; of equal keys in new its largest row counts. Rows without a close go."""
    new = new.where(F.col("close").isNotNull())
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, F.struct("_load", *(c for c in new.columns if c not in key))).drop("_load")


def replaced(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """old without the rows whose `on` occurs in new, and new: by date, or by date and code."""
    return old.join(new.select(*on).distinct(), list(on), "left_anti").unionByName(new)


def prepended(primary: DataFrame, older: DataFrame, key: str = "symbol") -> DataFrame:
    """primary with the rows of older that come before its first, of each symbol; all of older where primary has none."""
    first = primary.groupBy(key).agg(F.min("ts").alias("_first"))
    earlier = older.join(first, key, "left").where(F.col("_first").isNull() | (F.col("ts") < F.col("_first"))).drop("_first")
    return earlier.unionByName(primary)


def scan(store: DataFrame, symbol=None, start=None, end=None, asset_type: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Rows of the given keys with ts in [start, end]; each bound may be missing. All filters reach the files."""
    for column, value in (("asset_type", asset_type), ("timeframe", timeframe), ("symbol", symbol)):
        if value is not None:
            store = store.where(F.col(column) == value)
    if start is not None:
        store = store.where(F.col("ts") >= F.lit(start).cast(store.schema["ts"].dataType))
    if end is not None:
        store = store.where(F.col("ts") <= F.lit(end).cast(store.schema["ts"].dataType))
    return store


def coverage(store: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return store.groupBy(*by).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("bars"))


def missing_ranges(store: DataFrame, start: str, end: str, by: str = "symbol") -> DataFrame:
    """by, covered_to, need_from: what of [start, end] still has to be loaded; need_from is null if nothing."""
    seen = coverage(store, (by,))
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    need = F.when(F.col("first_ts") > s, s).when(F.col("last_ts") >= e, F.lit(None).cast("date")).otherwise(F.date_add("last_ts", 1))
    return seen.select(by, F.col("last_ts").alias("covered_to"), need.alias("need_from"))


def daily_range(store: DataFrame, start: str, end: str, codes: Sequence[str] | None = None) -> DataFrame:
    """Rows of a market table partitioned by month (ym, YYYYMM) with ts in [start, end], of all codes or of some.

    The months are filtered as partitions, the codes as a list that reaches the files.
    """
    months = F.date_format(F.lit(start).cast("date"), "yyyyMM").cast("int"), F.date_format(F.lit(end).cast("date"), "yyyyMM").cast("int")
    rows = scan(store.where(F.col("ym").between(*months)), start=start, end=end)
    return rows if codes is None else rows.where(F.col("code").isin(list(codes)))


def wanted_days(store: DataFrame, days: DataFrame) -> DataFrame:
    """The days (column ts) that the store has no row of: what a daily download still has to fetch."""
    return days.join(store.select("ts").distinct(), "ts", "left_anti")


def chunks(spark: SparkSession, start: str, end: str, days: int = 28) -> DataFrame:
    """start_date, end_date of consecutive ranges of at most so many days."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    starts = spark.range(1).select(F.explode(F.sequence(s, e, F.expr(f"interval {days} days"))).alias("start_date"))
    return starts.select("start_date", F.least(F.date_add("start_date", days - 1), e).alias("end_date"))


#: Days of a request and of its second try, for frames under a day and for the others.
REQUEST_DAYS = {True: (10, 5), False: (90, 30)}


def chunk_plan(frame: str, days: int) -> tuple[int, int, int] | None:
    """(days a request, days of a second try, requests at most) for a range of so many days; None where one request does.

    A frame that is not known counts as a daily one.
    """
    size, second = REQUEST_DAYS[timeframe_minutes(frame) is not None]
    requests = -(-days // size)
    return (size, second, requests) if requests > 1 else None


def planned(spark: SparkSession, frame: str, start: str, end: str) -> DataFrame:
    """start_date, end_date of the requests that a range of a frame takes, by chunk_plan: one where one does, none for an end before the start."""
    size = REQUEST_DAYS[timeframe_minutes(frame) is not None][0]
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    starts = spark.range(1).select(F.explode(F.sequence(s, F.greatest(s, e), F.expr(f"interval {size} days"))).alias("start_date")).where(F.col("start_date") <= e)
    return starts.select("start_date", F.least(F.date_add("start_date", size - 1), e).alias("end_date"))


class BarStore:
    """The store at a path. Writes replace whole partitions of (asset_type, timeframe), atomically as far as the file system does.

    One writer a partition at a time: of two, the later replaces what the earlier wrote.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All bars; asset_type and timeframe are texts, also where all their values look like numbers."""
        rows = self.spark.read.parquet(self.path)
        return rows.withColumns({c: F.col(c).cast("string") for c in ("asset_type", "timeframe")})

    def create(self, bars: DataFrame) -> None:
        self._write(bars)

    def upsert(self, bars: DataFrame) -> None:
        touched = bars.select("asset_type", "timeframe").distinct()
        old = self.read().join(touched, ["asset_type", "timeframe"], "left_semi")
        # Materialised first, as Spark cannot overwrite what it reads; in a folder of its own, so that writers do not meet there. A crash
        # before the last write leaves the store as it was.
        merged = upserted(old, bars).select(*self.read().columns)
        staging = f"{self.path.rstrip('/')}__staging/{uuid.uuid4().hex}"
        try:
            merged.write.parquet(staging)
            self._write(self.spark.read.schema(merged.schema).parquet(staging))
        finally:
            removed(self.spark, staging)

    def _write(self, bars: DataFrame) -> None:
        rows = bars.repartition("asset_type", "timeframe", F.pmod(F.xxhash64("symbol"), F.lit(32))).sortWithinPartitions("asset_type", "timeframe", "symbol", "ts")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("asset_type", "timeframe").parquet(self.path)
