"""Dated rows stored by month or year: institutional flow of shares by month, that of futures by year. A range reads its own periods only."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from barspark.sources.scratch import removed

#: Periods and the pattern of their number.
PERIODS = {"month": "yyyyMM", "year": "yyyy"}


class PeriodStore:
    """Rows of a schema with a date `ts` at a path, a folder a period. key are the columns that, with ts, name a row."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: Sequence[str], by: str = "month"):
        self.spark, self.path, self.key, self.pattern = spark, path.rstrip("/"), tuple(key), PERIODS[by]
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def _number(self, ts: Column) -> Column:
        return F.date_format(ts, self.pattern).cast("int")

    def _read(self) -> DataFrame:
        try:
            return self.spark.read.schema(StructType([*self.schema.fields]).add("_period", IntegerType())).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema).withColumn("_period", F.lit(0))

    def range(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows with ts in [start, end], both inclusive; a bound may be missing. An end before the start, or a store without rows, gives none."""
        rows = self._read()
        for bound, test in ((start, "__ge__"), (end, "__le__")):
            if bound is not None:
                day = F.lit(bound).cast("date")
                rows = rows.where(getattr(F.col("_period"), test)(self._number(day)) & getattr(F.col("ts"), test)(day))
        return rows.select(*(F.col(f"`{c}`") for c in self.schema.names))

    def days(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """The days of a range that the store has rows of: what a download need not fetch again."""
        return self.range(start, end).select("ts").distinct()

    def save(self, rows: DataFrame) -> None:
        """Adds rows; of rows that share ts and key, new ones replace old, and among new ones the largest stays. Rows without ts are left out.

        Only periods that occur in rows are read and written, each by tasks of its own. They are staged beside the store first, as Spark cannot
        overwrite what it reads; a crash before the last write leaves the store as it was. One writer a period at a time.
        """
        names = self.schema.names
        new = rows.where("ts is not null").select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("_period", self._number(F.col("ts")))
        quoted = [f"`{c}`" for c in new.columns]
        old = self._read().join(new.select("_period").distinct(), "_period", "left_semi").select(*quoted)
        both = old.withColumn("_load", F.lit(0)).union(new.withColumn("_load", F.lit(1)))
        rest = [f"`{c}`" for c in names if c not in ("ts", *self.key)]
        w = Window.partitionBy("_period", "ts", *(f"`{k}`" for k in self.key)).orderBy(F.struct("_load", *rest).desc())
        merged = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*quoted)
        staging = f"{self.path}__staging/{uuid.uuid4().hex}"
        try:
            merged.write.parquet(staging)
            staged = self.spark.read.schema(merged.schema).parquet(staging)
            # A period's rows are split over days, so that one large period is many tasks and files.
            dealt = staged.repartition("_period", F.pmod(F.xxhash64("ts"), F.lit(8))).sortWithinPartitions("_period", "ts", *(f"`{k}`" for k in self.key))
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_period").parquet(self.path)
        finally:
            removed(self.spark, staging)
