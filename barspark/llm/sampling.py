"""Bounded samples of rows for fitting models, and the folds that queries fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.storage import attached, discard, saved


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as an empty text, whose fold is 0."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n


def lowest(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The n rows of each value of a column that have the lowest order: Spark keeps n rows a task and value before it shuffles."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_rank", first).where(F.col("_rank") <= n).drop("_rank")


def within_bytes(rows: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """Of a bounded table of rows those of each value whose predecessors in order have less than most bytes; the first of a value always stays."""
    before = F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < most).drop("_before")


def hash_sample(rows: DataFrame, by: str, per_value: int, most_rows: int, most_bytes: int) -> DataFrame:
    """At most per_value rows (doc_id, text and by) for each value of a column: those whose doc_id and text have the lowest hashes.

    Reruns agree. Rows that repeat in doc_id and text count once, however often they do, so every value is in the sample, and one of at most per_value
    distinct rows wholly. Where there are very many values, fewer rows of each are taken, one at least, to have about most_rows in all. Texts of a value
    stop once they have most_bytes; its first text is always taken.
    """
    hashed = rows.select("doc_id", "text", by, F.xxhash64("doc_id", "text", F.lit(5)).alias("_draw"))
    distinct = hashed.select(by, "_draw", F.octet_length("text").alias("_size")).distinct()
    values = saved(lowest(distinct, by, "_draw", per_value), "sample-hashes")
    n_values = values.select(by).distinct().count()
    chosen = lowest(values, by, "_draw", max(1, min(per_value, most_rows // max(1, n_values))))
    chosen = saved(within_bytes(chosen, by, "_draw", "_size", most_bytes).select(by, "_draw"), "sample-chosen")
    discard(values)
    return attached(hashed, chosen, [by, "_draw"]).dropDuplicates([by, "_draw"]).drop("_draw")
