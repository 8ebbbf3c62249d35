"""The difference of two tables: checksums of buckets first, rows only where checksums differ.

Both tables are cut into buckets by a hash of their key, and each bucket gets a count and, for each group of columns, checksums that do not
hang on the order of rows. Those few numbers are compared; only rows of buckets that differ are shuffled and compared value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Decimal places that numbers with a fraction are compared at.
PLACES = 8


def canonical(df: DataFrame, column: str) -> Column:
    """The value as a text that equal values share: fractions rounded, NaN and infinities by name, null as null, nested values as JSON."""
    kind, at = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, DoubleType | FloatType):
        x = at.cast("double")
        named = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity")
        # Minus zero is zero.
        return F.coalesce(named, (F.round(x, PLACES) + 0.0).cast("string"))
    if kind.typeName() in ("array", "struct", "map"):
        return F.to_json(F.struct(at.alias("v")))
    return at.cast("string")


def checksums(df: DataFrame, key: Sequence[str], groups: dict[str, Sequence[str]], buckets: int) -> DataFrame:
    """bucket, rows, and for each group of columns two sums of row hashes, from which no row can be missing twice."""
    hashed = df.select(_bucket(df, key, buckets).alias("bucket"), *(F.xxhash64(*(canonical(df, c) for c in (*key, *columns))).alias(name) for name, columns in groups.items()))
    # Halves of 32 bits, so that sums of billions stay longs.
    halves = [F.struct(F.sum(F.shiftright(n, 32)).alias("high"), F.sum(F.col(n).bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")).alias(n) for n in groups]
    return hashed.groupBy("bucket").agg(F.count("*").alias("rows"), *halves)


def _bucket(df: DataFrame, key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(canonical(df, c) for c in key)), F.lit(buckets)).cast("int")


def differing_buckets(expected: DataFrame, actual: DataFrame, key: Sequence[str], groups: dict[str, Sequence[str]], buckets: int) -> DataFrame:
    """bucket and the names of the groups in which it differs; a bucket whose counts differ, or that one side lacks, differs in all."""
    a, b = (checksums(df, key, groups, buckets).alias(n) for df, n in ((expected, "a"), (actual, "b")))
    joined = a.join(b, "bucket", "full")
    counted = F.coalesce(F.col("a.rows") == F.col("b.rows"), F.lit(False))
    wrong = F.array_compact(F.array(*(F.when(~counted | ~F.coalesce(F.col(f"a.{n}") == F.col(f"b.{n}"), F.lit(False)), n) for n in groups)))
    return joined.select("bucket", wrong.alias("groups")).where(F.size("groups") > 0)


def differences(expected: DataFrame, actual: DataFrame, key: Sequence[str], groups: dict[str, Sequence[str]] | None = None, most: int = 50, buckets: int = 4096) -> DataFrame:
    """key, column, kind (missing, unexpected or changed), expected, actual: the first `most` differences by key and column; none if the tables agree.

    key names the columns that tell rows apart; rows that share a key are compared in the order of their values. groups are sets of other columns that
    have checksums of their own, by default each column by itself; only columns of groups are compared, and those that one side lacks are reported once, with an
    empty key. A missing or unexpected row is one difference, without column. Two empty tables agree. Values are shown as texts.
    """
    shared = [c for c in expected.columns if c in actual.columns]
    others = [c for c in shared if c not in key]
    groups = {n: [c for c in cs if c in others] for n, cs in (groups or {c: [c] for c in others}).items()}
    groups = {f"g{k}": cs for k, cs in enumerate(groups.values())} or {"g0": []}
    wrong = differing_buckets(expected, actual, key, groups, buckets)
    columns = [c for cs in groups.values() for c in cs]

    def rows(df: DataFrame) -> DataFrame:
        # At most `buckets` rows are broadcast; nothing of a bucket that agrees goes on.
        kept = df.withColumn("bucket", _bucket(df, key, buckets)).join(F.broadcast(wrong.select("bucket")), "bucket", "left_semi")
        values = kept.select(F.to_json(F.array(*(canonical(df, c) for c in key)), {"ignoreNullFields": "false"}).alias("key"), F.array(*(canonical(df, c) for c in columns)).cast("array<string>").alias("values"))
        return values.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("values")))

    a, b = rows(expected).alias("a"), rows(actual).alias("b")
    joined = a.join(b, ["key", "n"], "full")
    one = lambda kind, column, x, y: F.struct(column.alias("column"), F.lit(kind).alias("kind"), x.alias("expected"), y.alias("actual"))
    none = F.lit(None).cast("string")
    by_column = F.array(*(F.when(~F.col("a.values")[k].eqNullSafe(F.col("b.values")[k]), one("changed", F.lit(c), F.col("a.values")[k], F.col("b.values")[k])) for k, c in enumerate(columns)))
    whole = F.when(F.col("b.values").isNull(), F.array(one("missing", none, none, none))).when(F.col("a.values").isNull(), F.array(one("unexpected", none, none, none)))
    found = joined.select("key", "n", F.explode(F.coalesce(whole, F.array_compact(by_column)) if columns else whole).alias("d")).select("key", "n", "d.*")
    alone = [(c, "missing") for c in expected.columns if c not in actual.columns] + [(c, "unexpected") for c in actual.columns if c not in expected.columns]
    if alone:
        extra = expected.sparkSession.createDataFrame(alone, "column string, kind string")
        found = found.unionByName(extra.select(F.lit("[]").alias("key"), F.lit(1).alias("n"), "column", "kind", none.alias("expected"), none.alias("actual")))
    return found.orderBy("key", "n", F.col("column").asc_nulls_first()).limit(most).select("key", "column", "kind", "expected", "actual")
