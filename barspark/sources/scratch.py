"""Tables that a query writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A table of at most so many bytes, as its rows are in memory, is broadcast; a larger one is joined by shuffles.
MOST_BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one in the warehouse, if executors see that as well."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master) and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse + "/barspark-tables"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, so that what several parts of a query read is computed once and survives a lost executor."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder with all that is in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _value_bytes(at: Column, kind: DataType) -> Column | int:
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(at), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType):
            each = F.aggregate(at, F.lit(0).cast("long"), lambda n, x: n + _value_bytes(x, kind.elementType))
            return F.coalesce(each, F.lit(0)) + 16
        return F.coalesce(F.greatest(F.size(at), F.lit(0)), F.lit(0)) * 16 + 16
    if isinstance(kind, StructType):
        return sum((_value_bytes(at[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(16)


def row_bytes(schema: StructType) -> Column:
    """About how many bytes a row takes in memory: 16 a value, and the content of texts, binaries and arrays."""
    return sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(0)).cast("long")


def attached(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a saved table that has one row a key.

    Up to MOST_BROADCAST_BYTES, summed over its rows first, it is broadcast, so that a hot key moves no rows; beyond that the join shuffles, and
    Spark's adaptive execution splits what is skewed.
    """
    taken = table.agg(F.sum(row_bytes(table.schema))).first()[0] or 0
    return rows.join(F.broadcast(table) if taken <= MOST_BROADCAST_BYTES else table, on, how)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a path in the shared folder, as Python in a task sees them."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    """Writes a file of the shared folder, from any task. It appears whole or not at all, so a task that runs twice does no harm."""
    system, at = place(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}-{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as f:
        f.write(data)
    system.move(own, at)


def view(path: str) -> pa.Buffer:
    """The bytes of a file of the shared folder: mapped, where that is a mounted file system, so that all workers of a machine share them."""
    system, at = place(path)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(at) as f:
            return f.read_buffer()
    with system.open_input_file(at) as f:
        return f.read_buffer()
