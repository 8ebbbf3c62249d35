"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from barspark.sources.scratch import attached, removed, row_bytes, shared_dir
from barspark.sources.scratch import folder as new_path
from barspark.sources.scratch import written as saved

__all__ = ["attached", "discard", "documents", "new_path", "put", "remove", "row_bytes", "saved", "shared_dir", "view"]


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that saved() returned, once nothing reads it any more.

    Space on the driver's and executors' disks that its shuffles held is freed with it, when the JVM next collects garbage;
    it is asked to do so now, as it sees the size of its heap and not that of the disks.
    """
    removed(df.sparkSession, df.saved_at)
    gc.collect()
    df.sparkSession._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a path in the shared folder, as Python in a task sees them."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    """Writes a file of the shared folder, from any task. It appears whole or not at all, so a task that runs twice does no harm."""
    system, at = _place(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}-{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as f:
        f.write(data)
    system.move(own, at)


def view(path: str) -> np.ndarray:
    """The bytes of a file of the shared folder: mapped, where that is a mounted file system, so that all workers of a machine share them."""
    system, at = _place(path)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(at) as f:
            return np.frombuffer(f.read_buffer(), np.uint8)
    with system.open_input_file(at) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


def remove(path: str) -> None:
    system, at = _place(path)
    system.delete_file(at)
