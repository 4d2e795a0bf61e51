"""Binary files in the shared folder, written by tasks and read back by Spark.

Where the folder is a mounted file system, tasks write real files (to a temporary name, then renamed,
so that a repeated task only replaces a file by an equal one). In any other store, Spark's own
writer keeps the same bytes in a binary column. Both give rows (name, content) when read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm._common import local_path, new_path, small_batches

#: A task cuts its output into files of about this size.
FILE_BYTES = 8 << 20


def put_file(folder: str, name: str, content: bytes) -> None:
    tmp = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(tmp, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, os.path.join(folder, name))


def write_blobs(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[bytes, int, int]]], tag: str, suffix: str) -> str:
    """Run `make` on each partition and store the contents it yields; returns the folder.

    `make` yields (content, first id in it, count of what it holds).
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, tag)
    folder = local_path(path)
    if folder:
        os.makedirs(f"{folder}/files", exist_ok=True)

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, (content, first, count) in enumerate(make(batches)):
            name = f"{part:06d}-{k:06d}{suffix}"
            if folder:
                put_file(f"{folder}/files", name, content)
            yield pa.RecordBatch.from_pydict({"name": [name], "first": pa.array([first], pa.int64()), "count": pa.array([count], pa.int64()), "bytes": pa.array([len(content)], pa.int64()), "content": pa.array([None if folder else content], pa.binary())})

    df.mapInArrow(run, "name string, first long, count long, bytes long, content binary").write.parquet(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, first, count, bytes of each file."""
    return spark.read.parquet(f"{path}/manifest").select("name", "first", "count", "bytes")


def read_blobs(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """name, content of each file."""
    if local_path(path):
        # an input without rows leaves no file
        schema = "path string, modificationTime timestamp, length long, content binary"
        if not any(x.endswith(suffix) and not x.startswith(".") for x in os.listdir(f"{local_path(path)}/files")):
            return spark.createDataFrame([], "name string, content binary")
        files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", f"[0-9]*{suffix}").load(f"{path}/files")
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return spark.read.parquet(f"{path}/manifest").select("name", "content")
