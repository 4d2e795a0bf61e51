"""What the operators of this package share: the shared folder, written tables, byte-bounded chunks."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word is a run of bytes other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def stable_hash(salt: str, *keys: str) -> Column:
    """60 bits of the md5 of some columns as text, which any system can repeat; nulls are a key of their own."""
    text = F.concat_ws("/", F.lit(salt), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where that is unset and the session is local."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    at = f"file://{tempfile.mkdtemp(prefix='lamina-shared-')}"
    atexit.register(shutil.rmtree, at[7:], ignore_errors=True)
    spark.sparkContext.setCheckpointDir(at)
    spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Bytes of one batch that goes to a Python worker, about; Spark's own bound is 64 MB, of which a task holds several copies.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of Python workers by bytes, unless the session has set a smaller bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", spark.conf.get(key))
    if not now or int(now[0]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lamina/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, options: dict | None = None) -> DataFrame:
    """The same rows, reread from Parquet in the shared folder: cuts lineage and survives lost executors."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, tag)
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.lamina_path = path
    return out


def released(df: DataFrame, tag: str) -> DataFrame:
    """As `written`; then asks the driver to drop what its finished jobs left in shuffle folders."""
    out = written(df, tag)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, when nothing that is still to run reads them."""
    for t in tables:
        spark = t.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.lamina_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_path(path: str) -> str | None:
    """The path for open() where the folder is a mounted file system, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else os.path.abspath(path)


def by_size(texts: Sequence[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` characters together; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
