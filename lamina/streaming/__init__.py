"""Structured Streaming forms of batch operators (an extension; nothing here is needed by the batch queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def drop_folder(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def report_windows(items: DataFrame, at: str, keys: list[str], late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Report items counted by level in windows of time; rows later than the watermark are dropped."""
    n = lambda level: F.count_if(F.col("level") == level)
    w = items.withWatermark(at, late).groupBy(F.window(at, width), *keys)
    return w.agg(F.count("*").alias("items"), n("info").alias("infos"), n("warning").alias("warnings"), n("fallback").alias("fallbacks"))


def latest_answers(answers: DataFrame, key: str, version: str, fields: list[str]) -> DataFrame:
    """The newest answer of each key so far (update mode): an answer to an older request is stale and changes nothing."""
    return answers.groupBy(key).agg(F.max_by(F.struct(version, *fields), version).alias("a")).select(key, "a.*")
