"""Sharding by jump consistent hashing.

A key's shard follows from the key and the number of shards alone, without a ring table; when a
shard is appended, a key stays or moves into the new shard (a fraction 1/(n+1) of them moves).

Edge cases: a null key hashes as one fixed key; equal keys share a shard; null or empty text has size 1,
and a very long one its whole length; rows that share a doc_id are numbered by size and crc32, and rows
that are equal in all three get consecutive slots, which are interchangeable; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm._common import stable_hash, written

#: Rows that one numbering task gets on average.
SLOT_ROWS = 50_000


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in [0, buckets) of each 64-bit key; all keys jump together until each has passed the end."""
    key = keys.astype(np.uint64, copy=True)
    bucket = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    while len(todo):
        bucket[todo] = at
        with np.errstate(over="ignore"):
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
        at = ((at + 1) * (2.0**31 / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = at < buckets
        todo, key, at = todo[on], key[on], at[on]
    return bucket


def jump_shard(key: str, buckets: int) -> Column:
    """The shard of a key column of any type; the key is mixed first, so that runs of ids spread."""

    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64).view(np.uint64), buckets).astype(np.int32))

    return shard(stable_hash("jump", key))


def with_slots(df: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """Adds `slot`, which numbers each shard's rows from 0 without gaps. `order` must tell rows apart that aren't equal.

    Equal rows are counted before they travel. The rest is numbered in blocks by a hash, and a block
    starts where the counts of the blocks before it end, so no task holds a whole shard or key.
    """
    rows = written(df.groupBy(*df.columns).agg(F.count("*").alias("_times")), "slot-rows")
    blocks = max(8, -(-rows.count() // (SLOT_ROWS * 8)))
    rows = rows.withColumn("_block", F.pmod(stable_hash("slot", *order), F.lit(blocks)))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "_block").agg(F.sum("_times").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(shard, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_times").over(inside), F.lit(0))).join(starts, [shard, "_block"])
    first = F.col("_start") + F.col("_in")
    return rows.withColumn("slot", F.explode(F.sequence(first, first + F.col("_times") - 1))).select(*df.columns, "slot")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), jump_shard("doc_id", shards).alias("shard"), jump_shard("doc_id", shards + 1).alias("grown_shard"))
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
