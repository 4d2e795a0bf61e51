"""What both vector searches share: usable vectors, shards with an index each, query blocks, and the merge.

Rows are dealt to shards by a hash of vec_id and of the vector, so equal vectors and equal ids spread;
of equal rows as many go on as an answer can hold.
Each shard's index is built once and written to the shared folder; then every block of queries meets
every index. A shard holds a bounded number of vectors and a block a bounded number of queries.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm._common import written

SHARD_ROWS, BLOCK_QUERIES = 20_000, 50_000


def finite(v: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite."""
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """A list column of vectors of one size as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def indexed(rows: DataFrame, build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], tag: str) -> DataFrame:
    """dim, shard, index: what build(vectors, vec_ids) makes of each shard, written once. rows: vec_id, v."""
    shards = max(16, -(-rows.count() // SHARD_ROWS))

    def run(table: pa.Table) -> pa.Table:
        index = packed(build(matrix(table["v"]), table["vec_id"].to_numpy()))
        return pa.table({"dim": table["dim"].slice(0, 1), "shard": table["shard"].slice(0, 1), "index": pa.array([index], pa.binary())})

    dealt = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"))
    out = written(dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard long, index binary"), tag, {"maxRecordsPerFile": 1})
    out.lamina_shards = shards
    return out


def searched(index: DataFrame, queries: DataFrame, search: Callable[[dict[str, np.ndarray], pa.Table], pa.Table], schema: str) -> DataFrame:
    """search(a shard's index, a block of queries) for each shard and block. queries: vec_id, v and more."""
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select("*", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(blocks)).cast("int").alias("block"))
    right = right.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(index.lamina_shards - 1)).cast("array<long>")))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search(unpacked(a["index"][0].as_buffer()), b) if len(a) and len(b) else pa.Table.from_batches([], schema=_arrow(schema))

    keys = ["dim", "shard", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def usable_rows(rows: DataFrame, k: int, tag: str) -> DataFrame:
    """The rows (vec_id, v), written; of equal ones k at most, as no answer holds more."""
    counted = rows.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    return written(counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k))))).select("vec_id", "v"), tag)


def one_each(queries: DataFrame) -> DataFrame:
    """One query for each vec_id: of rows that share it, the least vector."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all shards: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
