"""Files and packages: reading, size limits, unpacking of ZIP packages."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.strings import detect_format, file_extension, is_zip, natural_key

# fixed values: bytes that a file of a kind may have
LIMITS = {"pptx": 500 << 20, "psd": 500 << 20, "ai": 1536 << 20, "zip": 1536 << 20}
SUPPORTED = ("pptx", "psd", "ai", "svg", "pdf")
#: Inflated bytes beyond which a package is refused, so that a small hostile file can't fill memory.
MOST_INFLATED = 4 << 30


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (path), name, size, content of the files under a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content")


def oversized(files: DataFrame) -> DataFrame:  # S18
    """The files over the limit of their kind; a batch with one is refused as a whole."""
    kind = F.when(is_zip(F.col("name")), "zip").otherwise(detect_format(F.col("name")))
    limit = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])
    return files.withColumn("limit", F.try_element_at(limit, kind)).filter("size > limit")


def _zip_entries(content: bytes, keep):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        total = 0
        for info in z.infolist():
            if info.is_dir() or not keep(info.filename):
                continue
            total += info.file_size
            if total > MOST_INFLATED:
                raise ValueError("package inflates beyond the limit")
            yield info.filename, z.read(info)


def unpack(files: DataFrame, pattern: str = "") -> DataFrame:  # S1, S15
    """doc_id, part, content of the entries of ZIP packages; unreadable packages give a row with part null."""
    import re

    def run(batches):
        keep = re.compile(pattern, re.I).search
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = list(_zip_entries(content.as_py(), keep))
                except zipfile.BadZipFile:
                    rows = [(None, None)]
                for part, data in rows:
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.string()), "part": pa.array([part], pa.string()), "content": pa.array([data], pa.binary())})

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, part string, content binary")


def entries(files: DataFrame) -> DataFrame:  # S15
    """Files with ZIP archives replaced by their supported entries, in any order; _key: an entry's natural order."""
    plain = files.filter(~is_zip(F.col("name"))).select("doc_id", "name", "content", F.lit("").alias("_key"))
    inner = unpack(files.filter(is_zip(F.col("name"))), r"\.(pptx|psd|ai|svg|pdf)$").filter("part is not null")
    inner = inner.select(F.concat("doc_id", F.lit("!"), "part").alias("doc_id"), F.element_at(F.split("part", "/"), -1).alias("name"), "content", natural_key(F.col("part")).alias("_key"))
    return plain.unionByName(inner).filter(file_extension(F.col("name")).isin(*SUPPORTED)).withColumn("format", detect_format(F.col("name")))


def expand(files: DataFrame) -> DataFrame:  # S15, O2
    """Files with ZIP archives replaced by their supported entries in natural order; ord numbers a selection's files."""
    return entries(files).orderBy(F.element_at(F.split("doc_id", "!"), 1), "_key").drop("_key")
