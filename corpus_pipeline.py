"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

quality classifier -> MinHash near-dedup -> suffix-array dedup -> mixing -> byte-level BPE. All but
the last stage return the columns they were given; a document's text changes only where the
suffix-array stage cuts passages that also start earlier. The mix repeats documents of sources
whose target lies above their size (each copy is a row), drops those that the target leaves out, and
leaves its rows range-sorted by training position, each file of its output one run of positions.

Edge cases: a null or empty text gets the score of a text without lines, is near nothing, loses
nothing, is taken once and has no ids; a null doc_id is no near copy and stands first in the dedup of
passages; very long texts go whole through every stage; rows that repeat a doc_id and a set of shingles
become one, rows that share only a doc_id are documents of their own; ties go to the smallest doc_id, and
then to the least hash of a text; an empty table gives an empty result; other columns are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import byte_bpe, crf_quality, minhash_dedup, mixing, suffix_dedup
from lamina.llm._common import written
from lamina.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at 0.7 or more; the rest go."""
    return crf_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: five-word shingles, similarity 0.8."""
    return minhash_dedup.keep_one(docs, words=5, percent=80)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier; no document goes."""
    return suffix_dedup.dedup_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target takes, in training order; documents without words stay once, last."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row."""
    return byte_bpe.encode_documents(docs)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", passage_dedup), ("mixing to target weights", mix), ("byte-level BPE", encode)]
#: SQL can't express the classifier and the encoding; tests/llm compares all rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
