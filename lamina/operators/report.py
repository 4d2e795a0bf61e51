"""Reports: roll-ups of counters and items, merging of documents, set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: report codes and their levels
CODES = {
    "PPTX_IMPORT": "info", "PSD_IMPORT": "info", "PSD_PIXEL_MASK_NATIVE": "info", "PSD_VECTOR_MASK_NATIVE": "info",
    "PSD_EMPTY_LAYER": "warning", "PSD_RASTER_LAYER": "fallback", "PSD_ADJUSTMENT_NON_IMAGE_TARGET": "warning",
    "PSD_ADJUSTMENT_NATIVE": "info", "PSD_ADJUSTMENT_PARTIAL": "fallback", "PSD_MASKED_ADJUSTMENT_NATIVE": "info",
    "PSD_MASKED_ADJUSTMENT_EMPTY": "warning", "PSD_LAYER_SKIPPED": "warning", "SVG_EMPTY_GROUP_OMITTED": "warning",
    "SVG_HIERARCHY_IMPORT": "info", "SVG_VECTOR_IMPORT": "info", "SVG_EXTERNAL_IMAGE": "warning",
    "SVG_UNSUPPORTED_ELEMENT": "warning", "SVG_INVALID_NULL_REMOVED": "warning", "PDF_SOFT_MASK_EFFECT_PRESERVED": "fallback",
    "PDF_IMAGE_COMPOSITING_PRESERVED": "info", "AI_PDF_FALLBACK": "fallback", "AI_PDF_VECTOR_LAYER_FAILED": "warning",
    "AI_EMPTY_LAYER_PRESERVED": "info", "AI_PDF_HIERARCHY_IMPORT": "info",
}
COUNTERS = ("parsed", "editable", "rasterized", "skipped")
# fixed values: the options that an import has without others
DEFAULT_OPTIONS = {"text_mode": "editable", "unsupported": "rasterize"}  # P38


def empty_report(files: DataFrame) -> DataFrame:  # P38
    """The report that each file (doc_id, format, name) starts with: counters at 0, no missing fonts, no items."""
    return files.select("doc_id", "format", "name", *[F.lit(0).cast("long").alias(c) for c in COUNTERS], F.array().cast("array<string>").alias("missing_fonts"), F.lit(0).cast("long").alias("items"))


def item(code: str, message: Column, node: Column | None = None, page: Column | None = None) -> Column:
    """A report item of a known code."""
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(F.lit(CODES[code]).alias("level"), F.lit(code).alias("code"), message.alias("message"), text(node).alias("node_name"), text(page).alias("page_name"))


def rollup(items: DataFrame, keys: Sequence[str]) -> DataFrame:  # G13, G16
    """Counts of items by level, and of those that a reader should look at."""
    n = lambda *levels: F.count_if(F.col("level").isin(*levels))
    return items.groupBy(*keys).agg(F.count("*").alias("items"), n("info").alias("infos"), n("warning").alias("warnings"), n("fallback").alias("fallbacks"), n("warning", "fallback").alias("attention"))


def merge_documents(docs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:  # G3, P28, U1, U2
    """One document from many: counters and bytes added, missing fonts united, format and version of the first."""
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    return docs.groupBy(*keys).agg(F.min_by("format", order).alias("format"), F.min_by("version", order).alias("version"), F.count("*").alias("documents"), F.sum("byte_size").alias("byte_size"), *sums, F.array_sort(F.array_distinct(F.flatten(F.collect_list("missing_fonts")))).alias("missing_fonts"))


def page_name(name: Column, source: Column) -> Column:  # P28
    return F.coalesce(name, source)


def added(after: DataFrame, before: DataFrame, key: str) -> DataFrame:  # J20, U4
    """What is new since `before`: the rows to take back when a render fails."""
    return after.join(before.select(key), key, "left_anti")
