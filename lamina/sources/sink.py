"""Sinks: the view with defaults applied, and staged writes that are taken back on failure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.geometry import clamp
from lamina.functions.strings import sink_blend

# fixed values: how node types are called in the sink
KINDS = {"frame": "FRAME", "group": "GROUP", "booleanGroup": "BOOLEAN_OPERATION", "text": "TEXT", "rectangle": "RECTANGLE", "ellipse": "ELLIPSE", "polygon": "POLYGON", "line": "LINE", "vector": "VECTOR", "svg": "FRAME", "image": "RECTANGLE"}


def sink_view(nodes: DataFrame) -> DataFrame:  # K2, K4, K6
    """Nodes as the sink takes them: null properties get their defaults here and not before. Missing columns count as null."""
    have = set(nodes.columns)
    col = lambda n, t: F.col(n) if n in have else F.lit(None).cast(t)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("type")), F.lit("RECTANGLE"))
    blend = F.when(col("blend_mode", "string").isNull() & (kind == "GROUP"), "PASS_THROUGH").otherwise(sink_blend(col("blend_mode", "string")))
    return nodes.withColumns({
        "type": kind,
        "opacity": clamp(F.coalesce(col("opacity", "double"), F.lit(1.0))),
        "visible": F.coalesce(col("visible", "boolean"), F.lit(True)),
        "locked": F.coalesce(col("locked", "boolean"), F.lit(False)),
        "rotation": F.coalesce(col("rotation", "double"), F.lit(0.0)),
        "blend_mode": blend,
        "point_count": F.when(kind == "POLYGON", F.coalesce(col("point_count", "int"), F.lit(3))),
        "winding": F.when(kind == "VECTOR", F.when(col("winding", "string") == "evenodd", "EVENODD").otherwise("NONZERO")),  # K5
    })


def with_images(nodes: DataFrame, assets: DataFrame) -> DataFrame:  # J7
    """Nodes with `image`, the asset's media type and data; a node whose asset is missing stays, without a paint. assets: doc_id, asset_id, mime, data."""
    a = assets.select("doc_id", F.col("asset_id").alias("asset_ref"), F.struct("mime", "data").alias("image")).dropDuplicates(["doc_id", "asset_ref"])
    return nodes.join(a, ["doc_id", "asset_ref"], "left").select(*nodes.columns, "image")


def clamped_runs(runs: DataFrame, texts: DataFrame, keys=("doc_id", "node_id")) -> DataFrame:  # K3
    """Text runs cut to their text; runs that are empty then go. texts: keys, length."""
    rows = runs.join(texts, list(keys)).withColumns({"run_start": F.greatest(F.lit(0), F.least("run_start", "length")), "run_end": F.greatest(F.lit(0), F.least("run_end", "length"))})
    return rows.filter("run_end > run_start").drop("length")


def placed_pages(pages: DataFrame, gap: float = 120.0) -> DataFrame:  # K1, K8, W1
    """Pages of a document side by side, with their number from 1."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumns({"x": F.coalesce(F.sum(F.col("width") + gap).over(before), F.lit(0.0)), "page_no": F.row_number().over(w)})


def render(nodes: DataFrame, path: str, check=None) -> DataFrame:  # K1, U4
    """Writes the sink view to a staging folder and moves it into place only when all of it, and the check, went well.

    Returns one row: nodes, pages. Fails on a group without children, and leaves nothing behind then.
    """
    spark = nodes.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stage = jvm.org.apache.hadoop.fs.Path(f"{path}.staging-{uuid.uuid4().hex}")
    try:
        view = sink_view(nodes)
        parents = nodes.filter("parent_id is not null").select("doc_id", F.col("parent_id").alias("node_id")).distinct()
        if not nodes.filter("type = 'group'").join(parents, ["doc_id", "node_id"], "left_anti").isEmpty():
            raise ValueError("a group without children can't be rendered")
        view.write.parquet(stage.toString())
        if check is not None:
            check(spark.read.parquet(stage.toString()))
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(stage, target):
            raise OSError(f"can't move the staged output to {path}")
    except BaseException:
        fs.delete(stage, True)
        raise
    return spark.read.parquet(path).agg(F.count("*").alias("nodes"), F.count_if(F.col("parent_id").isNull()).alias("pages"))
