"""One entry from files to nodes: each file goes to the importer of its kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.strings import detect_format, sniff_format
from lamina.session import cut
from lamina.sources import packages, page_logs, pptx, psd, svg

ITEM = ("doc_id", "level", "code", "message", "node_name")


@dataclass(frozen=True)
class Imported:
    """nodes, assets and report items of all files; undecoded: doc_id, kind of files whose decoded rows were not given."""

    nodes: DataFrame
    assets: DataFrame
    report: DataFrame
    undecoded: DataFrame


def kinds(files: DataFrame) -> DataFrame:  # S3, S16
    """files with kind: pptx, psd, svg or pdf. A file of vector artwork that begins as neither svg nor pdf is an error; files of other names go."""
    ext = detect_format(F.col("name"))
    head = sniff_format(F.col("content"))
    bad = F.raise_error(F.concat(F.lit("neither vector markup nor pages: "), F.col("name"))).cast("string")
    return files.filter(ext.isNotNull()).withColumn("kind", F.when(ext != "ai", ext).when(head.isNotNull(), head).otherwise(bad))


def _aligned(nodes: DataFrame) -> DataFrame:
    types = {"node_id": "string", "parent_id": "string", "ord": "long", "x": "double", "y": "double", "width": "double", "height": "double", "opacity": "double"}
    return nodes.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in nodes.columns})


def import_files(files: DataFrame, layers: DataFrame | None = None, pages: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> Imported:  # S19, S9
    """Files (doc_id, name, size, content) as nodes. ZIP archives are expanded; a file over its kind's limit is an error.

    layers and pages are the decoded rows of image documents and of pages (see `psd` and `page_logs`), by doc_id;
    pages without layers become tiles with asset_ref null.
    """
    # the batch is refused before anything is read, so this check runs at once
    if over := packages.oversized(files).agg(F.min("name").alias("name")).first().name:
        raise ValueError(f"over the size limit: {over}")
    # written once: archives are unpacked and markup is read by one pass, and the importers' plans stay apart;
    # unsorted, as a sort by ranges would unpack all archives a second time for its sample; spread, as many small files
    # of one archive or split would be one task for every importer
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = cut(kinds(packages.entries(files).drop("_key")).repartition(n, "doc_id"))
    of = lambda kind: routed.filter(F.col("kind") == kind).select("doc_id", "content")

    # each importer reads its files once and writes what it finds; nodes and items are rows of those tables
    slides, slide_assets, slide_report = pptx.import_packages(of("pptx"))
    elems = svg.load(of("svg"), matrices=True)
    complex_ = cut(svg.needs_hierarchy(elems).filter("complex").select("doc_id"))
    plain, plain_assets, plain_report = svg.plain_nodes(elems.join(complex_, "doc_id", "left_anti"))
    tree, _, tree_report = svg.hierarchy(of("svg").join(complex_, "doc_id", "left_semi"), elems.join(complex_, "doc_id", "left_semi"))
    nodes, reports = [(slides, "pptx"), (plain, "svg"), (cut(tree), "svg")], [slide_report, plain_report, tree_report]
    undecoded = []
    if layers is None:
        undecoded.append(of("psd").select("doc_id", F.lit("psd").alias("kind")))
    else:
        mine = layers.join(of("psd").select("doc_id"), "doc_id", "left_semi")
        n, r = psd.import_layers(mine)
        nodes.append((n, "psd"))
        reports.append(r)
        undecoded.append(of("psd").select("doc_id", F.lit("psd").alias("kind")).join(layers.select("doc_id"), "doc_id", "left_anti"))
    if pages is None:
        undecoded.append(of("pdf").select("doc_id", F.lit("pdf").alias("kind")))
    else:
        read = page_logs.read_pages(*pages, of("pdf"))
        n, r = page_logs.layered_pages(read)
        tiles, fallback = page_logs.flat_pages(read)
        images = tiles.select("doc_id", F.concat_ws("/", "doc_id", F.col("tile").cast("string")).alias("node_id"), F.col("doc_id").alias("parent_id"), F.col("tile").alias("ord"), F.lit("image").alias("type"), F.concat(F.lit("Tile "), (F.col("tile") + 1).cast("string")).alias("name"), "x", "y", "width", "height")
        nodes += [(n, "pdf"), (images, "pdf")]
        reports += [r, fallback]
        undecoded.append(read.filter("row = 'none'").select("doc_id", F.lit("pdf").alias("kind")))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    found = union([_aligned(n).withColumn("kind", F.lit(kind)) for n, kind in nodes])
    return Imported(found, union([slide_assets, plain_assets]), union([r.select(*ITEM) for r in reports]), union(undecoded))
