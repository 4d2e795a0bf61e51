"""Documents from decoded page logs (S7, S8): layers with their vectors and texts, or tiles of a raster."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import defaultdict, namedtuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamina.functions.geometry import tiles
from lamina.functions.strings import locked_layer, pdf_font_family, pdf_font_style
from lamina.operators import pdf, pdf_svg
from lamina.operators.report import item
from lamina.session import cut


def has_layers(ops: DataFrame) -> DataFrame:  # S9
    """doc_id, layered: whether a page has layers; pages without are kept as rasters."""
    return ops.groupBy("doc_id").agg(F.bool_or((F.col("op") == "beginMarkedContentProps") & (F.col("tag") == "OC")).alias("layered"))


LAYERED = "row string, node_id string, parent_id string, ord long, type string, name string, key string, x double, y double, width double, height double, visible boolean, markup string, characters string, family string, size double, align string, page_w double, page_h double, error string"

Row = namedtuple("Row", "idx op tag group_id key args deps page_w page_h name visible kind text x y width height family has_eol")


# as Spark has them: with null the result is null, and NaN is the greatest number
def _le(a: float | None, b: float | None) -> bool | None:
    return None if a is None or b is None else b != b or (a == a and a <= b)


def _and(*v: bool | None) -> bool | None:
    return False if False in v else None if None in v else True


def _or(*v: bool | None) -> bool | None:
    return True if True in v else None if None in v else False


def _sum(*v: float | None) -> float | None:
    return None if None in v else sum(v)


def _apart(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else abs(a - b)


def _rank(v: float) -> tuple:
    return (v != v, 0.0 if v != v else v)


def _most(*v: float | None) -> float | None:
    return max((x for x in v if x is not None), key=_rank, default=None)


def _least(*v: float | None) -> float | None:
    return min((x for x in v if x is not None), key=_rank, default=None)


def _merges(p, c) -> bool:  # as ordered.merges_with_previous
    tall = _most(p.height, c.height)
    near = None if tall is None else tall * 0.35 + 2
    middle = lambda t: None if t.x is None or t.width is None else (t.x * 2 + t.width) / 2
    right = _sum(p.x, p.width)
    aligned = _or(_le(_apart(p.x, c.x), near), _le(_apart(middle(p), middle(c)), near), _le(_apart(right, _sum(c.x, c.width)), near))
    gap = _apart(p.y, c.y)
    below = _and(p.has_eol, aligned, _le(gap, None if tall is None else tall * 2.25))
    return _or(below, _and(_le(gap, 2.0), _le(c.x, _sum(right, tall)))) is True


def _alignment(lines: list[list]) -> str:  # as ordered.alignment
    edges = [(_least(*[t.x for t in n]), _most(*[_sum(t.x, t.width) for t in n])) for n in lines]
    height = _most(*[t.height for n in lines for t in n])
    best = None
    for rank, (name, of) in enumerate((("left", [e[0] for e in edges]), ("center", [None if None in e else (e[0] + e[1]) / 2 for e in edges]), ("right", [e[1] for e in edges]))):
        low, high = _least(*of), _most(*of)
        spread = None if low is None else high - low
        at = ((spread is not None, _rank(spread or 0.0), rank), spread, name)
        best = at if best is None or at[0] < best[0] else best
    fits = len(lines) >= 2 and _le(best[1], _most(6.0, None if height is None else height * 0.35))
    return best[2] if fits else "left"


def _blocks(items: list):
    """(block, characters, x, y, width, height, family, size, alignment) of a layer's texts in order, as `pdf.text_blocks` with a page of height 0."""
    blocks: list[list] = []
    for before, t in zip([None, *items], items, strict=False):
        if before is not None and _merges(before, t):
            blocks[-1].append(t)
        else:
            blocks.append([t])
    for number, block in enumerate(blocks, 1):
        founders: list = []
        lines: list[list] = []
        for t in block:
            k = next((i for i, f in enumerate(founders) if _le(_apart(f, t.y), 2.0)), None)
            if k is None:
                founders.append(t.y)
                lines.append([])
            lines[-1 if k is None else k].append(t)
        text = block[0].text
        for before, t in zip(block, block[1:], strict=False):
            text += ("\n" if _le(_apart(before.y, t.y), 2.0) is False else "") + t.text
        top = lambda t: None if t.y is None or t.height is None else 0.0 - t.y - t.height
        x, y, r, b = _least(*[t.x for t in block]), _least(*[top(t) for t in block]), _most(*[_sum(t.x, t.width) for t in block]), _most(*[_sum(top(t), t.height) for t in block])
        size = block[0].height
        yield number, text, x, y, _most(size, None if r is None or x is None else r - x), _most(size, None if b is None or y is None else b - y), block[0].family, size, _alignment(lines)


def _ranges(ops: list, groups: dict) -> list[tuple]:  # as intervals.layer_ranges
    """(layer_id, name, key of the name, start, end, visible) of a log's layers, in order of start."""
    stack, found = [], []
    for o in ops:
        if o.op in ("beginMarkedContentProps", "beginMarkedContent"):
            layer = o.op == "beginMarkedContentProps" and o.tag == "OC" and o.group_id is not None
            stack.append((o.idx + 1, o.group_id if layer else None, o.key))
        elif o.op == "endMarkedContent" and stack:
            start, layer, key = stack.pop()
            if layer is not None:
                for g in groups.get(layer) or [None]:
                    named = g is not None and g.name is not None
                    found.append((layer, g.name if named else layer, g.key if named else key, start, o.idx, True if g is None or g.visible is None else g.visible))
    hidden = {f[2] for f in found if not f[5]}
    return sorted((f for f in found if not (f[5] and f[3] == f[4] and f[2] in hidden)), key=lambda f: f[3])


def _vector(ops: list) -> list:  # as pdf.vector_ops
    kept, inside, level = [], False, 0
    for o in ops:
        inside = True if o.op == "beginText" else False if o.op == "endText" else inside
        if inside or o.op is None or o.op in ("endText", *pdf.IMAGES) or (o.op == "dependency" and not any(d is not None and not d.startswith("img_") for d in o.deps or ())):
            continue
        if o.op == "restore":
            if not level:
                continue
            level -= 1
        level += o.op == "save"
        kept.append(o)
    return kept


def _page(doc: str, ops: list, groups: list, items: list):
    """Rows of one document: its layers and what they hold, or the size of a page without layers."""
    page = {"page_w": _most(*[o.page_w for o in ops]), "page_h": _most(*[o.page_h for o in ops])}
    if not any(o.op == "beginMarkedContentProps" and o.tag == "OC" for o in ops):
        yield {"row": "flat", **page}
        return
    yield {"row": "page", **page}
    box = {"x": 0.0, "y": 0.0, "width": page["page_w"], "height": page["page_h"]}
    named: dict = defaultdict(list)
    for g in groups:
        named[g.group_id].append(g)
    layers = _ranges([o for o in ops if o.idx is not None], named)
    path = lambda *p: "/".join(str(x) for x in (doc, *p) if x is not None)
    at = [o.idx for o in ops if o.idx is not None]
    log = ops[len(ops) - len(at) :]
    inside: dict = defaultdict(list)
    for layer, _, _, start, end, _ in layers:
        inside[layer].append(log[bisect_left(at, start) : bisect_left(at, end)])
    full = set()
    for layer, parts in inside.items():
        vector = _vector(parts[0] if len(parts) == 1 else sorted((o for p in parts for o in p), key=lambda o: o.idx))
        if not vector:
            continue
        try:
            side = lambda v: float("nan") if v is None else float(v)
            markup, error = pdf_svg.draw([(o.op, json.loads(o.args) if o.args else []) for o in vector], side(vector[0].page_w), side(vector[0].page_h)), None
        except Exception as e:  # noqa: BLE001 - a broken layer becomes a report row, the others go on
            markup, error = None, f"{type(e).__name__}: {e}"
        if error is not None:
            yield {"row": "failed", "name": layer, "error": error}
        if markup is not None:
            full.add(layer)
            yield {"row": "svg", "node_id": path(layer, "svg"), "parent_id": path(layer), "ord": 0, "type": "svg", "name": layer, **box, "markup": markup}
    texts: dict = defaultdict(list)
    opened, state = 0, None
    for t in items:
        if t.kind == "open":
            opened += 1
            state = opened
        elif t.kind == "close":
            state = -1
        elif t.kind == "text" and state is not None and 1 <= state <= len(layers) and t.text:
            texts[layers[state - 1][0]].append(t)
    for layer, held in texts.items():
        full.add(layer)
        for n, text, x, y, w, h, family, size, side in _blocks(held):
            yield {"row": "text", "node_id": path(layer, n), "parent_id": path(layer), "ord": n, "type": "text", "x": x, "y": _sum(y, page["page_h"]), "width": w, "height": h, "characters": text, "family": family, "size": size, "align": side}
    for k, (layer, name, _, _, _, visible) in enumerate(layers):
        yield {"row": "layer", "node_id": path(layer), "parent_id": doc, "ord": k, "type": "group" if layer in full else "frame", "name": name, **box, "visible": visible}


def read_pages(ops: DataFrame, groups: DataFrame, items: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Rows (see LAYERED) of pages, by doc_id: each document's log, groups and items are read once, in their order, and what is found is written once.

    row: page and its layer, svg, text and failed; or flat, a page without layers. docs: doc_id of the documents to read,
    without it all that have a log; one that has none gives a row none. See `import_pages` for the columns.
    """
    o = ops.select("doc_id", F.lit(1).alias("_t"), "idx", "op", "tag", "group_id", F.lower(F.trim("group_id")).alias("key"), "args", "deps", F.col("page_w").cast("double").alias("page_w"), F.col("page_h").cast("double").alias("page_h"))
    g = groups.select("doc_id", F.lit(2).alias("_t"), "group_id", "name", F.lower(F.trim("name")).alias("key"), "visible")
    number = {c: F.col(c).cast("double") for c in ("x", "y", "width", "height")}
    i = items.withColumns(number).select("doc_id", F.lit(3).alias("_t"), "idx", "kind", "text", *number, pdf_font_family(F.col("font")).alias("family"), "has_eol")
    rows = o.unionByName(g, allowMissingColumns=True).unionByName(i, allowMissingColumns=True)
    if docs is not None:
        rows = docs.select("doc_id", F.lit(0).alias("_t")).distinct().unionByName(rows, allowMissingColumns=True)
    chosen, schema = docs is not None, to_arrow_schema(StructType.fromDDL(f"doc_id string, {LAYERED}"))

    def batch(made):
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in made], f.type) for f in schema], schema=schema)

    def found(doc, parts):
        if chosen and not parts[0]:
            return
        if parts[1]:
            for r in _page(doc, parts[1], parts[2], parts[3]):
                yield {"doc_id": doc, **r}
        elif chosen:
            yield {"doc_id": doc, "row": "none"}

    def run(batches):
        made, doc, parts = [], None, ([], [], [], [])
        for b in batches:
            for d, t, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if d != doc:
                    made += found(doc, parts)
                    doc, parts = d, ([], [], [], [])
                    if len(made) >= 4096:
                        yield batch(made)
                        made = []
                parts[t].append(Row(*r))
        made += found(doc, parts)
        if made:
            yield batch(made)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("doc_id", "_t", *Row._fields).repartition(n, "doc_id").sortWithinPartitions("doc_id", "_t", "idx")
    return cut(rows.mapInArrow(run, f"doc_id string, {LAYERED}"))


def layered_pages(read: DataFrame, flat: bool = False) -> tuple[DataFrame, DataFrame]:  # S7, P25, P36
    """(nodes, report items) of the layered pages among read rows. flat: also say that pages without layers were imported."""
    r = F.col("row")
    text = r == "text"
    nodes = read.filter(r.isin("layer", "svg", "text")).select("doc_id", "node_id", "parent_id", "ord", F.when(text, F.substring("characters", 1, 100)).otherwise(F.col("name")).alias("name"), "x", "y", "width", "height", "visible", F.when(r == "layer", locked_layer(F.col("name"))).alias("locked"), "type", "markup", "characters", F.col("family").alias("font_family"), F.when(text, pdf_font_style(F.col("family"))).alias("font_style"), F.col("size").alias("font_size"), "align")
    said = lambda level, code, message, name: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), message.alias("message"), name.alias("node_name"))
    none = F.lit(None).cast("string")
    i = F.when(r.isin("page", *["flat"] * flat), said("info", "AI_PDF_HIERARCHY_IMPORT", F.lit("layers were imported"), none)).when(r == "failed", said("warning", "AI_PDF_VECTOR_LAYER_FAILED", F.col("error"), F.col("name"))).when((r == "layer") & (F.col("type") == "frame"), said("info", "AI_EMPTY_LAYER_PRESERVED", F.lit("an empty layer was kept"), F.col("name")))
    return nodes, read.select("doc_id", i.alias("i")).filter("i is not null").select("doc_id", "i.*")


def flat_pages(read: DataFrame) -> tuple[DataFrame, DataFrame]:  # S8, S9
    """(tiles, report items) of the pages without layers among read rows."""
    flat = read.filter("row = 'flat'")
    return raster_tiles(flat), flat.select("doc_id", item("AI_PDF_FALLBACK", F.lit("kept as an image")).alias("i")).select("doc_id", "i.*").drop("page_name")


def import_pages(ops: DataFrame, groups: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:  # S7, P25, P36
    """(nodes, report items) of layered pages. Each document's rows meet in one task, as they are bounded by what one file can hold.

    ops: doc_id, idx, op, tag, group_id, args, deps, page_w, page_h; groups: doc_id, group_id, name, visible;
    items: doc_id, idx, kind, text, x, y, width, height, font, has_eol.
    """
    return layered_pages(read_pages(ops, groups, items), flat=True)


def raster_tiles(pages: DataFrame, scale: int = 2, most: int = 4096) -> DataFrame:  # S8, P14
    """Tiles of pages kept as rasters: doc_id, tile, x, y, width, height in pixels. pages: doc_id, page_w, page_h."""
    w, h = F.ceil(F.col("page_w") * scale), F.ceil(F.col("page_h") * scale)
    return pages.select("doc_id", F.posexplode(tiles(w, h, most)).alias("tile", "t")).select("doc_id", "tile", "t.*")


def raster_fallback(ops: DataFrame) -> tuple[DataFrame, DataFrame]:  # S8, S9
    """(tiles, report items) of the pages that have no layers to import. ops: doc_id, op, tag, page_w, page_h."""
    size = ops.groupBy("doc_id").agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))
    flat = size.join(has_layers(ops).filter("not coalesce(layered, false)").select("doc_id"), "doc_id", "left_semi")
    report = flat.select("doc_id", item("AI_PDF_FALLBACK", F.lit("kept as an image")).alias("i")).select("doc_id", "i.*").drop("page_name")
    return raster_tiles(flat), report
