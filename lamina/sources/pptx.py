"""Slide packages (Open XML) as node rows.

A package is unpacked and read once: a slide's shapes, table cells, theme colours and pictures are gathered in that
pass and written, so nodes, assets and report items are rows of one table, without joins or windows of their own.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamina.functions.geometry import emu, grid_cell, hex_color, preset_shape
from lamina.functions.strings import js_number, mime_type, not_blank
from lamina.session import cut
from lamina.sources.packages import _zip_entries
from lamina.sources.xml_shred import elements

OWNERS = ("sp", "pic", "graphicFrame", "grpSp", "tc", "cxnSp")
KINDS = ("sp", "pic", "graphicFrame", "grpSp")
SLIDE = r"^ppt/slides/slide(\d+)\.xml$"
# fixed values: preset colours, and names of horizontal alignments
PRESETS = {"white": "FFFFFF", "black": "000000", "transparent": "FFFFFF"}
ALIGN = {"ctr": "center", "r": "right", "just": "justified", "l": "left"}


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _path(base: str, target: str) -> str:  # F1
    """As `strings.normalize_path`."""
    kept: list[str] = []
    for p in ((base[: base.rfind("/") + 1] if not target.startswith("/") else "") + target).split("/"):
        if p == "..":
            kept = kept[:-1]
        elif p not in ("", "."):
            kept.append(p)
    return "/".join(kept)


def _blank(v: str | None) -> str | None:
    return (v or "").strip(" ") or None


def _rows(data: bytes) -> list[tuple]:
    """Elements of a part, in document order; a part that is no XML has none."""
    try:
        return list(elements(data, frozenset(OWNERS), frozenset(("p",))))
    except (ET.ParseError, ValueError):
        return []


def _relationships(part: str, elems: list[tuple]) -> list[tuple[str, str, str]]:  # S13
    """(part, id, target path); blank ids and targets are skipped."""
    owner = re.sub(r"\.rels$", "", part.replace("_rels/", ""))
    got = [(_blank(e[5].get("Id")), _blank(e[5].get("Target"))) for e in elems if e[4] == "Relationship"]
    return [(owner, i, _path(owner, t)) for i, t in got if i and t]


def _theme(elems: list[tuple]) -> dict[str, str]:  # S14
    """Scheme names and their hex values; an explicit value before a system's."""
    found: dict[str, tuple] = {}
    for e in elems:
        if "clrScheme/" in (e[9] or "") and (m := re.search(r"clrScheme/([^/]+)/(?:srgbClr|sysClr)$", e[9])):
            v = _blank(e[5].get("val")) or _blank(e[5].get("lastClr"))
            rank = 0 if e[4] == "srgbClr" else 1
            if v and m[1] not in ("name", "extLst") and (m[1] not in found or rank < found[m[1]][0]):
                found[m[1]] = (rank, v)
    return {k: v for k, (_, v) in found.items()}


# what a shape has by itself: the name, and the first of these (path below the shape, attribute) that is there
_XFRM = ("spPr/xfrm", "grpSpPr/xfrm", "xfrm")
_at = lambda part, a: [(f"{x}/{part}", a) for x in _XFRM]
_FILL, _LINE = "spPr/solidFill/", "spPr/ln/solidFill/"
OWN = {
    "given_name": [(f"{n}/cNvPr", "name") for n in ("nvSpPr", "nvPicPr", "nvGrpSpPr", "nvGraphicFramePr")],
    "off_x": _at("off", "x"), "off_y": _at("off", "y"), "ext_x": _at("ext", "cx"), "ext_y": _at("ext", "cy"), "ch_x": _at("chOff", "x"), "ch_y": _at("chOff", "y"), "ch_cx": _at("chExt", "cx"), "ch_cy": _at("chExt", "cy"),
    "rot": [(x, "rot") for x in _XFRM], "preset": [("spPr/prstGeom", "prst")], "line_w": [("spPr/ln", "w")],
    "srgb": [(_FILL + "srgbClr", "val")], "scheme": [(_FILL + "schemeClr", "val")], "prst": [(_FILL + "prstClr", "val")], "alpha": [(_FILL + "srgbClr/alpha", "val"), (_FILL + "schemeClr/alpha", "val")],
    "l_srgb": [(_LINE + "srgbClr", "val")], "l_scheme": [(_LINE + "schemeClr", "val")], "l_prst": [(_LINE + "prstClr", "val")], "l_alpha": [(_LINE + "srgbClr/alpha", "val"), (_LINE + "schemeClr/alpha", "val")],
    "embed": [("blipFill/blip", "embed")],
}
_run = lambda p, a: [(f"r/rPr{p}", a), (f"endParaRPr{p}", a)]
TEXT = {
    "latin": _run("/latin", "typeface"), "ea": _run("/ea", "typeface"), "bold": _run("", "b"), "sz": _run("", "sz"), "algn": [("pPr", "algn")],
    "t_srgb": _run("/solidFill/srgbClr", "val"), "t_scheme": _run("/solidFill/schemeClr", "val"), "t_preset": _run("/solidFill/prstClr", "val"), "t_alpha": _run("/solidFill/srgbClr/alpha", "val") + _run("/solidFill/schemeClr/alpha", "val"),
}
GROUP = ("ch_x", "ch_y", "ch_cx", "ch_cy", "ext_x", "ext_y")
#: row: shape, cell, slide or asset. of_*: what the group above has by itself; a cell's ext_x and ext_y are its table's.
READ = ", ".join([
    "doc_id string", "row string", "part string", "owner_id int", "kind string", "group_id int", "placed boolean", *[f"{n} string" for n in (*OWN, *TEXT, *(f"of_{g}" for g in GROUP))], "no_fill boolean", "has_line boolean", "no_line boolean", "characters string",
    "frame_id int", "at_row int", "at_col int", "n_rows int", "n_cols int", "target string", "ord int", "sized boolean", "slide_cx string", "slide_cy string", "data binary",
])


def _firsts(rows: list[tuple[str, dict]], wanted: dict) -> dict:
    """Of (path, attributes) in document order, the first value of each wanted pair of path and attribute."""
    first: dict[tuple, str] = {}
    for rel, attrs in rows:
        for a, v in attrs.items():
            if v is not None:
                first.setdefault((rel, a), v)
    return {n: next((first[p] for p in pairs if p in first), None) for n, pairs in wanted.items()}


def _characters(mine: list[tuple]) -> str | None:  # F5
    """The text of a shape's text bodies, a line for each paragraph: its runs, else its fields, else its own."""
    lines: dict[int, dict[str, str]] = {}
    for e in mine:
        if re.search(r"txBody/p(/r/t|/fld/t|/t)?$", e[9]):
            line = lines.setdefault(e[10], defaultdict(str))
            line[re.search(r"txBody/p/?(.*)$", e[9])[1]] += e[6] or ""
    return "\n".join(x["r/t"] or x["fld/t"] or x["t"] for _, x in sorted(lines.items())) if lines else None


def _text_style(mine: list[tuple]) -> dict:  # P10
    """Text style of the first run of the first paragraph."""
    block = next((e[0] for e in mine if re.search("txBody/p$", e[9])), None)
    rows = [e for e in mine if e[10] == block and re.search("txBody/p($|/)", e[9])] if block is not None else []
    runs = [e[0] for e in rows if re.search("txBody/p/r$", e[9])]
    stop = runs[1] if len(runs) > 1 else None
    props = [(m[1], e) for e in rows if (m := re.search(r"txBody/p/((?:r/rPr|endParaRPr|pPr).*)$", e[9]))]
    return _firsts([(p, e[5]) for p, e in props if not (p.startswith("r/") and stop is not None and e[0] > stop)], TEXT)


def _slide(part: str, elems: list[tuple], colors: dict[str, str], targets: dict, have: dict):  # P3, P4, P6 to P9, P29
    """Rows of a slide's shapes and table cells."""
    by_id, owned = {e[0]: e for e in elems}, defaultdict(list)
    for e in elems:
        if e[8] is not None:
            owned[e[8]].append(e)
    shapes = {}
    for me, mine in owned.items():
        own = _firsts([(e[9], e[5]) for e in mine], OWN)
        paths = {e[9] for e in mine}
        style = _text_style(mine)
        for n, at in ((own, "scheme"), (own, "l_scheme"), (style, "t_scheme")):
            n[at] = colors.get(n[at])
        line = any(e[9].startswith("spPr/ln/") or (e[9] == "spPr/ln" and e[5]) for e in mine)
        shapes[me] = {"part": part, "owner_id": me, "kind": mine[0][4], **own, **style, "no_fill": "spPr/noFill" in paths, "has_line": line, "no_line": "spPr/ln/noFill" in paths, "characters": _characters(mine)}
    tables: dict[int, list] = defaultdict(list)  # by frame: the cells of each row
    kids = defaultdict(list)
    for e in elems:
        if e[4] == "tr" and e[8] is not None:
            tables[e[8]].append(e[0])
        elif e[4] == "tc":
            kids[e[1]].append(e[0])
    for me, s in shapes.items():
        above = by_id.get(by_id[me][1])
        s["placed"] = above is not None and above[4] in (*KINDS, "spTree")
        if above is not None and above[4] == "grpSp":
            s["group_id"] = above[0]
            s |= {f"of_{g}": shapes[above[0]][g] for g in GROUP}
        if s["kind"] == "pic":
            for t in targets.get((part, s["embed"])) or [None]:
                yield {"row": "shape", **s, "target": t if t in have else None}
        elif s["kind"] == "graphicFrame" and me in tables:
            yield {"row": "shape", **s}
            cols = max(1, *(len(kids[tr]) for tr in tables[me]))
            for r, tr in enumerate(tables[me]):
                for c, tc in enumerate(kids[tr]):
                    yield {"row": "cell", **shapes[tc], "placed": None, "frame_id": me, "ext_x": s["ext_x"], "ext_y": s["ext_y"], "at_row": r, "at_col": c, "n_rows": len(tables[me]), "n_cols": cols}
        elif s["kind"] in ("sp", "grpSp"):
            yield {"row": "shape", **s}


def _package(content: bytes):
    """Rows of one package: shapes and cells, slides in order, pictures that are used."""
    xml, have, slides, rels, colors, size = {}, {}, [], [], {}, {}
    for part, data in _zip_entries(content, re.compile(r"^ppt/.*|\.rels$", re.I).search):
        is_xml = re.search(r"\.(xml|rels)$", part)
        if is_xml:
            xml[part] = data
        if not is_xml or part.startswith("ppt/media/"):
            have[part] = data
    for part, data in xml.items():
        if re.search(r"_rels/.*\.rels$", part, re.S):
            rels += _relationships(part, _rows(data))
        elif part == "ppt/theme/theme1.xml":
            colors = _theme(_rows(data))
        elif part == "ppt/presentation.xml":
            size = next(({"sized": True, "slide_cx": e[5].get("cx"), "slide_cy": e[5].get("cy")} for e in _rows(data) if e[4] == "sldSz"), {})
        if m := re.search(SLIDE, part, re.A):
            slides.append((int(m[1]), part))
    targets = defaultdict(list)
    for part, i, t in rels:
        targets[part, i].append(t)
    used = {}
    for k, (_, part) in enumerate(sorted(slides)):  # O1
        yield {"row": "slide", "part": part, "ord": k, **size}
        for r in _slide(part, _rows(xml[part]), colors, targets, have):
            if r["row"] == "shape" and r.get("target"):
                used[r["target"]] = True
            yield r
    for t in used:
        yield {"row": "asset", "target": t, "data": have[t]}


def read_packages(files: DataFrame) -> DataFrame:  # S1, S12
    """The rows (see READ) of slide packages (doc_id, content), written once. What is no package gives none."""
    schema = to_arrow_schema(StructType.fromDDL(READ))

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for doc, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    for r in _package(content.as_py() or b""):
                        rows.append({"doc_id": doc, **r})
                        held += len(r.get("data") or b"")
                        if len(rows) >= 4096 or held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                except zipfile.BadZipFile:
                    continue
        if rows:
            yield batch(rows)

    return cut(files.select("doc_id", "content").mapInArrow(run, READ))


def _color(srgb: Column, scheme: Column, preset: Column, alpha: Column) -> Column:  # M8, J9
    """A colour from the first of explicit, theme (its hex value) and preset value; null without any."""
    h = F.coalesce(not_blank(srgb), scheme, F.try_element_at(_map(PRESETS), preset))
    a = F.when(not_blank(alpha).isNotNull(), js_number(alpha, 100000) / 100000).otherwise(1.0)
    return F.when(h.isNotNull(), hex_color(h, a))


def import_packages(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # S1, S12, P6, P29, P30, J6
    """(nodes, assets, report items) of slide packages. files: doc_id, content.

    A package without slides gives no node; a picture whose part is missing gives a warning row.
    """
    read = read_packages(files)
    rows = read.filter("row in ('shape', 'cell')").withColumns({"given_name": not_blank(F.col("given_name")), "preset": not_blank(F.col("preset"))})
    side = lambda c: F.greatest(F.lit(1.0), emu(F.col(c)))
    rows = rows.withColumns({
        "x": emu(F.col("off_x")), "y": emu(F.col("off_y")), "width": side("ext_x"), "height": side("ext_y"), "rotation": js_number(F.col("rot")) / 60000, "font_family": F.coalesce(not_blank(F.col("latin")), not_blank(F.col("ea")), F.lit("Arial")), "font_style": F.when(F.col("bold") == "1", "Bold").otherwise("Regular"),
        "font_size": F.greatest(F.lit(1.0), js_number(F.coalesce("sz", F.lit("1800")), 1800) / 100), "align": F.coalesce(F.try_element_at(_map(ALIGN), F.col("algn")), F.lit("left")),
    })
    rows = rows.withColumns({"fill": F.when(~F.col("no_fill"), _color(F.col("srgb"), F.col("scheme"), F.col("prst"), F.col("alpha"))), "stroke": F.when(F.col("has_line") & ~F.col("no_line"), F.coalesce(_color(F.col("l_srgb"), F.col("l_scheme"), F.col("l_prst"), F.col("l_alpha")), hex_color(F.lit("000000")))), "stroke_width": F.greatest(F.lit(0.5), emu(F.col("line_w"))), "text_fill": _color(F.col("t_srgb"), F.col("t_scheme"), F.col("t_preset"), F.col("t_alpha"))})
    id_ = lambda suffix="": F.concat_ws("/", "part", F.concat(F.col("owner_id").cast("string"), F.lit(suffix)))
    node = lambda suffix, kind, name, parent, own: F.struct(F.lit(suffix).alias("suffix"), kind.alias("type"), name.alias("name"), parent.alias("inner_parent"), F.lit(own).alias("top"))
    name = F.coalesce("given_name", F.lit("Shape"))
    preset = F.coalesce("preset", F.lit("rect"))
    visual, text = ~F.col("no_fill") | F.col("has_line"), F.coalesce(F.col("characters") != "", F.lit(False))
    both = visual & text
    leaf = lambda suffix, kind, nm: F.when(both, node(suffix, kind, nm, F.lit(True), False)).otherwise(node("", kind, nm, F.lit(False), True))
    one = lambda kind, nm: F.array(node("", F.lit(kind), nm, F.lit(False), True))
    made = F.array(F.when(both, node("", F.lit("group"), name, F.lit(False), True)), F.when(visual, leaf(":shape", preset_shape(preset), name)), F.when(text, leaf(":text", F.lit("text"), F.concat(name, F.lit(" Text")))))
    made = F.when(F.col("kind") == "sp", F.filter(made, lambda m: m.isNotNull())).when((F.col("kind") == "pic") & F.col("target").isNotNull(), one("image", F.coalesce("given_name", F.lit("Image")))).when(F.col("kind") == "grpSp", one("group", F.coalesce("given_name", F.lit("Group")))).when(F.col("kind") == "graphicFrame", one("group", F.lit("Table")))
    flat = rows.filter("row = 'shape' and placed").withColumn("n", F.explode(made))

    parent = F.when(F.col("n.inner_parent"), id_()).when(F.col("group_id").isNotNull(), F.concat_ws("/", "part", F.col("group_id").cast("string"))).otherwise(F.col("part"))
    kind = F.col("n.type")
    drawn = ~kind.isin("text", "group", "image")
    # a group's direct children are moved and scaled into its frame (P5)
    moved = F.col("n.top") & F.col("group_id").isNotNull()
    scale = lambda c, size: side(size) / F.coalesce(F.nullif(emu(F.col(c)), F.lit(0.0)), side(size))
    sx, sy = scale("of_ch_cx", "of_ext_x"), scale("of_ch_cy", "of_ext_y")
    place = lambda c, origin, by: F.when(moved, (F.col(c) - emu(F.col(origin))) * by).when(F.col("n.top"), F.col(c)).otherwise(0.0).alias(c)
    sized = lambda c, by: F.when(moved, F.col(c) * by).otherwise(F.col(c)).alias(c)
    nodes = flat.select(
        "doc_id", "part", F.when(F.col("n.suffix") == "", id_()).otherwise(F.concat(id_(), F.col("n.suffix"))).alias("node_id"), parent.alias("parent_id"), F.col("owner_id").alias("ord"), F.col("kind").alias("tag"), kind.alias("type"), F.col("n.name").alias("name"),
        place("x", "of_ch_x", sx), place("y", "of_ch_y", sy), sized("width", sx), sized("height", sy), "rotation",
        F.when(kind == "text", F.coalesce("text_fill", hex_color(F.lit("111111")))).when((kind != "group") & (kind != "image"), F.col("fill")).alias("fill"),
        F.when(drawn, F.col("stroke")).alias("stroke"), F.when(drawn & F.col("stroke").isNotNull(), F.col("stroke_width")).alias("stroke_width"),
        *[F.when(kind == "text", F.col(c)).alias(c) for c in ("characters", "font_family", "font_style", "font_size", "align")],
        F.when(drawn & (F.col("preset") == "roundRect"), F.least("width", "height") * 0.12).alias("corner_radius"),
        F.when(drawn, F.when(F.col("preset").contains("hexagon"), 6).when(F.col("preset").contains("pentagon"), 5).otherwise(3)).alias("point_count"), F.col("target").alias("asset_ref"),
    )
    nodes = nodes.unionByName(_table_nodes(rows.filter("row = 'cell'")), allowMissingColumns=True)
    length = lambda c, d: F.coalesce(F.when(F.col("sized"), emu(F.col(c))), F.lit(d))
    frames = read.filter("row = 'slide'").select("doc_id", "part", F.col("part").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), "ord", F.lit("sld").alias("tag"), F.lit("frame").alias("type"), F.concat(F.lit("Slide "), (F.col("ord") + 1).cast("string")).alias("name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), length("slide_cx", 1280.0).alias("width"), length("slide_cy", 720.0).alias("height"), hex_color(F.lit("FFFFFF")).alias("fill"))
    nodes = nodes.unionByName(frames, allowMissingColumns=True)
    assets = read.filter("row = 'asset'").select("doc_id", F.col("target").alias("asset_id"), F.element_at(F.split("target", "/"), -1).alias("name"), mime_type(F.col("target")).alias("mime"), "data")
    report = nodes.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("info").alias("level"), F.lit("PPTX_IMPORT").alias("code"), F.concat(F.col("n").cast("string"), F.lit(" nodes imported")).alias("message"), F.lit(None).cast("string").alias("node_name"))
    missing = rows.filter("row = 'shape' and kind = 'pic' and target is null")
    report = report.unionByName(missing.select("doc_id", F.lit("warning").alias("level"), F.lit("PPTX_IMPORT").alias("code"), F.lit("a picture's part is missing").alias("message"), F.coalesce("given_name", F.lit("Image")).alias("node_name")))
    return nodes, assets, report


def _table_nodes(cells: DataFrame) -> DataFrame:
    at = grid_cell(*map(F.col, ("at_row", "at_col", "n_rows", "n_cols", "width", "height")))
    c = cells.withColumn("at", at).withColumns({"w": F.col("at.width"), "h": F.col("at.height"), "cx": F.col("at.x"), "cy": F.col("at.y")})
    name = F.format_string("Cell %d.%d", F.col("at_row") + 1, F.col("at_col") + 1)
    id_ = lambda s: F.concat(F.col("part"), F.lit("/"), F.col("owner_id").cast("string"), F.lit(s))
    base = lambda s, k, nm, x, y, w, h, f: [F.col("doc_id"), F.col("part"), id_(s).alias("node_id"), F.concat_ws("/", "part", F.col("frame_id").cast("string")).alias("parent_id"), F.col("owner_id").alias("ord"), F.lit("tc").alias("tag"), F.lit(k).alias("type"), nm.alias("name"), x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), hex_color(F.lit(f)).alias("fill")]
    box = c.select(*base("", "rectangle", name, F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), "FFFFFF"), hex_color(F.lit("D9D9D9")).alias("stroke"), F.lit(1.0).alias("stroke_width"))
    text = c.filter("characters <> ''").select(*base(":text", "text", F.concat(name, F.lit(" Text")), F.col("cx") + 6, F.col("cy") + 4, F.greatest(F.lit(1.0), F.col("w") - 12), F.greatest(F.lit(1.0), F.col("h") - 8), "222222"), "characters", "font_family", "font_style", "font_size", "align")
    return box.unionByName(text, allowMissingColumns=True)
