"""Vector markup (SVG) as node rows: plain files as editable shapes, complex ones as a hierarchy with text and self-contained fragments."""

from __future__ import annotations

import copy
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import geometry as G
from lamina.functions import strings as S
from lamina.functions.geometry import IDENTITY
from lamina.operators import ordered, tree
from lamina.operators.pdf_svg import times
from lamina.session import cut
from lamina.sources.xml_shred import shred

# fixed values: tags that hold definitions, tags that need the complex path, tags that draw
STRUCTURAL = ("clippath", "defs", "font", "lineargradient", "mask", "metadata", "pattern", "radialgradient", "style", "symbol")
COMPLEX = ("clippath", "defs", "filter", "foreignobject", "lineargradient", "mask", "pattern", "radialgradient", "style", "symbol", "textpath", "tspan", "use")
DRAWING = ("circle", "ellipse", "g", "image", "line", "path", "polygon", "polyline", "rect", "use")


def attr(n: str) -> Column:
    return F.col("attrs")[n]


def style_of(n: str) -> Column:
    return F.col("style")[n]


GROUPS = ("g", "svg", "a")
PLACED = "is_svg boolean, page_w double, page_h double, ox double, oy double, inside boolean, under boolean, texts array<int>, spanned boolean, matrix array<double>"


def _placed(ids, parents, tags, move_x, move_y, width, height, own):
    """What elements have from those above them: whether the root is an svg element, the page's size, the offset down to the element (P11), whether only groups stand above and whether a definition does (P13), the text elements from the top to the element; whether a text element holds a tspan; the matrix of texts and tspans (F26)."""
    n, at = len(ids), {}
    is_svg, x, y = [False] * n, [*move_x], [*move_y]
    w, h, grouped, inside, under, texts, spanned, world = [None] * n, [None] * n, [False] * n, [False] * n, [False] * n, [()] * n, [False] * n, [IDENTITY] * n
    for i in range(n):
        at[ids[i]] = i
        tag, own_m = tags[i], own[i] or IDENTITY
        if parents[i] is None:
            is_svg[i], w[i], h[i], grouped[i], world[i] = tag == "svg", width[i], height[i], tag in GROUPS, own_m
        else:
            k = at[parents[i]]
            is_svg[i], w[i], h[i], inside[i], texts[i] = is_svg[k], w[k], h[k], grouped[k], texts[k]
            x[i], y[i] = x[i] + x[k], y[i] + y[k]
            under[i] = under[k] or tags[k] in STRUCTURAL
            world[i] = times(world[k], own_m) if own_m is not IDENTITY else world[k]
            grouped[i] = grouped[k] and tag in GROUPS
        if tag == "text":
            texts[i] = (*texts[i], ids[i])
        elif tag == "tspan":
            for t in texts[i]:
                spanned[at[t]] = True
    words = [t in ("text", "tspan") for t in tags]
    return is_svg, w, h, x, y, inside, under, [list(t) if k else None for t, k in zip(texts, words, strict=True)], spanned, [list(m) if k else None for m, k in zip(world, words, strict=True)]


def load(files: DataFrame, matrices: bool = False) -> DataFrame:
    """Element rows of files (doc_id, name, content): doc_id, node_id, parent_id, ord, tag (lower case), attrs, style (map), text, content, and what an element has from those above it (see `_placed`).

    Files are parsed once, their elements are placed in the same pass, which has them in document order, and
    written, as every user reads them many times. matrices: also those of transforms."""
    text = S.normalize_svg(F.decode("content", "UTF-8"))
    e = shred(files.select("doc_id", F.lit("").alias("part"), F.encode(text, "UTF-8").alias("content")))
    e = e.select("doc_id", F.col("elem_id").alias("node_id"), F.col("parent_id"), F.col("ord"), F.lower("tag").alias("tag"), "attrs", F.when(F.coalesce(F.col("attrs")["style"], F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(S.declarations(F.col("attrs")["style"])).alias("style"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("content", F.lit("")).alias("content"))
    box = F.split(F.trim(F.coalesce(attr("viewBox"), F.lit(""))), r"[\s,]+")
    side = lambda a, i: F.when(F.col("parent_id").isNull(), S.parse_float(attr(a), S.parse_float(F.get(box, F.lit(i)), 1000.0)))
    moved = F.coalesce(attr("transform"), F.lit(""))
    move = lambda c: F.when(moved == "", 0.0).otherwise(G.only_translation(moved)[c])
    own = F.when(F.coalesce(attr("transform"), F.lit("")) != "", G.parse_transform(attr("transform"))) if matrices else F.lit(None).cast("array<double>")
    e = e.withColumns({"_x": move("x"), "_y": move("y"), "_w": side("width", 2), "_h": side("height", 3), "_own": own})
    return cut(ordered.fold_ordered(e, ("node_id", "parent_id", "tag", "_x", "_y", "_w", "_h", "_own"), _placed, PLACED).drop("_x", "_y", "_w", "_h", "_own"))


def checked(elems: DataFrame, keep: Column) -> DataFrame:
    """The rows to keep. Fails where the root is no svg element; one condition, so that no row goes before it is checked."""
    return elems.filter(F.when(F.col("is_svg"), keep).otherwise(F.raise_error(F.lit("not an SVG document")).cast("boolean")))


def page_sizes(elems: DataFrame) -> DataFrame:  # S4
    """doc_id, page_w, page_h: width and height, else the view box, else 1000. Fails where the root is no svg element."""
    return checked(elems.filter("parent_id is null"), F.lit(True)).select("doc_id", "page_w", "page_h")


def needs_hierarchy(elems: DataFrame) -> DataFrame:  # S5
    """doc_id, complex: whether any element is beyond plain shapes."""
    t = F.coalesce(attr("transform"), F.lit(""))
    any_attr = F.lit(False)
    for n in ("class", "clip-path", "mask", "filter"):
        any_attr = any_attr | (F.coalesce(attr(n), F.lit("")) != "")
    for n in ("clip-path", "mask", "filter", "mix-blend-mode"):
        any_attr = any_attr | (F.coalesce(style_of(n), F.lit("")) != "")
    paint = F.coalesce(style_of("fill"), F.lit("")).startswith("url(") | F.coalesce(style_of("stroke"), F.lit("")).startswith("url(")
    one = F.col("tag").isin(*COMPLEX) | ((t != "") & ~t.rlike(r"(?i)^\s*translate\(")) | any_attr | paint
    return elems.groupBy("doc_id").agg(F.bool_or(one).alias("complex"))


def _num(n: str, d: Column | float = 0.0) -> Column:
    return S.parse_float(attr(n), d)


def paint() -> Column:  # M9
    return G.parse_color(F.coalesce(attr("fill"), style_of("fill"), F.lit("#000000")))


def stroke() -> Column:  # M9
    return G.parse_color(F.coalesce(attr("stroke"), style_of("stroke")))


def plain_nodes(elems: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:  # P11
    """(nodes, assets, report items) of plain files; offsets of ancestors add up."""
    # what stands inside a shape is part of the shape, not a node of its own
    e = checked(elems, F.col("inside"))
    tag = F.col("tag")
    ox, oy = F.col("ox"), F.col("oy")
    size = S.parse_float(F.coalesce(attr("font-size"), style_of("font-size")), 16.0)
    rx, ry = F.when(tag == "circle", _num("r", 1.0)).otherwise(F.greatest(F.lit(1.0), _num("rx", 1.0))), F.when(tag == "circle", _num("r", 1.0)).otherwise(F.greatest(F.lit(1.0), _num("ry", 1.0)))
    href = F.coalesce(attr("href"), F.lit(""))
    oval = tag.isin("circle", "ellipse")
    case = lambda *pairs, other: _case(pairs, other)
    group = tag.isin("g", "a")
    name = F.coalesce(S.not_blank(attr("id")), S.not_blank(attr("label")), F.element_at(F.create_map(*[F.lit(x) for kv in {"g": "Group", "a": "Group", "rect": "Rectangle", "circle": "Ellipse", "ellipse": "Ellipse", "line": "Line", "path": "Path", "text": "Text", "image": "Image"}.items() for x in kv]), tag), tag)
    known = group | oval | tag.isin("rect", "line") | ((tag == "path") & (F.coalesce(attr("d"), F.lit("")) != "")) | ((tag == "text") & (F.trim("content") != "")) | ((tag == "image") & href.startswith("data:image/"))
    anchor = F.coalesce(attr("text-anchor"), style_of("text-anchor"))
    nodes = e.filter(known).select(
        "doc_id", "node_id", "parent_id", "ord", case((group, "group"), (tag == "rect", "rectangle"), (oval, "ellipse"), (tag == "line", "line"), (tag == "path", "vector"), (tag == "text", "text"), other="image").alias("type"), name.alias("name"),
        case((group, 0.0), (tag == "rect", _num("x") + ox), (oval, _num("cx") + ox - rx), (tag == "line", _num("x1") + ox), (tag == "path", ox), other=_num("x") + ox).alias("x"),
        case((group, 0.0), (tag == "rect", _num("y") + oy), (oval, _num("cy") + oy - ry), (tag == "line", _num("y1") + oy), (tag == "path", oy), (tag == "text", _num("y") + oy - size), other=_num("y") + oy).alias("y"),
        case((group | (tag == "path"), F.col("page_w")), (oval, rx * 2), (tag == "line", F.greatest(F.lit(1.0), _num("x2") - _num("x1"))), (tag == "text", F.greatest(size, F.col("page_w") - _num("x"))), other=F.greatest(F.lit(1.0), _num("width", 1.0))).alias("width"),
        case((group | (tag == "path"), F.col("page_h")), (oval, ry * 2), (tag == "line", F.greatest(F.lit(1.0), _num("y2") - _num("y1"))), (tag == "text", F.greatest(size * 1.4, _num("height", size * 1.4))), other=F.greatest(F.lit(1.0), _num("height", 1.0))).alias("height"),
        S.parse_float(attr("opacity"), 1.0).alias("opacity"), ((F.coalesce(attr("display"), F.lit("")) != "none") & (F.coalesce(attr("visibility"), F.lit("")) != "hidden")).alias("visible"),
        F.when(~group & ~tag.isin("line", "image"), paint()).alias("fill"), F.when(~group & ~tag.isin("text", "image"), stroke()).alias("stroke"), F.when(stroke().isNotNull() & ~group & ~tag.isin("text", "image"), S.parse_float(F.coalesce(attr("stroke-width"), style_of("stroke-width")), 1.0)).alias("stroke_width"),
        F.when(tag == "rect", F.greatest(_num("rx"), _num("ry"))).alias("corner_radius"), F.when(tag == "path", attr("d")).alias("path"), F.when(tag == "path", F.when(attr("fill-rule") == "evenodd", "evenodd").otherwise("nonzero")).alias("winding"),
        F.when(tag == "text", F.trim("content")).alias("characters"), F.when(tag == "text", size).alias("font_size"), F.when(tag == "text", F.coalesce(attr("font-family"), style_of("font-family"), F.lit("Arial"))).alias("font_family"),
        F.when(tag == "text", F.when(F.coalesce(attr("font-weight"), style_of("font-weight")) == "bold", "Bold").otherwise("Regular")).alias("font_style"), F.when(tag == "text", F.when(anchor == "middle", "center").when(anchor == "end", "right").otherwise("left")).alias("align"),
        F.when(tag == "image", F.concat_ws("/", "doc_id", "node_id")).alias("asset_ref"),
    )
    assets = e.filter((tag == "image") & href.startswith("data:image/")).select("doc_id", F.concat_ws("/", "doc_id", "node_id").alias("asset_id"), name.alias("name"), F.substring_index(F.substring(href, 6, 64), ";", 1).alias("mime"), S.data_url_bytes(href).alias("data"))
    unknown = ~known & ~tag.isin("path", "text")
    report = e.filter(unknown).select("doc_id", F.lit("warning").alias("level"), F.when(tag == "image", "SVG_EXTERNAL_IMAGE").otherwise("SVG_UNSUPPORTED_ELEMENT").alias("code"), F.concat(F.lit("skipped <"), tag, F.lit(">")).alias("message"), name.alias("node_name"))
    done = elems.filter("parent_id is null").select("doc_id", F.lit("info").alias("level"), F.lit("SVG_VECTOR_IMPORT").alias("code"), F.lit("imported as editable shapes").alias("message"), F.lit(None).cast("string").alias("node_name"))
    return nodes, assets, done.unionByName(report)


def _case(pairs, other) -> Column:
    out = None
    for c, v in pairs:
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(other)


def style_values(elems: DataFrame) -> DataFrame:
    """doc_id, node_id, name, value, rank, class_pos of everything that can be inherited: inline, class and attribute values."""
    inline = elems.select("doc_id", "node_id", F.explode("style").alias("name", "value"), F.lit(0).alias("rank"), F.lit(0).alias("class_pos"))
    attrs = elems.select("doc_id", "node_id", F.explode("attrs").alias("name", "value"), F.lit(2).alias("rank"), F.lit(0).alias("class_pos"))
    sheets = elems.filter("tag = 'style'").select("doc_id", F.col("node_id").alias("sheet"), F.posexplode(S.class_rules(F.col("content"))).alias("pos", "rule"))
    rules = sheets.select("doc_id", "sheet", F.col("pos").alias("ord"), F.col("rule.name").alias("class"), F.explode(S.declarations(F.col("rule.body"))).alias("name", "value"))
    classes = elems.select("doc_id", "node_id", F.posexplode(F.filter(F.split(F.trim(F.coalesce(attr("class"), F.lit(""))), r"\s+"), lambda c: c != "")).alias("class_pos", "class"))
    by_class = classes.join(tree.class_styles(rules), ["doc_id", "class"]).select("doc_id", "node_id", "name", "value", F.lit(1).alias("rank"), "class_pos")
    return inline.unionByName(attrs).unionByName(by_class)


INHERITED = ("x", "y", "font-size", "letter-spacing", "text-anchor", "font-weight", "font-style", "font-family", "fill", "text-decoration", "mix-blend-mode")


def _inherited(ids, parents, tags, own):
    """The values that hold at each text and tspan: its own, else those of the nearest element above."""
    at, out = {}, []
    for i, up, values in zip(ids, parents, own, strict=True):
        held = at.get(up, {})
        at[i] = {**held, **dict(values)} if values else held
    for i, tag in zip(ids, tags, strict=True):
        out.append(list(at[i].items()) if tag in ("text", "tspan") else None)
    return [out]


def _filled(ids, parents, groups):
    """Whether a node is no group, or holds one that is none."""
    at, full = {k: i for i, k in enumerate(ids)}, [not g for g in groups]
    for i in range(len(ids) - 1, -1, -1):
        if full[i] and parents[i] in at:
            full[at[parents[i]]] = True
    return [full]


def text_parts(elems: DataFrame) -> DataFrame:  # P32
    """Each tspan, or the text element itself where it has none, with its place and style. Elements are loaded with matrices."""
    is_text = F.col("tag") == "text"
    parts = elems.filter((is_text & ~F.col("spanned")) | (F.col("tag") == "tspan")).withColumn("text_id", F.explode(F.when(is_text, F.array("node_id")).otherwise(F.col("texts"))))
    parts = parts.withColumn("characters", F.trim(F.regexp_replace("content", r"\s+", " "))).filter("characters <> ''")
    own = F.min_by("value", F.struct(F.col("rank"), -F.coalesce("class_pos", F.lit(0))))
    values = style_values(elems).filter(F.col("name").isin(*INHERITED)).groupBy("doc_id", "node_id", "name").agg(own.alias("value")).groupBy("doc_id", "node_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_own"))
    tagged = elems.select("doc_id", "node_id", "parent_id", "tag").join(values, ["doc_id", "node_id"], "left")
    wide = ordered.fold_documents(tagged, ("node_id", "parent_id", "tag", "_own"), _inherited, "v map<string,string>", ["node_id"]).filter("v is not null").select("doc_id", "node_id", "v")
    p = parts.join(wide, ["doc_id", "node_id"], "left")
    v = lambda n, d=None: F.coalesce(F.try_element_at(F.col("v"), F.lit(n)), F.lit(d).cast("string"))
    at = G.apply_matrix(F.col("matrix"), S.parse_float(v("x", "0")) + _num("dx"), S.parse_float(v("y", "0")) + _num("dy"))
    scale = G.scales(F.col("matrix"))
    p = p.withColumns({"at": at, "scale": scale}).withColumn("font_size", F.greatest(F.lit(1.0), S.parse_float(v("font-size", "16"), 16.0) * F.col("scale.y"))).withColumn("letter_spacing", S.parse_float(v("letter-spacing", "0")) * F.col("scale.x"))
    declared = _num("textLength") * F.col("scale.x")
    p = p.withColumn("w", F.when(declared > 0, declared).otherwise(G.text_width(F.col("characters"), F.col("font_size"), F.col("letter_spacing"))))
    anchor = v("text-anchor", "start")
    left = F.col("at.x") - F.when(anchor == "middle", F.col("w") / 2).when(anchor == "end", F.col("w")).otherwise(0.0)
    family = F.coalesce(S.not_blank(F.regexp_replace(F.trim(F.element_at(F.split(v("font-family", "Arial"), ","), 1)), "^['\"]|['\"]$", "")), F.lit("Arial"))
    deco = v("text-decoration", "none")
    return p.select("doc_id", "text_id", "node_id", "characters", left.alias("left"), (F.col("at.y") - F.col("font_size")).alias("top"), (left + F.col("w")).alias("right"), (F.col("at.y") + F.col("font_size") * 0.25).alias("bottom"), F.col("at.y").alias("baseline"), family.alias("font_family"), G.font_style(v("font-weight", "normal"), v("font-style", "normal")).alias("font_style"), "font_size", "letter_spacing", F.coalesce(G.parse_color(v("fill", "#000000")), G.hex_color(F.lit("#000000"))).alias("fill"), F.when(deco == "underline", "underline").when(deco == "line-through", "strikethrough").otherwise("none").alias("decoration"), F.when(anchor == "middle", "center").when(anchor == "end", "right").otherwise("left").alias("align"))


def text_nodes(elems: DataFrame) -> tuple[DataFrame, DataFrame]:  # P33, W4, G8
    """(text nodes, their runs) of the text elements."""
    keys = ["doc_id", "text_id"]
    p = cut(text_parts(elems))
    prev = lambda c: ordered.previous(c, keys, ["node_id"])
    gap = F.abs(F.col("baseline") - prev("baseline"))
    p = p.withColumn("gap", gap).withColumn("new_line", F.coalesce(gap > F.greatest(F.lit(1.0), F.least("font_size", prev("font_size")) * 0.45), F.lit(False)))
    runs = ordered.text_runs(p, keys, ["node_id"], "characters", F.col("new_line"))
    # here a line end stands between runs and belongs to none
    runs = runs.withColumn("run_end", F.col("run_start") + S.utf16_length(F.col("characters")))
    text = ordered.joined_text(p, keys, "node_id", "characters", F.col("new_line"))
    first = F.min_by(F.struct("font_family", "font_style", "font_size", "letter_spacing", "fill", "decoration"), "node_id")
    box = p.groupBy(*keys).agg(first.alias("f"), F.min("left").alias("l"), F.min("top").alias("t"), F.max("right").alias("r"), F.max("bottom").alias("b"), F.avg(F.when(F.col("new_line"), F.col("gap"))).alias("gap"), F.min_by("align", "node_id").alias("align"))
    own = elems.filter("tag = 'text'").select("doc_id", F.col("node_id").alias("text_id"), "attrs", "style", "parent_id", "ord", "matrix")
    rows = box.join(text, keys).join(own, keys)
    value = lambda n: F.coalesce(style_of(n), attr(n))
    nodes = rows.select(
        "doc_id", F.col("text_id").alias("node_id"), "parent_id", "ord", F.lit("text").alias("type"), S.element_name(attr("id"), attr("label"), F.coalesce(F.nullif(F.substring("characters", 1, 100), F.lit("")), F.lit("Text"))).alias("name"), F.col("l").alias("x"), F.col("t").alias("y"),
        F.greatest(F.col("f.font_size"), F.col("r") - F.col("l")).alias("width"), F.greatest(F.col("f.font_size") * 1.25, F.col("b") - F.col("t")).alias("height"), G.rotation(F.col("matrix")).alias("rotation"), G.clamp(S.parse_float(value("opacity"), 1.0)).alias("opacity"),
        ((F.coalesce(value("display"), F.lit("")) != "none") & (F.coalesce(value("visibility"), F.lit("")) != "hidden")).alias("visible"), "characters", "f.*", F.coalesce("gap", F.col("f.font_size") * 1.2).alias("line_height"), "align",
    )
    return nodes, runs.select(*keys, "run_start", "run_end", "font_family", "font_style", "font_size", "letter_spacing", "decoration", "fill")


def hierarchy(files: DataFrame, elems: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:  # S6, P12, P13, P26, F24
    """(nodes, text runs, report items) of complex files: groups, texts, and a fragment for every other drawn element. elems: their elements, loaded with matrices."""
    elems = load(files, matrices=True) if elems is None else elems
    live = checked(elems, F.col("inside") & ~F.col("under") & ~F.col("tag").isin(*STRUCTURAL))
    texts, runs = text_nodes(elems)
    value = lambda n: F.coalesce(style_of(n), attr(n))
    is_group = F.col("tag").isin("g", "a")
    shown = ((F.coalesce(value("display"), F.lit("")) != "none") & (F.coalesce(value("visibility"), F.lit("")) != "hidden")).alias("visible")
    base = live.filter("tag <> 'text'").select("doc_id", "node_id", "parent_id", "ord", is_group.alias("is_group"), F.when(is_group, "group").otherwise("svg").alias("type"), S.element_name(attr("id"), attr("label"), F.when(is_group, "Group").otherwise(F.col("tag"))).alias("name"), F.coalesce(S.not_blank(attr("id")), S.not_blank(attr("label"))).alias("own_name"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("page_w").alias("width"), F.col("page_h").alias("height"), F.when(is_group, G.clamp(S.parse_float(value("opacity"), 1.0))).alias("opacity"), F.when(is_group, shown).alias("visible"), F.when(is_group, value("mix-blend-mode")).alias("blend_mode"))
    texts = texts.join(live.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").withColumn("is_group", F.lit(False))
    both = base.unionByName(texts, allowMissingColumns=True)
    both = cut(ordered.fold_documents(both, ("node_id", "parent_id", "is_group"), _filled, "filled boolean", ["node_id"]))
    kept, dropped = both.filter("filled").drop("filled"), both.filter("not filled")
    named = dropped.filter("own_name is not null").select("doc_id", F.lit("warning").alias("level"), F.lit("SVG_EMPTY_GROUP_OMITTED").alias("code"), F.lit("an empty group was left out").alias("message"), F.regexp_replace("own_name", "(?i)_x5F_", "_").alias("node_name"))
    info = kept.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("info").alias("level"), F.lit("SVG_HIERARCHY_IMPORT").alias("code"), F.concat(F.col("n").cast("string"), F.lit(" nodes imported")).alias("message"), F.lit(None).cast("string").alias("node_name"))
    # after the count, which doesn't need them
    kept = kept.join(fragments(files), ["doc_id", "node_id"], "left")
    nulls = files.select("doc_id", S.null_count(F.decode("content", "UTF-8")).alias("n")).filter("n > 0").select("doc_id", F.lit("warning").alias("level"), F.lit("SVG_INVALID_NULL_REMOVED").alias("code"), F.concat(F.col("n").cast("string"), F.lit(" null characters removed")).alias("message"), F.lit(None).cast("string").alias("node_name"))
    return kept.drop("is_group", "own_name"), runs, info.unionByName(named).unionByName(nulls)


def decorations(elems: DataFrame) -> DataFrame:  # P26
    """doc_id, drawn: elements that draw and stand under no definition."""
    return elems.filter(F.col("tag").isin(*DRAWING) & ~F.col("under")).groupBy("doc_id").agg(F.count("*").alias("drawn"))


def _fragment_rows(data: bytes):
    """(elem_id, markup) of each drawn leaf: its definitions, its ancestors without their appearance, and itself."""
    local = lambda e: e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else "#"
    root = ET.fromstring(data)
    ids, n, stack = {}, 0, [root]
    while stack:
        e = stack.pop()
        ids[e] = n
        n += 1
        stack.extend(reversed(e))
    definitions, leaves = [], []

    def visit(e, above):
        if local(e) in STRUCTURAL:
            definitions.append(e)
        elif local(e) in ("g", "a", "svg"):
            for c in e:
                visit(c, [*above, e] if e is not root else above)
        elif local(e) != "text":
            leaves.append((e, above))

    visit(root, [])
    for e, above in leaves:
        top = ET.Element(root.tag, dict(root.attrib))
        for d in definitions:
            top.append(copy.deepcopy(d))
        at = top
        for a in above:
            keep = {k: v for k, v in a.attrib.items() if k not in ("opacity", "display", "visibility")}
            if "style" in keep:
                css = [p.split(":", 1) for p in keep["style"].split(";") if ":" in p]
                css = [f"{k.strip()}:{v.strip()}" for k, v in css if k.strip() not in ("opacity", "display", "visibility", "mix-blend-mode")]
                keep = {k: v for k, v in keep.items() if k != "style"} | ({"style": ";".join(css)} if css else {})
            at = ET.SubElement(at, a.tag, keep)
        at.append(copy.deepcopy(e))
        yield ids[e], ET.tostring(top, encoding="unicode")


def fragments(files: DataFrame) -> DataFrame:  # F24, F25
    """doc_id, node_id, markup of the drawn leaves."""

    def run(batches):
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, m in _fragment_rows(data):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.string()), "node_id": pa.array([i], pa.int32()), "markup": [m]})

    text = F.encode(S.normalize_svg(F.decode("content", "UTF-8")), "UTF-8")
    return files.select("doc_id", text.alias("content")).mapInArrow(run, "doc_id string, node_id int, markup string")
