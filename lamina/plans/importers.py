"""Importers bound to the supplied tables: files, markup, slides, layers and page logs are made of a table's rows and go through the readers.

Each maker lists a document's rows as literals and columns, so the SQL twins state what must come out.
"""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import geometry, pixels, strings
from lamina.functions.filters import ADJUSTMENT
from lamina.operators import fonts, intervals, pdf, pdf_svg, report
from lamina.session import cut
from lamina.session import table as T
from lamina.sources import packages, page_logs, pptx, psd, route, sink, svg, xml_shred

SVG = '<svg xmlns="http://www.w3.org/2000/svg"'


def made(df: DataFrame, schema: dict[str, str], rows: list[dict]) -> DataFrame:
    """doc_id and a row for each dict, for each row of df; what a dict leaves out is null."""
    one = lambda r: F.struct(*[(r[n] if isinstance(r.get(n), Column) else F.lit(r.get(n))).cast(t).alias(n) for n, t in schema.items()])
    return df.select(F.col("doc_id"), F.explode(F.array(*map(one, rows))).alias("_r")).select("doc_id", "_r.*")


def text_of(*parts) -> Column:
    """Literals and columns joined as one text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def parts_of(spark, d) -> DataFrame:
    return T(spark, d, "part").withColumn("doc_id", F.col("p_partkey").cast("string"))


def suppliers(spark, d) -> DataFrame:
    return T(spark, d, "supplier").withColumn("doc_id", F.col("s_suppkey").cast("string"))


def spread(df: DataFrame, by: str) -> DataFrame:
    """Small tables are a task or two, and what is made of a row is many times its size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def key(name: str) -> Column:
    return F.col("doc_id").cast("long").alias(name)


def _plain(spark, d) -> DataFrame:
    c = F.col
    text = text_of(
        SVG + ' viewBox="0 0 ', c("p_size") + 100, ' 100"><g id="', c("p_name"), '" transform="translate(', c("p_size"), ' 5)"><rect x="1" y="2" width="', c("p_partkey") % 50 + 1, '" height="40" rx="3" fill="#f00"/><circle cx="50" cy="60" r="', c("p_size"),
        '"/></g><line x1="5" y1="6" x2="', c("p_size"), '" y2="9" stroke="red" stroke-width="2"/><path d="M0 0L1 1" fill="none"/><text x="5" y="20" font-size="10" text-anchor="middle">', c("p_type"), '</text><image href="data:image/png;base64,aGk=" width="7" height="8"/><image href="http://x/y.png"/><blob/></svg>',
    )
    return spread(parts_of(spark, d), "p_partkey").select("doc_id", F.encode(text, "UTF-8").alias("content"))


def markup_nodes(spark, d):  # S4, P11, M6, M9, M10
    n = svg.plain_nodes(svg.load(_plain(spark, d)))[0]
    return n.select(key("p_partkey"), "node_id", "parent_id", "type", "name", "x", "y", "width", "height", "corner_radius", "stroke_width", "characters", "align", F.col("fill.r").alias("red"))


MARKUP_NODES = """
with p as (select p_partkey, p_name, p_type, p_size::double as s, p_partkey % 50 + 1.0::double as w from part), r as (
select *, 1 as node_id, 0 as parent_id, 'group' as type, p_name as name, 0.0::double as x, 0.0::double as y, s + 100 as width, 100.0::double as height, null::double as corner_radius, null::double as stroke_width, null::varchar as characters, null::varchar as align, null::double as red from p
union all select *, 2, 1, 'rectangle', 'Rectangle', s + 1, 7, w, 40, 3, null, null, null, 1 from p
union all select *, 3, 1, 'ellipse', 'Ellipse', 50, 65 - s, 2 * s, 2 * s, null, null, null, null, 0 from p
union all select *, 4, 0, 'line', 'Line', 5, 6, greatest(1, s - 5), 3, null, 2, null, null, null from p
union all select *, 5, 0, 'vector', 'Path', 0, 0, s + 100, 100, null, null, null, null, null from p
union all select *, 6, 0, 'text', 'Text', 5, 10, s + 95, 14, null, null, p_type, 'center', 0 from p
union all select *, 7, 0, 'image', 'Image', 0, 0, 7, 8, null, null, null, null, null from p)
select p_partkey, node_id, parent_id, type, name, x, y, width, height, corner_radius, stroke_width, characters, align, red from r"""


def markup_report(spark, d):  # S4, S5, 2.13
    e = svg.load(_plain(spark, d))
    _, assets, items = svg.plain_nodes(e)
    codes = items.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "level", "code", "node_name"))), ",").alias("items"))
    rows = svg.page_sizes(e).join(svg.needs_hierarchy(e), "doc_id").join(svg.decorations(e), "doc_id").join(assets.select("doc_id", "mime", F.decode("data", "UTF-8").alias("data")), "doc_id").join(codes, "doc_id")
    return rows.select(key("p_partkey"), "page_w", "page_h", "complex", "drawn", "mime", "data", "items")


MARKUP_REPORT = """
select p_partkey, p_size + 100.0::double as page_w, 100.0::double as page_h, false as complex, 7 as drawn, 'image/png' as mime, 'hi' as data,
'info:SVG_VECTOR_IMPORT,warning:SVG_EXTERNAL_IMAGE:Image,warning:SVG_UNSUPPORTED_ELEMENT:blob' as items from part"""


def _styled(spark, d) -> DataFrame:
    c = F.col
    text = text_of(
        SVG + ' width="', c("s_nationkey") + 200, '" height="100"><style>.a{fill:#00ff00;font-size:8px}.a{font-size:20px}</style><g id="L_x5F_', c("s_suppkey"), '" opacity="0.5" transform="translate(', c("s_nationkey"), ' 5)"><text class="a" x="20" y="40" font-family="Inter"><tspan x="20" y="30">',
        c("s_name"), '</tspan><tspan x="20" y="60">two</tspan></text><rect id="r" width="5"/></g><g id="nothing"/><g/></svg>',
    )
    return suppliers(spark, d).select("doc_id", F.encode(text, "UTF-8").alias("content"))


def markup_hierarchy(spark, d):  # S5, S6, P12, P13, P26, P32, P33, W4, G8, F8, J8, F24, F25, F26, M11, M14, M15
    nodes = svg.hierarchy(_styled(spark, d))[0]
    whole = F.col("markup").contains('id="r"') & F.col("markup").contains("translate(") & ~F.col("markup").contains("opacity")
    return nodes.select(key("s_suppkey"), "type", "name", "x", "y", F.round("width", 6).alias("width"), "height", "opacity", "characters", "font_family", "font_size", "line_height", F.col("fill.g").alias("green"), whole.alias("whole"))


MARKUP_HIERARCHY = """
with s as (select s_suppkey, s_name, s_nationkey::double as n from supplier), r as (
select *, 'group' as type, 'L_' || s_suppkey as name, 0.0::double as x, 0.0::double as y, n + 200 as width, 100.0::double as height, 0.5::double as opacity, null::varchar as characters, null::varchar as font_family, null::double as font_size, null::double as line_height, null::double as green, null::boolean as whole from s
union all select *, 'svg', 'r', 0, 0, n + 200, 100, null, null, null, null, null, null, true from s
union all select *, 'text', s_name || chr(10) || 'two', n + 20, 15, round(length(s_name) * 20 * 0.56::double, 6), 55, 1, s_name || chr(10) || 'two', 'Inter', 20, 30, 1, null from s)
select s_suppkey, type, name, x, y, width, height, opacity, characters, font_family, font_size, line_height, green, whole from r"""


def markup_runs(spark, d):  # P33, W8, S6
    _, runs, said = svg.hierarchy(_styled(spark, d))
    rows = runs.select("doc_id", F.lit("run").alias("kind"), F.col("run_start").cast("long").alias("first"), F.col("run_end").cast("long").alias("last"), F.col("font_style").alias("label"))
    items = said.select("doc_id", F.col("code").alias("kind"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.coalesce("node_name", "message").alias("label"))
    return rows.unionByName(items).select(key("s_suppkey"), "kind", "first", "last", "label")


MARKUP_RUNS = """
select s_suppkey, 'run' as kind, 0 as first, length(s_name) as last, 'Regular' as label from supplier
union all select s_suppkey, 'run', length(s_name) + 1, length(s_name) + 4, 'Regular' from supplier
union all select s_suppkey, 'SVG_EMPTY_GROUP_OMITTED', null, null, 'nothing' from supplier
union all select s_suppkey, 'SVG_HIERARCHY_IMPORT', null, null, '3 nodes imported' from supplier"""


def _zipped(parts: DataFrame) -> DataFrame:
    """doc_id, content: a ZIP package of each row's map of names to texts."""

    def run(batches):
        for b in batches:
            for doc, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for name, text in entries:
                        z.writestr(name, text)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.string()), "content": pa.array([out.getvalue()], pa.binary())})

    return parts.mapInArrow(run, "doc_id string, content binary")


NS = 'xmlns:p="p" xmlns:a="a" xmlns:r="r"'


def _shape(name: str, x, y: int, inside: str = "", body=()) -> list:
    return [f'<p:sp><p:nvSpPr><p:cNvPr name="{name}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="', x, f'" y="{y}"/><a:ext cx="952500" cy="952500"/></a:xfrm>{inside}</p:spPr>', *body, "</p:sp>"]


def _decks(spark, d) -> DataFrame:
    run = lambda props, text: [f"<p:txBody><a:p><a:r>{props}<a:t>", text, "</a:t></a:r></a:p></p:txBody>"]
    pic = lambda name, rel: f'<p:pic><p:nvPicPr><p:cNvPr name="{name}"/></p:nvPicPr><p:blipFill><a:blip r:embed="{rel}"/></p:blipFill><p:spPr/></p:pic>'
    slide = text_of(
        f"<p:sld {NS}><p:cSld><p:spTree>",
        *_shape("Title", F.col("s_suppkey") * 9525, 95250, "<a:noFill/>", run('<a:rPr sz="2400" b="1"/>', F.col("s_name"))),
        *_shape("Box", "0", 19050, '<a:prstGeom prst="ellipse"/><a:solidFill><a:schemeClr val="accent1"><a:alpha val="50000"/></a:schemeClr></a:solidFill><a:ln w="19050"/>', run("", "t")),
        '<p:grpSp><p:nvGrpSpPr><p:cNvPr name="Band"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="1905000" cy="1905000"/><a:chOff x="95250" y="0"/><a:chExt cx="952500" cy="952500"/></a:xfrm></p:grpSpPr>',
        *_shape("Kid", "190500", 95250, '<a:prstGeom prst="hexagon"/>'),
        "</p:grpSp>" + pic("Pic", "rId1") + pic("Lost", "rId9"),
        '<p:graphicFrame><p:xfrm><a:off x="0" y="0"/><a:ext cx="1905000" cy="952500"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>c1</a:t></a:r></a:p></a:txBody></a:tc><a:tc/></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame></p:spTree></p:cSld></p:sld>',
    )
    blank = f"<p:sld {NS}><p:cSld><p:spTree/></p:cSld></p:sld>"
    parts = {
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldSz cx="12192000" cy="6858000"/></p:presentation>', "ppt/slides/slide10.xml": blank, "ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": blank,
        "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="rId1" Target="../media/i.png"/></Relationships>', "ppt/media/i.png": "PNG",
        "ppt/theme/theme1.xml": f'<a:theme {NS}><a:themeElements><a:clrScheme name="x"><a:accent1><a:srgbClr val="00FF00"/></a:accent1></a:clrScheme></a:themeElements></a:theme>',
    }
    return _zipped(spread(suppliers(spark, d), "s_suppkey").select("doc_id", F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in parts.items() for x in kv]).alias("parts")))


def slide_nodes(spark, d):  # S1, S10 to S14, P5 to P10, P29, P30, F5, J6, J9, M8, G11, O1
    nodes = pptx.import_packages(_decks(spark, d))[0]
    return nodes.select(key("s_suppkey"), F.regexp_extract("part", r"(\d+)", 1).cast("int").alias("slide"), "type", "name", "x", "y", "width", "height", "characters", "font_family", "font_size", "font_style", F.round("fill.g", 9).alias("green"), F.col("fill.a").alias("alpha"), "stroke_width", "point_count", "asset_ref")


_TEXT = "'{}', {}, '{}', {}, 1, null, null, null"
SLIDE_NODES = """
with s as (select s_suppkey, s_name, round(17 / 255.0::double, 9) as dark, round(34 / 255.0::double, 9) as cell from supplier), r as (
select *, 1 as slide, 'frame' as type, 'Slide 1' as name, 0.0::double as x, 0.0::double as y, 1280.0::double as width, 720.0::double as height, null::varchar as characters, null::varchar as font_family, null::double as font_size, null::varchar as font_style, 1.0::double as green, 1.0::double as alpha, null::double as stroke_width, null::integer as point_count, null::varchar as asset_ref from s
union all select *, 2, 'frame', 'Slide 2', 0, 0, 1280, 720, null, null, null, null, 1, 1, null, null, null from s
union all select *, 10, 'frame', 'Slide 3', 0, 0, 1280, 720, null, null, null, null, 1, 1, null, null, null from s
union all select *, 1, 'text', 'Title Text', s_suppkey, 10, 100, 100, s_name, 'Arial', 24, 'Bold', dark, 1, null, null, null from s
union all select *, 1, 'group', 'Box', 0, 2, 100, 100, null, null, null, null, null, null, null, null, null from s
union all select *, 1, 'ellipse', 'Box', 0, 0, 100, 100, null, null, null, null, 1, 0.5, 2, 3, null from s
union all select *, 1, 'text', 'Box Text', 0, 0, 100, 100, 't', 'Arial', 18, 'Regular', dark, 1, null, null, null from s
union all select *, 1, 'group', 'Band', 0, 0, 200, 200, null, null, null, null, null, null, null, null, null from s
union all select *, 1, 'polygon', 'Kid', 20, 20, 200, 200, null, null, null, null, null, null, null, 6, null from s
union all select *, 1, 'image', 'Pic', 0, 0, 1, 1, null, null, null, null, null, null, null, null, 'ppt/media/i.png' from s
union all select *, 1, 'group', 'Table', 0, 0, 200, 100, null, null, null, null, null, null, null, null, null from s
union all select *, 1, 'rectangle', 'Cell 1.1', 0, 0, 100, 100, null, null, null, null, 1, 1, 1, null, null from s
union all select *, 1, 'rectangle', 'Cell 1.2', 100, 0, 100, 100, null, null, null, null, 1, 1, 1, null, null from s
union all select *, 1, 'text', 'Cell 1.1 Text', 6, 4, 88, 92, 'c1', 'Arial', 18, 'Regular', cell, 1, null, null, null from s)
select s_suppkey, slide, type, name, x, y, width, height, characters, font_family, font_size, font_style, green, alpha, stroke_width, point_count, asset_ref from r"""


def slide_report(spark, d):  # J6, F2, 2.13
    _, assets, items = pptx.import_packages(_decks(spark, d))
    rows = items.select("doc_id", "level", "code", F.coalesce("node_name", "message").alias("label"))
    rows = rows.unionByName(assets.select("doc_id", F.lit("asset").alias("level"), F.col("mime").alias("code"), F.concat_ws("=", "name", F.decode("data", "UTF-8")).alias("label")))
    return rows.select(key("s_suppkey"), "level", "code", "label")


SLIDE_REPORT = """
select s_suppkey, 'info' as level, 'PPTX_IMPORT' as code, '14 nodes imported' as label from supplier union all select s_suppkey, 'warning', 'PPTX_IMPORT', 'Lost' from supplier
union all select s_suppkey, 'asset', 'image/png', 'i.png=PNG' from supplier"""


def xml_elements(spark, d):  # S10, S11
    c = T(spark, d, "conversations")
    text = text_of('<a:t xmlns:a="a" a:n="', F.col("turn"), '"><a:x>', F.col("role"), "</a:x><b/><a:x><c k='1'>z</c></a:x></a:t>")
    parts = c.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.lit("p").alias("part"), F.encode(text, "UTF-8").alias("content"))
    return xml_shred.shred(parts).select("doc_id", "elem_id", "parent_id", "ord", "depth", "tag", F.coalesce(F.col("attrs")["n"], F.col("attrs")["k"]).alias("attr"), "text", "content")


XML_ELEMENTS = """
with c as (select conv_id || '-' || turn as doc_id, cast(turn as varchar) as n, role from conversations)
select doc_id, 0 as elem_id, null::integer as parent_id, 0 as ord, 0 as depth, 't' as tag, n as attr, null::varchar as text, role || 'z' as content from c union all select doc_id, 1, 0, 0, 1, 'x', null, role, role from c
union all select doc_id, 2, 0, 1, 1, 'b', null, null, '' from c union all select doc_id, 3, 0, 2, 1, 'x', null, null, 'z' from c union all select doc_id, 4, 3, 0, 2, 'c', '1', 'z', 'z' from c"""


def expanded_files(spark, d):  # S15, S16, O2
    entries = {"a/x10.svg": "<svg/>", "a/x2.PDF": "%PDF-", "readme.txt": "no"}
    zips = _zipped(suppliers(spark, d).select("doc_id", F.create_map(*[F.lit(x) for kv in entries.items() for x in kv]).alias("parts"))).withColumn("name", F.concat("doc_id", F.lit(".ZIP")))
    plain = suppliers(spark, d).select(F.concat(F.lit("f"), "doc_id").alias("doc_id"), text_of(F.col("s_name"), ".psd").alias("name"), F.encode("s_name", "UTF-8").alias("content"))
    return packages.expand(zips.unionByName(plain)).select("doc_id", "name", "format", F.octet_length("content").alias("bytes"))


EXPANDED_FILES = """
select s_suppkey || '!a/x10.svg' as doc_id, 'x10.svg' as name, 'ai' as format, 6 as bytes from supplier union all select s_suppkey || '!a/x2.PDF', 'x2.PDF', 'ai', 5 from supplier
union all select 'f' || s_suppkey, s_name || '.psd', 'psd', length(s_name) from supplier"""

LAYER = {
    "layer_id": "string", "parent_id": "string", "ord": "int", "name": "string", "left": "double", "top": "double", "right": "double", "bottom": "double", "opacity": "double", "hidden": "boolean", "blend_mode": "string", "clipping": "boolean", "adjustment": ADJUSTMENT, "has_pixels": "boolean", "mask_on": "boolean", "mask_density": "double", "mask_feather": "double", "vector_mask_on": "boolean", "vector_mask_density": "double", "vector_mask_feather": "double",
    "text": "struct<characters:string,font:string,size:double,justification:string,r:double,g:double,b:double,a:double>",
}


def _layers(spark, d) -> DataFrame:
    c = spread(T(spark, d, "customer"), "c_custkey").withColumn("doc_id", F.col("c_custkey").cast("string"))
    at = F.col("c_nationkey").cast("double")
    bright = F.from_json(F.to_json(F.struct(F.lit("brightness/contrast").alias("type"), F.lit(75.0).alias("brightness"), F.lit(True).alias("legacy"))), ADJUSTMENT)
    box = {"left": at, "top": 20.0, "right": at + 30, "bottom": 60.0, "opacity": 51.0, "has_pixels": True, "blend_mode": "multiply"}
    say = F.struct(F.col("c_name").alias("characters"), F.lit(None).cast("string").alias("font"), F.lit(12.0).alias("size"), F.lit("CENTER_x").alias("justification"), F.lit(255.0).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("a"))
    rows = [
        box | {"layer_id": "a", "ord": 0, "name": "Glow", "adjustment": bright}, box | {"layer_id": "x", "ord": 1, "name": F.col("c_mktsegment")}, box | {"layer_id": "g", "ord": 2, "right": None, "bottom": None, "opacity": None},
        box | {"layer_id": "in", "parent_id": "g", "ord": 0, "left": at + 5, "name": "Inner"}, box | {"layer_id": "off", "parent_id": "g", "ord": 1, "left": -500.0, "hidden": True, "name": "Off"}, box | {"layer_id": "t", "parent_id": "g", "ord": 2, "text": say},
        box | {"layer_id": "m", "ord": 3, "name": "Masked", "mask_on": True, "mask_density": 0.25, "mask_feather": 3.0}, box | {"layer_id": "e", "ord": 4, "name": "Void", "has_pixels": False}, box | {"layer_id": "i", "ord": 5, "name": "Idle", "adjustment": bright, "vector_mask_on": True, "vector_mask_density": 0.75},
    ]
    return made(c, LAYER, rows)


def layer_nodes(spark, d):  # S2, P21 to P24, P31, G4, W11, M12, X8, F27
    nodes = psd.import_layers(_layers(spark, d))[0]
    return nodes.select(key("c_custkey"), "node_id", "parent_id", "type", "name", "x", "y", "width", "height", F.round("opacity", 9).alias("opacity"), "visible", F.try_element_at("filters", F.lit("exposure")).alias("exposure"), "characters", "align", F.col("fill.r").alias("red"), "is_mask", "blur")


LAYER_NODES = """
with c as (select c_custkey, c_name, c_mktsegment, c_nationkey::double as n from customer), r as (
select *, 'a' as node_id, null::varchar as parent_id, 'image' as type, 'Glow' as name, 0.0::double as x, 0.0::double as y, 30.0::double as width, 40.0::double as height, 0.2::double as opacity, true as visible, 0.5::double as exposure, null::varchar as characters, null::varchar as align, null::double as red, false as is_mask, null::double as blur from c
union all select *, 'x', null, 'image', c_mktsegment, n, 20, 30, 40, 0.2, true, 0.5, null, null, null, false, null from c
union all select *, 'g', null, 'group', 'Group', n, 20, 30, 40, 1, true, null, null, null, null, false, null from c
union all select *, 'in', 'g', 'image', 'Inner', 5, 0, 25, 40, 0.2, true, 0.5, null, null, null, false, null from c
union all select *, 'off', 'g', 'image', 'Off', -500 - n, 0, n + 530, 40, 0.2, false, 0.5, null, null, null, false, null from c
union all select *, 't', 'g', 'text', 'Text', 0, 0, 30, 40, 0.2, true, null, c_name, 'center', 1, false, null from c
union all select *, 'm', null, 'group', 'Masked', n, 20, 30, 40, 0.2, true, null, null, null, null, false, null from c
union all select *, 'm:content', 'm', 'image', 'Masked content', 0, 0, 30, 40, 1, true, 0.5, null, null, null, false, null from c
union all select *, 'm:mask', 'm', 'image', 'Masked mask', 0, 0, 30, 40, 0.25, true, null, null, null, null, true, 3 from c
union all select *, 'i', null, 'group', 'Idle', 0, 0, 30, 40, 0.2, true, null, null, null, null, false, null from c
union all select *, 'i:content', 'i', 'image', 'Idle content', 0, 0, 30, 40, 1, true, 0.5, null, null, null, false, null from c
union all select *, 'i:vector-mask', 'i', 'image', 'Idle vector mask', 0, 0, 30, 40, 0.75, true, null, null, null, null, true, null from c)
select c_custkey, node_id, parent_id, type, name, x, y, width, height, opacity, visible, exposure, characters, align, red, is_mask, blur from r"""


def layer_report(spark, d):  # P37, 2.13
    return psd.import_layers(_layers(spark, d))[1].select(key("c_custkey"), "level", "code", F.when(F.col("code").startswith("PSD_ADJ"), F.col("message")).alias("message"), "node_name")


LAYER_REPORT = """
with c as (select c_custkey, c_mktsegment from customer), r as (
select *, 'info' as level, 'PSD_IMPORT' as code, null::varchar as message, null::varchar as node_name from c
union all select *, 'info', 'PSD_ADJUSTMENT_NATIVE', 'brightness→exposure, contrast', 'Glow' from c union all select *, 'fallback', 'PSD_ADJUSTMENT_PARTIAL', 'legacy/Lab/auto mode', 'Glow' from c
union all select *, 'fallback', 'PSD_RASTER_LAYER', null, c_mktsegment from c union all select *, 'fallback', 'PSD_RASTER_LAYER', null, 'Inner' from c union all select *, 'fallback', 'PSD_RASTER_LAYER', null, 'Off' from c
union all select *, 'fallback', 'PSD_RASTER_LAYER', null, 'Masked' from c union all select *, 'info', 'PSD_PIXEL_MASK_NATIVE', null, 'Masked' from c
union all select *, 'info', 'PSD_ADJUSTMENT_NATIVE', 'brightness→exposure, contrast', 'Idle' from c union all select *, 'fallback', 'PSD_ADJUSTMENT_PARTIAL', 'legacy/Lab/auto mode', 'Idle' from c
union all select *, 'info', 'PSD_VECTOR_MASK_NATIVE', null, 'Idle' from c union all select *, 'info', 'PSD_MASKED_ADJUSTMENT_NATIVE', null, 'Idle' from c union all select *, 'warning', 'PSD_MASKED_ADJUSTMENT_EMPTY', null, 'Idle' from c
union all select *, 'warning', 'PSD_EMPTY_LAYER', null, 'Void' from c union all select *, 'warning', 'PSD_ADJUSTMENT_NON_IMAGE_TARGET', 'image filters don''t apply to text', null from c)
select c_custkey, level, code, message, node_name from r"""

OP = {"idx": "long", "op": "string", "tag": "string", "group_id": "string", "args": "string", "deps": "array<string>", "page_w": "double", "page_h": "double"}
ITEM = {"idx": "long", "kind": "string", "text": "string", "x": "double", "y": "double", "width": "double", "height": "double", "font": "string", "has_eol": "boolean"}


def _pages(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = suppliers(spark, d)
    mark = {"op": "beginMarkedContentProps", "tag": "OC"}
    rect = F.format_string('[["rectangle"], [0, 0, %d, 5]]', F.col("s_nationkey") + 1)
    log = [mark | {"group_id": "a"}, {"op": "constructPath", "args": rect}, {"op": "fill"}, {"op": "endMarkedContent"}, mark | {"group_id": "b"}, {"op": "beginText"}, {"op": "showText"}, {"op": "endText"}, {"op": "endMarkedContent"}, mark | {"group_id": "c"}, {"op": "endMarkedContent"}, mark | {"group_id": "x"}, {"op": "setLineWidth", "args": '["bad"]'}, {"op": "endMarkedContent"}]
    ops = made(s, OP, [r | {"idx": i, "page_w": 100.0, "page_h": 50.0} for i, r in enumerate(log)])
    groups = made(s, {"group_id": "string", "name": "string", "visible": "boolean"}, [{"group_id": "a", "name": "Art", "visible": True}, {"group_id": "b", "name": F.col("s_name"), "visible": True}, {"group_id": "c", "name": "BG Color", "visible": False}])
    items = made(s, ITEM, [{"idx": 0, "kind": "open"}, {"idx": 1, "kind": "close"}, {"idx": 2, "kind": "open"}, {"idx": 3, "kind": "text", "text": F.col("s_name"), "x": 10.0, "y": 20.0, "width": 30.0, "height": 12.0, "font": "ABCDEF+Some-Bold", "has_eol": False}])
    return ops, groups, items


def page_nodes(spark, d):  # S7, P15, P25, P36, J1, J2, J15, W5b, W10, F11, F12, M25, M26, M30, M32, O9
    nodes = page_logs.import_pages(*_pages(spark, d))[0]
    return nodes.select(key("s_suppkey"), "node_id", "parent_id", "ord", "type", "name", "x", "y", "width", "height", "visible", "locked", "markup", "characters", "font_family", "font_style", "font_size", "align")


PAGE_NODES = f"""
with s as (select s_suppkey, s_name, s_nationkey + 1 as n, s_suppkey || '/' as k from supplier), r as (
select *, k || 'a' as node_id, '' || s_suppkey as parent_id, 0 as ord, 'group' as type, 'Art' as name, 0.0::double as x, 0.0::double as y, 100.0::double as width, 50.0::double as height, true as visible, false as locked, null::varchar as markup, null::varchar as characters, null::varchar as font_family, null::varchar as font_style, null::double as font_size, null::varchar as align from s
union all select *, k || 'b', '' || s_suppkey, 1, 'group', s_name, 0, 0, 100, 50, true, false, null, null, null, null, null, null from s
union all select *, k || 'c', '' || s_suppkey, 2, 'frame', 'BG Color', 0, 0, 100, 50, false, true, null, null, null, null, null, null from s
union all select *, k || 'x', '' || s_suppkey, 3, 'frame', 'x', 0, 0, 100, 50, true, false, null, null, null, null, null, null from s
union all select *, k || 'a/svg', k || 'a', 0, 'svg', 'a', 0, 0, 100, 50, null, null, '{SVG} width="100" height="50"><path d="M 0 0 L ' || n || ' 0 L ' || n || ' 5 L 0 5 Z" fill="#000000" fill-opacity="1"/></svg>', null, null, null, null, null from s
union all select *, k || 'b/1', k || 'b', 1, 'text', s_name, 10, 18, 30, 12, null, null, null, s_name, 'Some-Bold', 'Bold', 12, 'left' from s)
select s_suppkey, node_id, parent_id, ord, type, name, x, y, width, height, visible, locked, markup, characters, font_family, font_style, font_size, align from r"""


def page_report(spark, d):  # S9, 2.13
    return page_logs.import_pages(*_pages(spark, d))[1].select(key("s_suppkey"), "level", "code", "node_name")


PAGE_REPORT = """
select s_suppkey, 'warning' as level, 'AI_PDF_VECTOR_LAYER_FAILED' as code, 'x' as node_name from supplier union all select s_suppkey, 'info', 'AI_EMPTY_LAYER_PRESERVED', 'BG Color' from supplier
union all select s_suppkey, 'info', 'AI_EMPTY_LAYER_PRESERVED', 'x' from supplier union all select s_suppkey, 'info', 'AI_PDF_HIERARCHY_IMPORT', null from supplier"""


def raster_pages(spark, d):  # S8, S9, P14
    """Pages of odd parts have a layer; the others are kept as tiles, and reported."""
    rows = [{"idx": 0, "op": F.when(F.col("p_partkey") % 2 == 1, "beginMarkedContentProps").otherwise("save"), "tag": "OC", "page_w": F.col("p_size") * 100.0 + 0.25, "page_h": 90.0}]
    tiles, items = page_logs.raster_fallback(made(parts_of(spark, d), OP, rows))
    return tiles.join(items, "doc_id").select(key("p_partkey"), "tile", "x", "y", "width", "height", "level", "code")


RASTER_PAGES = """
with p as (select p_partkey, p_size * 200 + 1 as w from part where p_partkey % 2 = 0), t as (select *, unnest(range(0, w, 4096)) as x from p)
select p_partkey, x // 4096 as tile, x, 0 as y, least(4096, w - x) as width, 180 as height, 'fallback' as level, 'AI_PDF_FALLBACK' as code from t"""

STATE = {"idx": "long", "op": "string", "fill": "string", "blend": "string", "alpha": "double", "smask": "boolean", "soft_mask": "boolean"}


def _states(spark, d) -> DataFrame:
    a = F.col("p_size") / 100
    log = [{"op": "setGState", "alpha": a, "blend": "multiply"}, {"op": "save"}, {"op": "setFillRGBColor", "fill": F.col("p_name")}, {"op": "setGState", "alpha": 0.5, "blend": "screen"}, {"op": "paintImageXObject"}, {"op": "showText"}, {"op": "restore"}, {"op": "showSpacedText"}, {"op": "beginGroup", "soft_mask": True}, {"op": "paintImageMaskXObject"}, {"op": "endGroup"}]
    return made(parts_of(spark, d), STATE, [r | {"idx": i} for i, r in enumerate(log)])


def text_states(spark, d):  # W9
    return pdf.text_styles(_states(spark, d)).select(key("p_partkey"), "k", "fill", "opacity", "blend")


TEXT_STATES = "select p_partkey, 0 as k, p_name as fill, 0.5::double as opacity, 'screen' as blend from part union all select p_partkey, 1, '#000000', p_size / 100.0::double, 'multiply' from part"


def image_states(spark, d):  # W2, W3, J3, J5, U3, X4
    """Segments of a log, the style of each, and what is said of it."""
    ops = cut(spread(_states(spark, d), "doc_id")).withColumn("is_image", F.col("op").startswith("paintImage"))
    styles = cut(pdf.image_styles(ops, intervals.image_segments(ops)))
    put = pixels.compositing_placement(F.col("blend_mode"), F.col("opacity"), F.col("has_soft_mask"), F.col("opacity_baked"))
    rows = styles.withColumn("p", put).join(pdf.image_items(styles).select("doc_id", "start", "code"), ["doc_id", "start"], "left")
    return rows.select(key("p_partkey"), "start", "end", "blend_mode", "opacity", "has_soft_mask", "opacity_baked", "p.image_blend", "p.group_blend", "code")


IMAGE_STATES = """
select p_partkey, 1 as start, 6 as "end", 'multiply' as blend_mode, p_size / 100.0::double as opacity, false as has_soft_mask, false as opacity_baked, 'multiply' as image_blend, null::varchar as group_blend, 'PDF_IMAGE_COMPOSITING_PRESERVED' as code from part
union all select p_partkey, 8, 10, 'multiply', p_size / 100.0::double, true, false, 'normal', 'multiply', 'PDF_SOFT_MASK_EFFECT_PRESERVED' from part"""


def path_strings(spark, d):  # W12, M23, M25, F20
    s, n = F.col("p_size").cast("double"), F.col("p_partkey").cast("double")
    z = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v])
    p = pdf.convert_path(z(0, 0, n, 1, s, 0.5, 3, s + 3, 0.5, s + 3, 6.5, 2, 1, 2, 3, 4, 5, n, 4))
    return parts_of(spark, d).select(key("p_partkey"), F.array_join(p["ops"], ",").alias("ops"), pdf.path_string(p["ops"], p["args"]).alias("d"), pdf.path_string(F.array(F.lit("rectangle")), z(1, 2, s, 4)).alias("box"))


PATH_STRINGS = """
select p_partkey, 'moveTo,lineTo,curveTo,curveTo,closePath' as ops, 'M 0 ' || p_partkey || ' L ' || p_size || ' 0.5 C ' || (p_size + 2) || ' 0.5 ' || (p_size + 3) || ' 2.5 ' || (p_size + 3) || ' 6.5 C 1 2 3 4 5 ' || p_partkey || ' Z' as d,
'M 1 2 L ' || (1 + p_size) || ' 2 L ' || (1 + p_size) || ' 6 L 1 6 Z' as box from part"""


def vector_log(spark, d):  # P15, P16, W10
    rows = [{"op": "restore"}, {"op": "beginText"}, {"op": "showText"}, {"op": "endText"}, {"op": "save"}, {"op": "dependency", "deps": F.array(F.lit("img_1"))}, {"op": "dependency", "deps": F.array(F.lit("img_1"), F.lit("font"))}, {"op": "paintImageXObject"}, {"op": F.when(F.col("p_partkey") % 2 == 0, "eoFill").otherwise("clip")}]
    ops = made(parts_of(spark, d), OP, [r | {"idx": i} for i, r in enumerate(rows)])
    v = pdf.vector_ops(ops)
    out = v.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "op"))), lambda x: x["op"]), ",").alias("ops"))
    return out.join(pdf.missing_restores(v), "doc_id").join(pdf.has_paint(v), "doc_id").select(key("p_partkey"), "ops", F.col("missing").cast("int").alias("missing"), "paints")


VECTOR_LOG = "select p_partkey, 'save,dependency,' || case when p_partkey % 2 = 0 then 'eoFill' else 'clip' end as ops, 1 as missing, p_partkey % 2 = 0 as paints from part"


def drawn_pages(spark, d):  # W13, F21, F22, M2, M26 to M32, G12
    j = lambda v: json.dumps(v)
    scale = F.format_string("[%d, 0, 0, 2, 5, 5]", F.col("p_size"))
    shade = j([{"kind": "axial", "at": [0, 0, 1, 0], "stops": [[0, "#fff"]]}])
    log = [("save", None), ("transform", scale), ("setFillRGBColor", "[1, 0, 0]"), ("constructPath", j([["rectangle"], [0, 0, 10, 20]])), ("eoClip", None), ("endPath", None), ("constructPath", j([["moveTo", "curveTo2"], [0, 0, 1, 1, 2, 2.5]])), ("setGState", j([[["ca", 0.5], ["BM", "multiply"], ["LW", 3], ["LC", 1], ["D", [[2, 1], 0]]]])), ("closeFillStroke", None), ("restore", None), ("shadingFill", shade)]
    ops = made(parts_of(spark, d), OP, [{"idx": i, "op": o, "args": a, "page_w": 100.0, "page_h": 50.0} for i, (o, a) in enumerate(log)])
    return pdf_svg.layer_markup(ops).select(key("p_partkey"), "markup", "error")


DRAWN_PAGES = f"""
select p_partkey, '{SVG} width="100" height="50"><defs><clipPath id="clip-0"><path d="M 0 0 L 10 0 L 10 20 L 0 20 Z" clip-rule="evenodd" transform="matrix(' || p_size || ' 0 0 2 5 5)"/></clipPath><linearGradient id="shade-1" gradientUnits="userSpaceOnUse" x1="0" y1="0" x2="1" y2="0"><stop offset="0" stop-color="#fff"/></linearGradient></defs><g clip-path="url(#clip-0)"><path d="M 0 0 C 0 0 1 1 2 2.5 Z" fill="#ff0000" fill-opacity="0.5" stroke="#000000" stroke-opacity="1" stroke-width="3" stroke-linecap="round" transform="matrix(' || p_size || ' 0 0 2 5 5)" style="mix-blend-mode:multiply"/></g><rect x="0" y="0" width="100" height="50" fill="url(#shade-1)" fill-opacity="1"/></svg>' as markup, null::varchar as error from part"""


def gradient_pages(spark, d):  # M17, M18, J19
    s = {"op": "string", "idx": "long", "matrix": "array<double>", "page_w": "double", "page_h": "double", "kind": "string", "p0": "array<double>", "p1": "array<double>", "stops": "array<struct<offset:double,color:string>>"}
    z = lambda *v: F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v])
    stops = F.array(F.struct(F.lit(0.0).alias("offset"), F.col("p_name").alias("color")))
    rows = [{"op": "save"}, {"op": "transform", "matrix": z(2, 0, 0, 2, F.col("p_size"), 0)}, {"op": F.when(F.col("p_partkey") % 3 == 0, "fill").otherwise("clip")}, {"op": "shadingFill", "kind": "axial", "p0": z(0, 0), "p1": z(16, 8), "stops": stops}]
    g = pdf.gradient_fills(made(parts_of(spark, d), s, [r | {"idx": i, "page_w": 128.0, "page_h": 64.0} for i, r in enumerate(rows)]))
    seg = {"kind": "string", "start": "long", "end": "long", "blend_mode": "string", "has_soft_mask": "boolean"}
    back = [{"kind": "gradient", "start": F.col("p_size"), "end": 60}, {"kind": "gradient", "start": 70, "end": 71}, {"kind": "image", "start": 25, "end": 30, "blend_mode": "hard-light", "has_soft_mask": True}, {"kind": "image", "start": 1, "end": 3, "blend_mode": "screen", "has_soft_mask": True}]
    pairs = pdf.backdrop_pairs(made(parts_of(spark, d), seg, back)).select("doc_id", F.col("background.start").alias("background"), F.col("mask.start").alias("mask"))
    paints = F.when(F.col("stops").isNotNull(), pdf.gradient_paints(F.col("stops")))
    return g.join(pairs, "doc_id", "full").select(key("p_partkey"), "x0", "y0", "x1", "y1", F.concat_ws(",", F.transform(paints, lambda p: p["type"])).alias("paints"), F.get(paints, F.lit(1))["color"].alias("beneath"), "background", "mask")


GRADIENT_PAGES = """
with p as (select p_partkey, p_name, p_size, p_partkey % 3 <> 0 as g, p_size < 25 as b from part)
select p_partkey, case when g then p_size / 128.0::double end as x0, case when g then 1.0::double end as y0, case when g then (32 + p_size) / 128.0::double end as x1, case when g then 0.75::double end as y1,
case when g then 'gradient,solid' else '' end as paints, case when g then p_name end as beneath, case when b then p_size end as background, case when b then 25 end as mask from p where g or b"""


def layer_texts(spark, d):  # J15
    rows = [{"idx": 0, "kind": "text", "text": "before"}, {"idx": 1, "kind": "open"}, {"idx": 2, "kind": "text", "text": F.col("p_name")}, {"idx": 3, "kind": "close"}, {"idx": 4, "kind": "text", "text": "between"}, {"idx": 5, "kind": "open"}, {"idx": 6, "kind": "text", "text": ""}, {"idx": 7, "kind": "text", "text": F.col("p_type")}]
    layers = made(parts_of(spark, d), {"k": "long", "layer_id": "string"}, [{"k": 0, "layer_id": "first"}, {"k": 1, "layer_id": F.col("p_brand")}])
    return intervals.text_by_layer(made(parts_of(spark, d), ITEM, rows), layers).select(key("p_partkey"), "idx", "text", "layer_id")


LAYER_TEXTS = "select p_partkey, 2 as idx, p_name as text, 'first' as layer_id from part union all select p_partkey, 7, p_type, p_brand from part"


def text_blocks(spark, d):  # W5b, W5 to W8, G9, G10, P35
    s = {"k": "long", "str": "string", "x": "double", "y": "double", "width": "double", "height": "double", "font": "string", "has_eol": "boolean"}
    w = F.col("p_size").cast("double") + 20
    rows = [{"str": F.col("p_name"), "x": 10.0, "y": 100.0, "width": w, "height": 10.0, "has_eol": True}, {"str": F.col("p_type"), "x": 10.0, "y": 88.0, "width": 20.0, "height": 10.0, "has_eol": False}]
    blocks, runs = pdf.text_blocks(made(parts_of(spark, d), s, [r | {"k": i, "font": "ABCDEF+Sans-Bold"} for i, r in enumerate(rows)]), F.lit(200.0))
    return blocks.join(runs.select("doc_id", "block", "k", "run_start", "run_end", "line_height"), ["doc_id", "block"]).select(key("p_partkey"), "k", "run_start", "run_end", "line_height", "characters", "x", "y", "width", "height", "family", "style", "size", "alignment")


TEXT_BLOCKS = """
with p as (select p_partkey, length(p_name) as n, length(p_type) as m, p_name || chr(10) || p_type as t, p_size + 20.0::double as w from part), r as (select *, 0 as k, 0 as run_start, n + 1 as run_end from p union all select *, 1, n + 1, n + 1 + m from p)
select p_partkey, k, run_start, run_end, 12.0::double as line_height, t as characters, 10.0::double as x, 90.0::double as y, w as width, 22.0::double as height, 'Sans-Bold' as family, 'Bold' as style, 10.0::double as size, 'left' as alignment from r"""


def name_rules(spark, d):  # F3, F4, F5, F9 to F12, F14, F16, F20, F23, F27, S3, O9
    c, n = F.col, F.col("p_name")
    run = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    para = F.array(F.struct(F.array(n, F.lit("!")).alias("runs"), run("x").alias("fields")), F.struct(run().alias("runs"), F.array(c("p_type")).alias("fields")))
    old = text_of('<svg:svg xmlns:svg="http://www.w3.org/2000/svg" width="', c("p_size"), '"><svg:g/></svg:svg>')
    v = c("p_size") / 8
    return parts_of(spark, d).select(
        key("p_partkey"), F.decode(strings.data_url_bytes(F.concat(F.lit("data:x;base64,"), F.base64(F.encode(n, "UTF-8")))), "UTF-8").alias("data"), strings.collect_text(para).alias("text"), strings.local_tag(F.concat(F.lit("Svg:"), c("p_type"))).alias("tag"), strings.base_name(F.concat(n, F.lit(".AI"))).alias("base"),
        strings.pdf_font_family(F.concat(F.lit("ABCDEF+"), c("p_brand"))).alias("family"), strings.pdf_font_style(F.when(c("p_size") > 25, "x-BOLD").otherwise("x")).alias("style"), strings.svg_blend(F.when(c("p_size") > 25, "source-over").otherwise("hue")).alias("blend"),
        strings.image_layer_name(c("p_size"), F.when(c("p_size") > 25, "normal").otherwise("hue")).alias("layer"), strings.format_number(v).alias("number"), strings.svg_markup(old).alias("markup"), strings.text_align(F.when(c("p_size") > 25, "RIGHT").otherwise("justifyAll")).alias("align"),
        strings.sniff_format(F.encode(F.when(c("p_size") > 25, "%PDF-1.7").when(c("p_size") > 10, " <?xml ?><svg/>").otherwise(n), "UTF-8")).alias("kind"), strings.locked_layer(F.concat(F.lit("BG_"), F.when(c("p_size") > 25, "Mask").otherwise("x"))).alias("locked"),
    )


NAME_RULES = f"""
with p as (select *, p_size > 25 as big from part)
select p_partkey, p_name as data, p_name || '!' || chr(10) || p_type as text, lower(p_type) as tag, p_name as base, p_brand as family, case when big then 'Bold' else 'Regular' end as style, case when big then 'normal' else 'hue' end as blend,
'Image ' || printf('%02d', p_size + 1) || case when big then '' else ' · hue' end as layer, rtrim(rtrim(printf('%.3f', p_size / 8.0::double), '0'), '.') as number, '{SVG} width="' || p_size || '"><g/></svg>' as markup, case when big then 'right' else 'justified' end as align,
case when big then 'pdf' when p_size > 10 then 'svg' end as kind, big as locked from p"""


def paint_rules(spark, d):  # P5, P7, P32, X4 to X7, M12, M14 to M16, M21 to M24
    s = F.col("p_size").cast("double")
    m = geometry.matrix(0, s, -s, 0, 0, 0)
    scale = geometry.scales(m)
    paint = geometry.solid_paint(geometry.color(s / 10 - 1, F.lit(0.5), F.lit(2.0), F.when(s > 25, 0.25)), F.lit(None).cast("double"))
    strategy = pixels.opacity_strategy(F.lit(0.5), s > 25, F.lit(True))
    at = psd.image_offset(s, F.lit(None).cast("double"), s > 25, F.lit(3.0), F.lit(4.0))
    g = geometry.gradient_transform(F.lit("linear"), F.lit(0.0), F.lit(0.0), s, F.lit(0.0))
    num = lambda a: F.array_join(F.transform(a, strings.format_number), " ")
    return parts_of(spark, d).select(
        key("p_partkey"), geometry.scaled_child(s, F.lit(2.0), F.lit(0.5)).alias("child"), geometry.preset_shape(F.when(s > 25, "rightArrow").when(s > 10, "hexagon").otherwise(F.col("p_type"))).alias("shape"), geometry.font_style(F.when(s > 25, "600").otherwise("500"), F.when(s > 10, "italic").otherwise("normal")).alias("font_style"),
        strategy["normalize_alpha"].alias("normalize"), strategy["node_opacity"].alias("node_opacity"), num(pixels.to_bytes(F.array(s * 1000), "uint16").cast("array<double>")).alias("bytes"), num(pixels.numeric_array(F.array(F.col("p_size").cast("string"), F.lit("1.5")))).alias("numbers"), at["x"].alias("mask_x"), at["y"].alias("mask_y"),
        geometry.unit_opacity(s).alias("opacity"), geometry.unit_channel(F.lit(51.0)).alias("channel"), F.round(geometry.text_width(F.col("p_name"), s, F.lit(1.0)), 6).alias("text_width"), F.round(geometry.rotation(m), 6).alias("rotation"), scale["x"].alias("scale"), num(g).alias("gradient"), paint["r"].alias("red"), paint["b"].alias("blue"), paint["opacity"].alias("paint_opacity"),
        num(geometry.cubic_from_quadratic(F.lit(0.0), F.lit(0.0), s * 3, F.lit(3.0), s * 3, F.lit(0.0))).alias("cubic"), num(geometry.min_max(F.array(s, F.lit(1.0), F.lit(2.0), F.lit(3.0)))).alias("min_max"),
    )


PAINT_RULES = """
with p as (select p_partkey, p_name, p_type, p_size, p_size::double as s, p_size > 25 as big from part)
select p_partkey, (s - 2) * 0.5::double as child, case when big then 'line' when s > 10 then 'polygon' else 'rectangle' end as shape, case when big then 'Bold Italic' when s > 10 then 'Italic' else 'Regular' end as font_style,
not big as normalize, case when big then 1.0::double else 0.5::double end as node_opacity, cast(cast(floor(least(255.0::double, s * 1000 / 257) + 0.5) as integer) as varchar) as bytes, p_size || ' 1.5' as numbers, case when big then s else s - 3 end as mask_x, case when big then 0.0::double else -4.0::double end as mask_y,
case when s > 1 then s / 255 else s end as opacity, 0.2::double as channel, round(greatest(s, length(p_name) * s * 0.56::double + length(p_name) - 1), 6) as text_width, -90.0::double as rotation, s as scale, rtrim(rtrim(printf('%.8f', 1 / s), '0'), '.') || ' 0 0 ' || rtrim(rtrim(printf('%.8f', 1 / s), '0'), '.') || ' 0 0.5' as gradient,
greatest(0.0::double, least(1.0::double, s / 10 - 1)) as red, 1.0::double as blue, case when big then 0.25::double else 1.0::double end as paint_opacity, (2 * p_size) || ' 2 ' || (3 * p_size) || ' 2 ' || (3 * p_size) || ' 0' as cubic, p_size || ' 2 1 3' as min_max from p"""


def clamped_runs(spark, d):  # K3
    runs = T(spark, d, "part").select(F.lit("d").alias("doc_id"), F.col("p_partkey").alias("node_id"), (F.col("p_size") - 10).alias("run_start"), (F.col("p_size") + 5).alias("run_end"))
    texts = T(spark, d, "part").select(F.lit("d").alias("doc_id"), F.col("p_partkey").alias("node_id"), F.length("p_name").alias("length"))
    return sink.clamped_runs(runs, texts).select(F.col("node_id").alias("p_partkey"), "run_start", "run_end")


CLAMPED_RUNS = """
with r as (select p_partkey, greatest(0, least(p_size - 10, length(p_name))) as run_start, greatest(0, least(p_size + 5, length(p_name))) as run_end from part) select * from r where run_end > run_start"""


def font_aliases(spark, d):  # J12, J13
    """Families whose names match a rule, where its candidates are installed."""
    p = T(spark, d, "part")
    family = F.when(F.col("p_size") % 3 == 0, text_of("SXSGYS", F.col("p_partkey"))).when(F.col("p_size") % 3 == 1, text_of("x-BiaoXiaoZhiLongZhuTi-J-", F.col("p_partkey"))).otherwise(F.col("p_name"))
    wanted = fonts.requested(p.select(F.col("p_partkey").alias("ord"), family.alias("family"), F.lit("Bold").alias("style"), F.lit(None).cast("string").alias("base_family"), F.lit(None).cast("string").alias("base_style")))
    have = spark.createDataFrame([(0, "sxs gysj", "Regular"), (1, "Kaiti SC", "Bold"), (2, "Arial", "Regular")], "ord long, family string, style string")
    return fonts.analyze(wanted, have).select("key", "decision", "chosen_family", "chosen_style")


FONT_ALIASES = """
with f as (select distinct case p_size % 3 when 0 then 'SXSGYS' || p_partkey when 1 then 'x-BiaoXiaoZhiLongZhuTi-J-' || p_partkey else p_name end as family from part), k as (select distinct lower(family) as family from f)
select family || '::bold' as key, case when family like 'sxsgys%' then 'equivalent' when family like 'x-b%' then 'suggested' else 'fallback' end as decision, case when family like 'sxsgys%' then 'sxs gysj' when family like 'x-b%' then 'Kaiti SC' else 'Arial' end as chosen_family, case when family like 'x-b%' then 'Bold' else 'Regular' end as chosen_style from k"""



def routed_files(spark, d):  # S3, S9, S19, S15 to S18
    """Slides, both kinds of markup, an archive, decoded layers and decoded pages through one call."""
    tag = lambda df, p: df.withColumn("doc_id", F.concat(F.lit(p), "doc_id"))
    file = lambda df, p, ext: tag(df, p).select("doc_id", F.concat("doc_id", F.lit(ext)).alias("name"), F.octet_length("content").cast("long").alias("size"), "content")
    blank = lambda p, ext, head: file(suppliers(spark, d).withColumn("content", F.encode(F.lit(head), "UTF-8")), p, ext)
    zips = _zipped(spread(suppliers(spark, d), "s_suppkey").select("doc_id", F.create_map(F.lit("in/a.svg"), F.lit(SVG + ' width="9" height="9"><rect id="z" width="5" height="4"/></svg>')).alias("parts")))
    files = [file(_decks(spark, d), "deck", ".pptx"), file(_styled(spark, d), "art", ".ai"), file(zips, "zip", ".zip"), blank("log", ".pdf", "%PDF-1.7"), blank("flat", ".ai", "%PDF-1.4"), blank("img", ".PSD", "8BPS"), blank("lost", ".psd", "8BPS"), blank("no", ".txt", "text")]
    both = files[0]
    for f in files[1:]:
        both = both.unionByName(f)
    s = suppliers(spark, d)
    layers = tag(made(s, LAYER, [{"layer_id": "l", "ord": 0, "name": F.col("s_name"), "left": 1.0, "top": 2.0, "right": 4.0, "bottom": 6.0, "has_pixels": True}]), "img")
    ops, groups, items = (tag(p, "log") for p in _pages(spark, d))
    ops = ops.unionByName(tag(made(s, OP, [{"idx": 0, "op": "fill", "page_w": 10.0, "page_h": 20.0}]), "flat"))
    # made once, as files lie in a folder: their sizes are then read without their contents
    got = route.import_files(cut(both), layers, (ops, groups, items))
    nodes = got.nodes.groupBy("doc_id", "kind").agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "text").alias("texts"), F.count_if(F.col("type") == "image").alias("images"))
    codes = got.report.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    assets = got.assets.groupBy("doc_id").agg(F.count("*").alias("assets"))
    rows = nodes.join(codes, "doc_id", "left").join(assets, "doc_id", "left").select("doc_id", "kind", "nodes", "texts", "images", "codes", F.coalesce("assets", F.lit(0)).alias("assets"))
    left = got.undecoded.select("doc_id", "kind", *[F.lit(0).cast("long").alias(c) for c in ("nodes", "texts", "images")], F.lit(None).cast("string").alias("codes"), F.lit(0).cast("long").alias("assets"))
    return rows.unionByName(left)


ROUTED_FILES = """
select 'deck' || s_suppkey as doc_id, 'pptx' as kind, 14 as nodes, 3 as texts, 1 as images, 'PPTX_IMPORT' as codes, 1 as assets from supplier
union all select 'art' || s_suppkey, 'svg', 3, 1, 0, 'SVG_EMPTY_GROUP_OMITTED,SVG_HIERARCHY_IMPORT', 0 from supplier union all select 'zip' || s_suppkey || '!in/a.svg', 'svg', 1, 0, 0, 'SVG_VECTOR_IMPORT', 0 from supplier
union all select 'log' || s_suppkey, 'pdf', 6, 1, 0, 'AI_EMPTY_LAYER_PRESERVED,AI_PDF_HIERARCHY_IMPORT,AI_PDF_VECTOR_LAYER_FAILED', 0 from supplier union all select 'flat' || s_suppkey, 'pdf', 1, 0, 1, 'AI_PDF_FALLBACK', 0 from supplier
union all select 'img' || s_suppkey, 'psd', 1, 0, 1, 'PSD_IMPORT,PSD_RASTER_LAYER', 0 from supplier union all select 'lost' || s_suppkey, 'psd', 0, 0, 0, null, 0 from supplier"""


def sink_images(spark, d):  # J7, K2, K5
    p = T(spark, d, "part")
    nodes = p.select(F.lit("d").alias("doc_id"), F.col("p_partkey").cast("string").alias("node_id"), F.when(F.col("p_size") % 2 == 0, "image").otherwise("vector").alias("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("asset_ref"), F.when(F.col("p_size") % 3 == 0, "evenodd").alias("winding"))
    assets = p.filter("p_size > 25").select(F.lit("d").alias("doc_id"), F.col("p_brand").alias("asset_id"), F.lit("image/png").alias("mime"), F.encode("p_brand", "UTF-8").alias("data"))
    return sink.with_images(sink.sink_view(nodes), assets).select(F.col("node_id").cast("long").alias("p_partkey"), "type", "winding", F.decode("image.data", "UTF-8").alias("data"))


SINK_IMAGES = """
select p_partkey, case when p_size % 2 = 0 then 'RECTANGLE' else 'VECTOR' end as type, case when p_size % 2 = 1 then case when p_size % 3 = 0 then 'EVENODD' else 'NONZERO' end end as winding,
case when p_size % 2 = 0 and p_brand in (select p_brand from part where p_size > 25) then p_brand end as data from part"""


def font_list(spark, d):  # S20, O3
    """Listed names are ASCII here, so that their order is that of their lower case."""
    p = T(spark, d, "part")
    have = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lower("p_brand")).alias("family"), F.initcap("p_type").alias("style"))
    ordered_ = fonts.listed(have).agg(F.collect_list(F.struct("family", "style")).alias("f"))
    return ordered_.select(F.posexplode("f").alias("place", "f")).select("place", "f.family", "f.style")


FONT_LIST = """
with h as (select p_partkey, lower(p_brand) as fk, p_type as sk, case when p_size % 2 = 0 then p_brand else lower(p_brand) end as family, upper(p_type[1]) || lower(p_type[2:]) as style from part),
l as (select fk, sk, arg_max(family, p_partkey) as family, any_value(style) as style from h group by 1, 2) select cast(row_number() over (order by fk, case when family = fk then 0 else 1 end, sk) - 1 as integer) as place, family, style from l"""


def argument_guards(spark, d):  # P17, P34, P38
    p = F.col("p_partkey") % 3
    args = F.when(p == 0, text_of('[[["LW", ', F.col("p_size"), '], [5, 1], "x", ["BM", "hue"]]]')).when(p == 1, '{"a": 1}').otherwise('[{"hasSoftMask": true}]')
    base = report.empty_report(parts_of(spark, d).select("doc_id", F.lit("ai").alias("format"), F.col("p_name").alias("name")))
    rows = parts_of(spark, d).select("doc_id", F.transform(pdf.gstate_entries(args), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("e"), pdf.group_soft_mask(args).alias("soft_mask"), F.when(p > 0, F.col("p_name")).alias("str"))
    return pdf.text_items(rows).select("doc_id", F.lit(True).alias("has_text")).join(rows, "doc_id", "right").join(base, "doc_id").select(key("p_partkey"), F.array_join("e", ",").alias("entries"), "soft_mask", F.coalesce("has_text", F.lit(False)).alias("has_text"), "parsed", "items", F.size("missing_fonts").alias("missing"))


ARGUMENT_GUARDS = """
select p_partkey, case when p_partkey % 3 = 0 then 'LW=' || p_size || ',BM=hue' else '' end as entries, case when p_partkey % 3 = 2 then true end as soft_mask, p_partkey % 3 > 0 as has_text, 0 as parsed, 0 as items, 0 as missing from part"""

QUERIES = {
    k: (globals()[k], globals()[k.upper()])
    for k in (
        "markup_nodes", "markup_report", "markup_hierarchy", "markup_runs", "slide_nodes", "slide_report", "xml_elements", "expanded_files", "layer_nodes", "layer_report", "page_nodes", "page_report", "raster_pages", "text_states",
        "image_states", "path_strings", "vector_log", "drawn_pages", "gradient_pages", "layer_texts", "text_blocks", "name_rules", "paint_rules", "clamped_runs", "font_aliases", "routed_files", "sink_images", "font_list", "argument_guards",
    )
}
