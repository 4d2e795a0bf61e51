"""Packages, slides and vector markup end to end on small in-memory files."""

import io
import zipfile

import pytest

from lamina.sources import packages, pptx, svg

NS = 'xmlns:p="p" xmlns:a="a" xmlns:r="r"'


def shape(name, x, text="", extra=""):
    body = f'<p:txBody><a:p><a:r><a:rPr sz="2400" b="1"/><a:t>{text}</a:t></a:r></a:p></p:txBody>' if text else ""
    return f'<p:sp><p:nvSpPr><p:cNvPr name="{name}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="95250"/><a:ext cx="952500" cy="952500"/></a:xfrm>{extra}</p:spPr>{body}</p:sp>'


def package(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return bytearray(b.getvalue())


def test_slides(spark):
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr name="Middle"/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="1905000" cy="1905000"/><a:chOff x="95250" y="0"/><a:chExt cx="952500" cy="952500"/></a:xfrm></p:grpSpPr>{shape("Child", 190500)}</p:grpSp>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr name="{}"/></p:nvPicPr><p:blipFill><a:blip r:embed="{}"/></p:blipFill><p:spPr/></p:pic>'
    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="0"/><a:ext cx="1905000" cy="952500"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>c1</a:t></a:r></a:p></a:txBody></a:tc><a:tc/></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    slide = f'<p:sld {NS}><p:cSld><p:spTree>{shape("Back", 95250, "Hello", "<a:noFill/>")}{group}{shape("Front", 0, "Hi", chr(60) + "a:solidFill><a:schemeClr val=" + chr(34) + "accent1" + chr(34) + "/></a:solidFill>")}{pic.format("Pic", "rId1")}{pic.format("Lost", "rId9")}{table}</p:spTree></p:cSld></p:sld>'
    data = package(**{
        "ppt/presentation.xml": f'<p:presentation {NS}><p:sldSz cx="12192000" cy="6858000"/></p:presentation>', "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Id="rId1" Target="../media/i.png"/></Relationships>', "ppt/media/i.png": b"PNG",
        "ppt/theme/theme1.xml": f'<a:theme {NS}><a:themeElements><a:clrScheme name="x"><a:accent1><a:srgbClr val="00FF00"/></a:accent1></a:clrScheme></a:themeElements></a:theme>',
    })
    nodes, assets, report = pptx.import_packages(spark.createDataFrame([("d", data)], "doc_id string, content binary"))
    n = {r.name: r for r in nodes.collect()}
    assert n["Slide 1"].width == 1280 and n["Back Text"].x == 10 and n["Back Text"].characters == "Hello" and n["Back Text"].font_size == 24
    assert [r.name for r in nodes.filter("parent_id = 'ppt/slides/slide1.xml'").orderBy("ord").collect()] == ["Back Text", "Middle", "Front", "Pic", "Table"]
    assert (n["Child"].x, n["Child"].width) == (20, 200) and n["Front"].fill is None or n["Front"].type == "rectangle"
    assert nodes.filter("type = 'rectangle' and name = 'Front'").first().fill.g == 1.0 and n["Cell 1.2"].x == 100 and n["Cell 1.1 Text"].characters == "c1"
    assert assets.first().mime == "image/png" and {r.level for r in report.collect()} == {"info", "warning"}


def test_packages(spark):
    z = package(**{"a/x10.svg": "<svg/>", "a/x2.svg": "<svg/>", "readme.txt": "no"})
    files = spark.createDataFrame([("z", "sel.zip", z), ("q", "one.pdf", bytearray(b"%PDF-"))], "doc_id string, name string, content binary")
    got = [(r.name, r.format) for r in packages.expand(files).collect()]
    assert got == [("one.pdf", "ai"), ("x2.svg", "ai"), ("x10.svg", "ai")]
    bad = spark.createDataFrame([("b", bytearray(b"not a zip"))], "doc_id string, content binary")
    assert packages.unpack(bad).first().part is None
    assert packages.oversized(spark.createDataFrame([("a.pptx", 600 << 20), ("b.ai", 600 << 20)], "name string, size long")).first().name == "a.pptx"


def files(spark, text):
    return spark.createDataFrame([("s", "s.svg", bytearray(text.encode()))], "doc_id string, name string, content binary")


def test_plain_svg(spark):
    f = files(spark, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 200 100"><g transform="translate(10 5)"><rect x="1" y="2" width="30" height="40" fill="#f00"/></g><path d="M0 0" stroke="black"/><text x="5" y="20" font-size="10">hi</text><image href="http://x"/><blob/></svg>')
    e = svg.load(f)
    assert not svg.needs_hierarchy(e).first().complex
    nodes, assets, report = svg.plain_nodes(e)
    n = {r.type: r for r in nodes.collect()}
    assert set(n) == {"group", "rectangle", "vector", "text"} and (n["rectangle"].x, n["rectangle"].y, n["rectangle"].fill.r) == (11, 7, 1.0)
    assert n["vector"].stroke_width == 1 and n["text"].y == 10 and assets.count() == 0
    assert sorted(r.code for r in report.collect()) == ["SVG_EXTERNAL_IMAGE", "SVG_UNSUPPORTED_ELEMENT", "SVG_VECTOR_IMPORT"]


def test_svg_hierarchy(spark):
    f = files(spark, '<svg xmlns="http://www.w3.org/2000/svg" width="200" height="100"><style>.a{fill:#00ff00;font-size:8px}.a{font-size:20px}</style><g id="L_x5F_1" opacity="0.5" transform="translate(10 5)"><text class="a" x="20" y="40" font-family="Inter"><tspan x="20" y="30">one</tspan><tspan x="20" y="60">two</tspan></text><rect id="r" width="5"/></g><g id="nothing"/><g/></svg>')
    e = svg.load(f)
    assert svg.needs_hierarchy(e).first().complex and svg.decorations(e).first().drawn == 4
    nodes, runs, report = svg.hierarchy(f)
    n = {r.type: r for r in nodes.collect()}
    assert set(n) == {"group", "text", "svg"} and n["group"].name == "L_1" and n["group"].opacity == 0.5
    assert (n["text"].x, n["text"].y, n["text"].characters, n["text"].font_family, n["text"].line_height) == (30, 15, "one\ntwo", "Inter", 30)
    assert n["text"].fill.g == 1.0 and [(r.run_start, r.run_end) for r in runs.orderBy("run_start").collect()] == [(0, 3), (4, 7)]
    assert "opacity" not in n["svg"].markup and 'id="r"' in n["svg"].markup and "translate(10 5)" in n["svg"].markup
    assert sorted(r.code for r in report.collect()) == ["SVG_EMPTY_GROUP_OMITTED", "SVG_HIERARCHY_IMPORT"]
    with pytest.raises(Exception, match="not an SVG"):
        svg.page_sizes(svg.load(files(spark, "<html/>"))).collect()


def test_router(spark):
    from lamina.sources import route

    cols = "doc_id string, name string, size long, content binary"
    one = lambda n, data, size=9: spark.createDataFrame([("x", n, size, bytearray(data))], cols)
    with pytest.raises(ValueError, match=r"over the size limit: a\.pptx"):
        route.import_files(one("a.pptx", b"", 600 << 20))
    with pytest.raises(Exception, match="neither vector markup nor pages"):
        route.kinds(one("a.ai", b"plain words")).collect()
    assert route.kinds(one("a.txt", b"plain words")).count() == 0


def test_class_rules(spark):
    from pyspark.sql import functions as F

    from lamina.functions import strings

    css = "rect{x:1} .a {fill:red}.b-1,.c_2{y:2;}\n@media x{.d{z:3}} .e{} .f{open"
    rows = spark.createDataFrame([(css,), ("",), (None,)], "c string").select(strings.class_rules(F.col("c")).alias("r")).collect()
    assert [(r.name, r.body) for r in rows[0].r] == [("a", "fill:red"), ("c_2", "y:2;"), ("d", "z:3")] and not rows[1].r and rows[2].r is None


def test_markup_is_parsed_once(spark):
    """Elements are read from written rows; offsets add up over groups, and what stands in a shape or a definition is no node."""
    f = files(spark, '<svg width="9" height="9"><g transform="translate(1 2)"><g transform="translate(10 20)"><rect id="in" x="3" y="4"/></g></g><rect id="r"><g><rect id="under"/></g></rect><defs><g><rect id="def"/></g></defs></svg>')
    e = svg.load(f)
    nodes, _, _ = svg.plain_nodes(e)
    for df in (e, nodes):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.name: (r.x, r.y) for r in nodes.collect() if r.type == "rectangle"}
    assert got == {"in": (14, 26), "r": (0, 0)}
    assert svg.decorations(e).first().drawn == 6


def test_plain_nodes_are_one_pass(spark, monkeypatch):
    """What elements have from those above them is found while they are read: one table is written, and nodes are rows of it, without a join."""
    written, real = [], svg.cut
    for m in (svg, svg.tree):
        monkeypatch.setattr(m, "cut", lambda d: written.append(real(d)) or written[-1])
    deep = "".join(f'<g transform="translate({i % 3} 1)">' for i in range(300)) + '<rect id="low" x="1" y="1"/>' + "</g>" * 300
    f = files(spark, f'<svg width="9">{deep}<rect id="last"/></svg>').unionByName(files(spark, '<svg viewBox="0 0 7 8"><circle id="c" cx="2" cy="3" r="1"/></svg>').replace("s", "t", ["doc_id"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        nodes, assets, report = svg.plain_nodes(svg.load(f.coalesce(1)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and "Join" not in plan
    got = {(r.doc_id, r.name): r for r in nodes.filter("type <> 'group'").collect()}
    assert set(got) == {("s", "low"), ("s", "last"), ("t", "c")} and (got["s", "low"].x, got["s", "low"].y, got["s", "last"].x) == (301, 301, 0)
    assert got["t", "c"].x == 1 and nodes.filter("type = 'group' and width = 9 and height = 1000").count() == 300
    assert {r.code for r in report.collect()} == {"SVG_VECTOR_IMPORT"} and assets.count() == 0
    with pytest.raises(Exception, match="not an SVG"):
        svg.plain_nodes(svg.load(files(spark, "<html><rect/></html>")))[0].collect()


def test_router_unpacks_without_a_sort(spark, monkeypatch):
    """A sort by ranges reads its input twice, so archives would be unpacked twice."""
    from lamina.sources import route

    plans = []

    def first(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise KeyError("only the first table matters here")

    monkeypatch.setattr(route, "cut", first)
    z = spark.createDataFrame([("z", "sel.zip", 9, package(**{"a.svg": '<svg width="9"><rect/></svg>'}))], "doc_id string, name string, size long, content binary")
    with pytest.raises(KeyError):
        route.import_files(z)
    assert "MapInArrow" in plans[0] and "Sort" not in plans[0]


def test_slides_are_read_once(spark):
    """A package is unpacked and read in one pass: nodes, assets and items are rows of what it wrote, without a join or a window; odd parts change nothing for the others."""
    pic = '<p:pic><p:nvPicPr><p:cNvPr name="{0}"/></p:nvPicPr><p:blipFill><a:blip r:embed="{0}"/></p:blipFill><p:spPr/></p:pic>'
    inner = "<a:tbl><a:tr><a:tc/></a:tr></a:tbl>"
    table = f'<p:graphicFrame><a:graphic><a:tbl><a:tr/><a:tr><a:tc><a:txBody><a:p><a:r><a:t>one</a:t></a:r></a:p><a:p><a:fld><a:t>2</a:t></a:fld></a:p></a:txBody>{inner}</a:tc></a:tr></a:tbl></a:graphic></p:graphicFrame>'
    slide = f'<p:sld {NS}><p:cSld><p:spTree>{"".join(pic.format(i) for i in ("twice", "lost", "up"))}{table}<p:other>{shape("Astray", 0)}</p:other></p:spTree></p:cSld></p:sld>'
    rels = '<Relationships><Relationship Id="twice" Target="../media/i.png"/><Relationship Id=" twice " Target="/ppt/media/./j.png"/><Relationship Id="up" Target="../../../ppt/media/i.png"/></Relationships>'
    good = package(**{"ppt/slides/slide10.xml": "<broken", "ppt/slides/slide2.xml": slide, "ppt/slides/_rels/slide2.xml.rels": rels, "ppt/media/i.png": b"I", "ppt/media/j.png": b"J", "ppt/media/k.png": b"K"})
    nodes, assets, report = pptx.import_packages(spark.createDataFrame([("d", good), ("x", bytearray(b"not a zip"))], "doc_id string, content binary"))
    for df in (nodes, assets, report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "Join" not in plan and "Window" not in plan
    got = sorted((r.name, r.type, r.asset_ref or r.characters or "") for r in nodes.collect())
    assert got == [("Cell 2.1", "rectangle", ""), ("Cell 2.1 Text", "text", "one\n2"), ("Slide 1", "frame", ""), ("Slide 2", "frame", ""), ("Table", "group", ""), ("twice", "image", "ppt/media/i.png"), ("twice", "image", "ppt/media/j.png"), ("up", "image", "ppt/media/i.png")]
    assert sorted((r.name, bytes(r.data)) for r in assets.collect()) == [("i.png", b"I"), ("j.png", b"J")]
    assert sorted((r.doc_id, r.level, r.node_name or r.message) for r in report.collect()) == [("d", "info", "8 nodes imported"), ("d", "warning", "lost")]


def test_router_spreads_files(spark):
    """Files of every kind reach their importer in one call; one task's files become tasks for all cores."""
    from lamina.sources import route

    one = lambda i, n, data: (i, n, len(data), bytearray(data))
    deck = package(**{"ppt/slides/slide1.xml": f"<p:sld {NS}><p:cSld><p:spTree>{shape('A', 0)}</p:spTree></p:cSld></p:sld>"})
    rows = [one("z", "z.zip", package(**{f"{i}.svg": f'<svg width="9"><rect id="r{i}"/></svg>' for i in range(20)})), one("s", "s.svg", b'<svg width="9"><defs/><rect id="r"/></svg>'), one("k", "k.pptx", deck), one("p", "p.pdf", b"%PDF-"), one("f", "f.pdf", b"%PDF-"), one("u", "u.pdf", b"%PDF-"), one("q", "q.psd", b"8BPS")]
    files = spark.createDataFrame(rows, "doc_id string, name string, size long, content binary").coalesce(1)
    ops = spark.createDataFrame([("p", 0, "beginMarkedContentProps", "OC", "a", 9.0), ("p", 1, "endMarkedContent", None, None, 9.0), ("f", 0, "fill", None, None, 9.0), ("other", 0, "fill", None, None, 9.0)], "doc_id string, idx long, op string, tag string, group_id string, page_w double").selectExpr("*", "page_w as page_h", "string(null) as args", "cast(null as array<string>) as deps")
    groups = spark.createDataFrame([("p", "a", "Art", True)], "doc_id string, group_id string, name string, visible boolean")
    items = spark.createDataFrame([], "doc_id string, idx long, kind string, text string, x double, y double, width double, height double, font string, has_eol boolean")
    written, real = [], route.cut
    route.cut = lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df)
    try:
        got = route.import_files(files, None, (ops, groups, items))
    finally:
        route.cut = real
    assert "RepartitionByExpression [doc_id" in written[0] and "Sort" not in written[0]
    nodes = sorted((r.doc_id, r.kind, r.type, r.name) for r in got.nodes.collect())
    assert nodes == sorted([*((f"z!{i}.svg", "svg", "rectangle", f"r{i}") for i in range(20)), ("s", "svg", "svg", "r"), ("k", "pptx", "frame", "Slide 1"), ("k", "pptx", "rectangle", "A"), ("p", "pdf", "frame", "Art"), ("f", "pdf", "image", "Tile 1")])
    assert sorted((r.doc_id, r.kind) for r in got.undecoded.collect()) == [("q", "psd"), ("u", "pdf")]
    assert sorted(r.code for r in got.report.filter("doc_id in ('p', 'f', 'k', 's')").collect()) == ["AI_EMPTY_LAYER_PRESERVED", "AI_PDF_FALLBACK", "AI_PDF_HIERARCHY_IMPORT", "PPTX_IMPORT", "SVG_HIERARCHY_IMPORT"]
