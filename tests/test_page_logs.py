"""Vector markup and layered pages from literal logs."""

import json

from lamina.operators import pdf_svg
from lamina.sources import page_logs


def test_draw():
    log = [("save", []), ("transform", [2, 0, 0, 2, 5, 5]), ("setFillRGBColor", [1, 0, 0]), ("constructPath", [["rectangle"], [0, 0, 10, 20]]), ("clip", []), ("endPath", []), ("constructPath", [["moveTo", "curveTo2"], [0, 0, 1, 1, 2, 2.5]]), ("setGState", [[["ca", 0.5], ["BM", "multiply"], ["LW", 3]]]), ("closeFillStroke", []), ("restore", []), ("shadingFill", [{"kind": "axial", "at": [0, 0, 1, 0], "stops": [[0, "#fff"]]}])]
    svg = pdf_svg.draw(log, 100, 50)
    assert 'fill="#ff0000"' in svg and 'd="M 0 0 C 0 0 1 1 2 2.5 Z"' in svg and 'stroke-width="3"' in svg and "mix-blend-mode:multiply" in svg
    assert svg.count("<clipPath") == 1 and 'transform="matrix(2 0 0 2 5 5)"' in svg and "linearGradient" in svg and 'width="100" height="50" fill="url(#shade-1)"' in svg
    assert pdf_svg.draw([("save", []), ("restore", []), ("restore", [])], 1, 1) is None
    assert pdf_svg.page_box((2, 0, 0, 2, 0, 0), 10, 20) == (0, 0, 5, 10)


def test_pages(spark):
    o = lambda i, op, args=None, tag=None, gid=None: ("d", i, op, tag, gid, json.dumps(args) if args else None, None, 100.0, 50.0)
    rows = [o(0, "beginMarkedContentProps", None, "OC", "a"), o(1, "constructPath", [["rectangle"], [0, 0, 5, 5]]), o(2, "fill"), o(3, "endMarkedContent"), o(4, "beginMarkedContentProps", None, "OC", "b"), o(5, "beginText"), o(6, "showText"), o(7, "endText"), o(8, "endMarkedContent"), o(9, "beginMarkedContentProps", None, "OC", "c"), o(10, "endMarkedContent"), o(11, "beginMarkedContentProps", None, "OC", "x"), o(12, "setLineWidth", ["bad"]), o(13, "endMarkedContent")]
    ops = spark.createDataFrame(rows, "doc_id string, idx long, op string, tag string, group_id string, args string, deps array<string>, page_w double, page_h double")
    groups = spark.createDataFrame([("d", "a", "Art", True), ("d", "b", "Text", True), ("d", "c", "BG Color", False)], "doc_id string, group_id string, name string, visible boolean")
    items = spark.createDataFrame([("d", 0, "open", None, None, None, None, None, None, None), ("d", 1, "close", None, None, None, None, None, None, None), ("d", 2, "open", None, None, None, None, None, None, None), ("d", 3, "text", "Hey", 10.0, 20.0, 30.0, 12.0, "F", False)], "doc_id string, idx long, kind string, text string, x double, y double, width double, height double, font string, has_eol boolean")
    assert page_logs.has_layers(ops).first().layered
    nodes, report = page_logs.import_pages(ops, groups, items)
    n = {r.node_id: r for r in nodes.collect()}
    assert n["d/a"].type == "group" and n["d/a/svg"].markup.count("<path") == 1 and n["d/b/1"].characters == "Hey" and n["d/b/1"].y == 18
    assert n["d/c"].type == "frame" and n["d/c"].locked and not n["d/c"].visible and n["d/x"].name == "x"
    assert sorted(r.code for r in report.collect()) == ["AI_EMPTY_LAYER_PRESERVED", "AI_EMPTY_LAYER_PRESERVED", "AI_PDF_HIERARCHY_IMPORT", "AI_PDF_VECTOR_LAYER_FAILED"]
    assert page_logs.raster_tiles(spark.createDataFrame([("p", 2500.0, 100.0)], "doc_id string, page_w double, page_h double")).count() == 2


def test_pages_are_read_once(spark):
    """A document's log, groups and items are read in one pass: nodes and items are rows of what it wrote, without a join or a window; nulls act as in SQL."""
    o = lambda d, *log: [(d, i, op, "OC" if gid else None, gid, args, None, 100.0, 50.0) for i, (op, gid, args) in enumerate(log)]
    begin, end, box = "beginMarkedContentProps", ("endMarkedContent", None, None), ("constructPath", None, '[["rectangle"], [0, 0, 5, 5]]')
    # a layer in another and the same layer again; a visible empty layer named as a hidden one; a close too many; a page without layers
    log = o("d", end, (begin, "a", None), (begin, "b", None), box, ("fill", None, None), end, end, (begin, "a", None), box, ("restore", None, None), (None, None, None), ("fill", None, None), end, (begin, "e", None), end, (begin, "h", None), end) + o("flat", ("fill", None, None))
    ops = spark.createDataFrame(log, "doc_id string, idx long, op string, tag string, group_id string, args string, deps array<string>, page_w double, page_h double")
    groups = spark.createDataFrame([("d", "a", None, None), ("d", "e", " Same", True), ("d", "h", "same", False)], "doc_id string, group_id string, name string, visible boolean")
    t = lambda i, text, x, y, w=10.0: ("d", i, "text", text, x, y, w, 10.0, "F", True)
    mark = lambda i, kind: ("d", i, kind, *[None] * 7)
    items = spark.createDataFrame([t(0, "before", 1.0, 1.0), mark(1, "open"), t(2, "one", 1.0, 40.0), t(3, "two", 1.0, 28.0), t(4, "far", None, 28.0), t(5, "", 1.0, 1.0), mark(6, "close"), t(7, "after", 1.0, 1.0)], "doc_id string, idx long, kind string, text string, x double, y double, width double, height double, font string, has_eol boolean")
    nodes, report = page_logs.import_pages(ops, groups, items)
    for df in (nodes, report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and "Python" not in plan
    got = [(r.node_id, r.type, r.ord, r.visible, r.characters) for r in nodes.orderBy("node_id", "ord").collect()]
    assert got == [("d/a", "group", 0, True, None), ("d/a", "group", 2, True, None), ("d/a/1", "text", 1, None, "one\ntwo"), ("d/a/2", "text", 2, None, "far"), ("d/a/svg", "svg", 0, None, None), ("d/b", "group", 1, True, None), ("d/b/svg", "svg", 0, None, None), ("d/h", "frame", 3, False, None)]
    assert nodes.filter("node_id = 'd/a/svg'").first().markup.count("<path") == 2
    assert sorted((r.doc_id, r.code) for r in report.collect()) == [("d", "AI_EMPTY_LAYER_PRESERVED"), ("d", "AI_PDF_HIERARCHY_IMPORT"), ("flat", "AI_PDF_HIERARCHY_IMPORT")]
