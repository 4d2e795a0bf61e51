"""Golden vectors of operators on logs, text, fonts, trees and sinks."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import geometry
from lamina.operators import fonts, intervals, ordered, pdf, report, tree
from lamina.sources import sink

OPS = "doc_id string, idx int, op string, tag string, group_id string"


def test_layer_ranges_keep_visibility(spark):
    ops = spark.createDataFrame([("d", 0, "beginMarkedContentProps", "OC", "a"), ("d", 1, "endMarkedContent", None, None), ("d", 2, "beginMarkedContentProps", "OC", "b"), ("d", 3, "endMarkedContent", None, None), ("d", 4, "endMarkedContent", None, None)], OPS)
    groups = spark.createDataFrame([("d", "a", "One", True), ("d", "b", "Two", False)], "doc_id string, group_id string, name string, visible boolean")
    got = [(r.start, r.end, r.visible) for r in intervals.layer_ranges(ops, groups).orderBy("start").collect()]
    assert got == [(1, 1, True), (3, 3, False)]
    same = groups.withColumn("name", F.when(F.col("group_id") == "a", " two ").otherwise(F.col("name")))
    assert [(r.start, r.visible) for r in intervals.layer_ranges(ops, same).collect()] == [(3, False)]


def seg_ops(spark):
    rows = [
        ("setGState", "hard-light", 0.2, None, None), ("save", None, None, None, None), ("transform", None, None, None, None),
        ("beginGroup", None, None, None, True), ("save", None, None, None, None), ("paintImageXObject", None, None, None, None), ("restore", None, None, None, None), ("endGroup", None, None, None, None), ("restore", None, None, None, None),
        ("setGState", "normal", 1.0, None, None), ("save", None, None, None, None), ("setGState", "multiply", 0.4, None, None), ("paintImageXObject", None, None, None, None), ("restore", None, None, None, None), ("paintImageXObject", None, None, None, None),
    ]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "doc_id string, idx long, op string, blend string, alpha double, smask boolean, soft_mask boolean")
    return df.withColumn("is_image", F.col("op").isin(*pdf.IMAGES)).withColumn("soft_mask", F.coalesce("soft_mask", F.lit(False)))


def test_image_segments_and_styles(spark):
    ops = seg_ops(spark)
    seg = intervals.image_segments(ops)
    assert sorted((r.start, r.end) for r in seg.collect()) == [(3, 7), (10, 13), (14, 14)]
    got = {r.start: (r.blend_mode, r.opacity, r.has_soft_mask, r.opacity_baked) for r in pdf.image_styles(ops, seg).collect()}
    assert got == {3: ("hard-light", 0.2, True, False), 10: ("multiply", 0.4, False, True), 14: ("normal", 1.0, False, False)}


def test_state_with_brackets_equals_a_stack(spark):
    import random

    rnd = random.Random(5)
    rows, want = [], []
    for doc in "ab":
        state, stack = 0, []
        for i in range(120):
            op = rnd.choice(["save", "restore", "set", "none"])
            v = rnd.randint(1, 99) if op == "set" else None
            if op == "save":
                stack.append(state)
            elif op == "restore":
                state = stack.pop() if stack else state
            elif op == "set":
                state = v
            rows.append((doc, i, op, v))
            want.append((doc, i, state))
    df = spark.createDataFrame(rows, "doc_id string, idx int, op string, v int")
    out = ordered.state_with_brackets(df, ["doc_id"], ["idx"], F.col("op") == "save", F.col("op") == "restore", F.col("v"), F.lit(0), "state")
    assert sorted((r.doc_id, r.idx, r.state) for r in out.collect()) == want


TEXT = "doc_id string, k int, str string, x double, y double, width double, height double, font string, has_eol boolean"


def test_text_blocks(spark):
    items = spark.createDataFrame([("d", 0, "ab", 100.0, 200.0, 50.0, 24.0, "ABCDEF+Foo-Bold", True), ("d", 1, "cd", 110.0, 149.2, 40.0, 24.0, "Foo", True), ("d", 2, "ef", 120.0, 130.0, 30.0, 16.0, "Foo", False), ("d", 3, "far", 900.0, 20.0, 30.0, 16.0, "Foo", False)], TEXT)
    blocks, runs = pdf.text_blocks(items, F.lit(300.0))
    b = blocks.orderBy("block").collect()
    assert [r.characters for r in b] == ["ab\ncd\nef", "far"] and b[0].alignment == "right" and b[0].style == "Bold" and b[1].alignment == "left"
    r = [(x.run_start, x.run_end, round(x.line_height, 1)) for x in runs.filter("block = 1").orderBy("k").collect()]
    assert r == [(0, 3, 50.8), (3, 6, 24.0), (6, 8, 19.2)]


def test_convert_path(spark):
    buf = F.array(*[F.lit(float(x)) for x in (0, 2, 3, 1, 4, 5, 3, 10, 11, 14, 15, 4)])
    r = spark.range(1).select(pdf.convert_path(buf).alias("p")).select("p.*", pdf.path_string(F.col("p.ops"), F.col("p.args")).alias("d")).first()
    assert r.ops == ["moveTo", "lineTo", "curveTo", "closePath"] and r.args == pytest.approx([2, 3, 4, 5, 8, 9, 34 / 3, 37 / 3, 14, 15])
    assert r.d == "M 2 3 L 4 5 C 8 9 11.33333333 12.33333333 14 15 Z"


def test_gradient_fill(spark):
    schema = "doc_id string, idx int, op string, matrix array<double>, page_w double, page_h double, kind string, p0 array<double>, p1 array<double>, stops array<struct<offset:double,color:string>>"
    stops = [(0.0, "#ff0000"), (1.0, "#0000ff")]
    rows = [("d", 0, "save", None, 3000.0, 3000.0, None, None, None, None), ("d", 1, "transform", [3000.0, 0.0, 0.0, 3000.0, 0.0, 0.0], 3000.0, 3000.0, None, None, None, None), ("d", 2, "shadingFill", None, 3000.0, 3000.0, "axial", [0.25, 0.0], [0.25, 1.0], stops)]
    r = pdf.gradient_fills(spark.createDataFrame(rows, schema)).first()
    assert (r.x0, r.y0, r.x1, r.y1, len(r.stops)) == (0.25, 1.0, 0.25, 0.0, 2)
    assert pdf.gradient_fills(spark.createDataFrame([*rows, ("d", 3, "fill", None, 3000.0, 3000.0, None, None, None, None)], schema)).count() == 0


def test_vector_ops_and_text_styles(spark):
    ops = ["save", "beginText", "showText", "endText", "paintImageXObject", "fill", "restore", "restore", "save"]
    df = spark.createDataFrame([("d", i, o, None) for i, o in enumerate(ops)], "doc_id string, idx int, op string, deps array<string>")
    v = pdf.vector_ops(df)
    assert [r.op for r in v.orderBy("idx").collect()] == ["save", "fill", "restore", "save"]
    assert pdf.missing_restores(v).first().missing == 1 and pdf.has_paint(v).first().paints
    styles = spark.createDataFrame([("d", 0, "save", None, None, None), ("d", 1, "setFillRGBColor", "#111111", None, None), ("d", 2, "setGState", None, 0.5, "multiply"), ("d", 3, "showText", None, None, None), ("d", 4, "restore", None, None, None), ("d", 5, "showText", None, None, None)], "doc_id string, idx int, op string, fill string, alpha double, blend string")
    assert [(r.fill, r.opacity, r.blend) for r in pdf.text_styles(styles).orderBy("k").collect()] == [("#111111", 0.5, "multiply"), ("#000000", 1.0, None)]


def test_text_by_layer(spark):
    items = spark.createDataFrame([("d", 0, "open", None), ("d", 1, "text", "a"), ("d", 2, "close", None), ("d", 3, "text", "lost"), ("d", 4, "open", None), ("d", 5, "text", "b")], "doc_id string, idx int, kind string, text string")
    layers = spark.createDataFrame([("d", 0, "L0"), ("d", 1, "L1")], "doc_id string, k long, layer_id string")
    assert sorted((r.text, r.layer_id) for r in intervals.text_by_layer(items, layers).collect()) == [("a", "L0"), ("b", "L1")]


def test_fonts(spark):
    wanted = fonts.requested(spark.createDataFrame([(0, "Inter", "Regular", None, None), (1, "sxsgys-x", "Medium", None, None), (2, "My-Font", "Bold", None, None), (3, "Nope", " ", "Base", None), (4, "singkaibeieg-bold-gb", None, None, None)], "ord int, family string, style string, base_family string, base_style string"))
    have = spark.createDataFrame([(0, "Inter", "Regular"), (1, "SXS_GYSJ", "Regular"), (2, "my font", "Light"), (3, "My.Font", "Regular"), (4, "Kaiti SC", "Bold")], "ord int, family string, style string")
    got = {r.family: (r.decision, r.chosen_family) for r in fonts.analyze(wanted, have).collect()}
    assert got == {"Inter": ("exact", "Inter"), "sxsgys-x": ("equivalent", "SXS_GYSJ"), "My-Font": ("equivalent", "My.Font"), "Nope": ("fallback", "Inter"), "singkaibeieg-bold-gb": ("suggested", "Kaiti SC")}


NODE = "doc_id string, node_id string, parent_id string, ord int, type string, name string, is_group boolean, is_mask boolean"


def nodes(spark):
    return spark.createDataFrame([("d", "p", None, 0, "frame", "P", True, None), ("d", "g", "p", 0, "group", "G", True, None), ("d", "e", "p", 1, "group", "Empty", True, None), ("d", "a", "p", 2, "group", None, True, None), ("d", "i", "g", 0, "image", "I", False, None), ("d", "t", "g", 1, "text", "T", False, None), ("d", "m", "a", 0, "image", "M", False, True)], NODE)


def test_tree(spark):
    n = nodes(spark)
    assert tree.count_nodes(n).first().nodes == 7
    assert {r.node_id: r.nodes for r in tree.subtree_sizes(n).collect()} == {"p": 7, "g": 3, "e": 1, "a": 2, "i": 1, "t": 1, "m": 1}
    kept, named = tree.drop_empty_groups(n)
    assert sorted(r.node_id for r in kept.collect()) == ["a", "g", "i", "m", "p", "t"] and [r.name for r in named.collect()] == ["Empty"]
    copies = tree.image_subtrees(n, spark.createDataFrame([("d", "p")], "doc_id string, node_id string"))
    assert sorted(r.node_id for r in copies.collect()) == ["copy/g", "copy/i", "copy/m", "copy/p"]


def test_deep_tree(spark):
    n = spark.createDataFrame([("d", i, i - 1 if i else None) for i in range(40)], "doc_id string, node_id int, parent_id int")
    c = tree.closure(n)
    assert c.count() == 40 * 41 // 2 and c.filter("node_id = 39 and ancestor_id = 0").first().distance == 39


def test_render_is_atomic(spark, tmp_path):
    n = nodes(spark).filter("node_id <> 'e'")
    out = str(tmp_path / "out")
    assert sink.render(n, out).first().nodes == 6
    with pytest.raises(ValueError):
        sink.render(nodes(spark), out)
    with pytest.raises(RuntimeError):
        sink.render(n, out, check=lambda df: (_ for _ in ()).throw(RuntimeError("no")))
    assert spark.read.parquet(out).count() == 6 and [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []


def test_report_codes():
    assert len(report.CODES) == 24 and set(report.CODES.values()) == {"info", "warning", "fallback"}


def test_backdrop_pairs(spark):
    s = spark.createDataFrame([("d", "gradient", 5, 9, None, False), ("d", "image", 12, 20, "hard-light", True), ("e", "gradient", 30, 40, None, False), ("e", "image", 1, 2, "hard-light", True)], "doc_id string, kind string, start int, end int, blend_mode string, has_soft_mask boolean")
    assert [r.doc_id for r in pdf.backdrop_pairs(s).collect()] == ["d"]


def test_trees_of_any_depth(spark):
    n = spark.createDataFrame([("d", i, i - 1 if i else None, i == 3) for i in range(1000)], "doc_id string, node_id int, parent_id int, v boolean")
    assert {r.node_id: r.nodes for r in tree.subtree_sizes(n).collect()} == {i: 1000 - i for i in range(1000)}
    values = n.filter("v").select("doc_id", "node_id", F.lit("fill").alias("name"), F.lit("red").alias("value"), F.lit(0).alias("rank"), F.lit(0).alias("class_pos"))
    assert sorted(r.node_id for r in tree.inherited(n, values).collect()) == list(range(3, 1000))
    moved = tree.world_matrices(n, geometry.parse_transform(F.lit("translate(1, 2)")))
    assert moved.filter("node_id = 999").first().matrix[4:] == [1000.0, 2000.0]
    deep = n.filter("node_id < 100")
    assert tree.closure(deep).count() == 100 * 101 // 2
    ring = spark.createDataFrame([("d", i, (i + 1) % 5) for i in range(5)], "doc_id string, node_id int, parent_id int")
    for f in (tree.closure, tree.subtree_sizes):
        with pytest.raises(ValueError, match="cycle"):
            f(ring)


def test_intervals_of_all_lengths(spark):
    r = random.Random(3)
    span = lambda: (a := r.randint(0, 2**r.randint(1, 40)), a + r.randint(0, 2**r.randint(0, 40)))
    a, b = ([("k", *span()) for _ in range(120)] for _ in range(2))
    points = [("k", r.randint(0, 2**r.randint(1, 40))) for _ in range(150)]
    frame = lambda rows: spark.createDataFrame(rows, "key string, start long, end long")
    touch = [x for x in a if any(x[1] <= y[2] and y[1] <= x[2] for y in b)]
    assert sorted(map(tuple, intervals.overlapping(frame(a), frame(b), ["key"]).collect())) == sorted(touch)
    assert sorted(map(tuple, intervals.overlapping(frame(a), frame(b), ["key"], "left_anti").collect())) == sorted(x for x in a if x not in touch)
    got = intervals.innermost(spark.createDataFrame(points, "key string, at long"), frame(a), ["key"], "at").collect()
    want = [(k, p, *(min(((-x[1], x[2]) for x in a if x[1] <= p <= x[2]), default=(None, None)))) for k, p in points]
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, p, None if s is None else -s, e)) for k, p, s, e in want)


def test_pages_share_a_batch(spark):
    """Many small pages are folded in sorted batches, not in a call for each page; a page without rows keeps its segment."""
    ops = spark.range(300).selectExpr("cast(id as string) doc_id", "explode(array(named_struct('idx', 1L, 'op', 'setGState', 'alpha', id / 300D), named_struct('idx', 2L, 'op', 'paintImageXObject', 'alpha', null))) r").selectExpr("doc_id", "r.*", "cast(null as string) blend", "cast(null as boolean) smask", "cast(null as boolean) soft_mask")
    seg = spark.range(301).selectExpr("cast(id as string) doc_id", "2L start", "2L end")
    styles = pdf.image_styles(ops, seg)
    assert "InPandas" not in styles._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r.opacity for r in styles.collect()}
    assert got == {str(i): i / 300 for i in range(300)} | {"300": 1.0}
