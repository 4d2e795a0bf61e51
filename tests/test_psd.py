"""Layer trees: placement, masks, flowing filters, report."""

from lamina.functions.filters import ADJUSTMENT
from lamina.sources import psd

SCHEMA = f"doc_id string, layer_id string, parent_id string, ord int, name string, left double, top double, right double, bottom double, opacity double, hidden boolean, blend_mode string, clipping boolean, adjustment {ADJUSTMENT}, has_pixels boolean, mask_on boolean, mask_density double, mask_feather double, text struct<characters:string,font:string,size:double,justification:string,r:double,g:double,b:double,a:double>"


def adj(exposure):
    a = {"type": "brightness/contrast", "brightness": exposure * 150}
    names = [x.split(":")[0].strip() for x in ADJUSTMENT[7:-1].replace("array<struct<input:double,output:double>>", "P").replace("array<struct<name:string,cyan_red:double,magenta_green:double,yellow_blue:double>>", "T").split(",")]
    return tuple(a.get(n) for n in names)


def layer(i, parent, order, adjustment=None, **kv):
    d = {"name": i, "left": 10.0, "top": 20.0, "right": 40.0, "bottom": 60.0, "opacity": 128.0, "hidden": False, "blend_mode": "multiply", "clipping": False, "has_pixels": True, "mask_on": False, "mask_density": None, "mask_feather": None, "text": None} | kv
    return ("d", i, parent, order, d["name"], d["left"], d["top"], d["right"], d["bottom"], d["opacity"], d["hidden"], d["blend_mode"], d["clipping"], adjustment, d["has_pixels"], d["mask_on"], d["mask_density"], d["mask_feather"], d["text"])


def test_layers(spark):
    rows = [
        layer("a1", None, 0, adj(0.7)), layer("a2", None, 1, adj(0.6)), layer("c", None, 2, adj(-0.5), clipping=True), layer("x", None, 3), layer("y", None, 4),
        layer("g", None, 5, right=None, bottom=None), layer("in", "g", 0, left=15.0), layer("off", "g", 1, hidden=True, left=-500.0), layer("t", "g", 2, text=("Hi", None, 12.0, "CENTER_x", 255.0, 0.0, 0.0, None)),
        layer("m", None, 6, mask_on=True, mask_feather=3.0), layer("e", None, 7, has_pixels=False), layer("mo", None, 8, adj(0.2), mask_on=True, clipping=True), layer("p", None, 9), layer("q", None, 10),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    f = {r.layer_id: r.filters.get("exposure", 0) for r in psd.flowing(df).collect()}
    assert f["x"] == 0.5 and f["y"] == 1.0 and f["in"] == 1.0 and f["p"] == 1.0  # clamped at every step, clipped ones end with the next layer
    nodes, report = psd.import_layers(df)
    n = {r.node_id: r for r in nodes.collect()}
    assert (n["g"].x, n["g"].width, n["in"].x) == (10, 30, 5) and n["x"].opacity == 128 / 255 and not n["off"].visible
    assert n["t"].type == "text" and n["t"].align == "center" and n["t"].fill.r == 1 and n["t"].font_family == "Arial"
    assert n["m"].type == "group" and n["m:mask"].is_mask and n["m:mask"].blur == 3 and n["m:content"].parent_id == "m" and "e" not in n
    codes = [r.code for r in report.collect()]
    assert codes.count("PSD_EMPTY_LAYER") == 1 and codes.count("PSD_ADJUSTMENT_NATIVE") == 4 and codes.count("PSD_MASKED_ADJUSTMENT_NATIVE") == 1 and codes.count("PSD_ADJUSTMENT_NON_IMAGE_TARGET") == 1
    assert [(r.overlay_id, r.layer_id) for r in psd.masked_overlays(df).collect()] == [("mo", "p")]
    skipped, report = psd.import_layers(df, text_mode="rasterize", unsupported="skip")
    assert skipped.filter("type = 'text'").count() == 0 and "PSD_LAYER_SKIPPED" in {r.code for r in report.collect()}


def test_branches_read_written_rows(spark):
    """Nodes and items are unions of a dozen branches; none of them may plan the joins and folds of the layers again."""
    nodes, report = psd.import_layers(spark.createDataFrame([layer("a", None, 0, adj(0.7)), layer("x", None, 1)], SCHEMA))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(nodes).count("Join ") == 0 and plan(nodes).count("Window ") == 0
    assert plan(report).count("Join ") <= 4 and len(plan(report)) < 100_000
    assert {r.node_id for r in nodes.collect()} == {"a", "x"}


def test_layers_are_folded_once(spark, monkeypatch):
    """One table is written, and items are one branch of it; the fold finds what the operators on whole tables find, also where a document spans batches."""
    import random

    from pyspark.sql import functions as F

    rng, rows = random.Random(3), []
    for doc in range(12):
        groups = [None]
        for i in range(rng.randrange(1, 40)):
            kind, parent = rng.random(), rng.choice(groups)
            box = {"left": rng.choice([None, -5.0, float(i)]), "right": rng.choice([None, 30.0 + i]), "hidden": rng.choice([None, False, False, True]), "clipping": rng.random() < 0.4, "has_pixels": rng.random() < 0.2, "mask_on": rng.random() < 0.4}
            rows.append((f"d{doc}", *layer(f"n{i}", parent, i, adj(rng.choice([0.0, 0.3, -0.6])) if kind < 0.4 else None, **box)[1:]))
            if kind > 0.7:
                groups.append(f"n{i}")
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vector_mask_on", F.lit(False))
    written, real = [], psd.cut
    monkeypatch.setattr(psd, "cut", lambda d: written.append(real(d)) or written[-1])
    monkeypatch.setattr(psd.tree, "cut", lambda d: written.append(real(d)) or written[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        nodes, report = psd.import_layers(df)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and plan.count("Relation") == 1 and "Join" not in plan
    got = {(r.doc_id, r.layer_id): r for r in written[0].collect()}
    assert len(got) == len(rows) == sum(1 for _ in psd.boxes(df).collect())
    for r in psd.boxes(df).collect():
        assert (r.l, r.t, r.w, r.h) == tuple(got[r.doc_id, r.layer_id][c] for c in "ltwh")
    for r in psd.flowing(df).collect():
        g = got[r.doc_id, r.layer_id]
        assert g.is_adj or g.is_group or g.filters == r.filters
    flags = df.select("doc_id", F.col("layer_id").alias("node_id"), "parent_id").join(written[0].select("doc_id", F.col("layer_id").alias("node_id"), ((F.col("decision") == "raster")).cast("int").alias("n")), ["doc_id", "node_id"])
    images = {(r.doc_id, r.node_id) for r in psd.tree.subtree_sums(flags, F.col("n")).filter("total > 0").collect()}
    hits = psd.masked_overlays(df).collect()
    reach = {(r.doc_id, r.overlay_id) for r in hits if (r.doc_id, r.layer_id) in images}
    assert hits and reach == {k for k, r in got.items() if r.reaches} and len({(r.doc_id, r.overlay_id) for r in hits}) > len(reach)
    assert nodes.count() > 0 and report.filter("code = 'PSD_IMPORT'").count() == 12
