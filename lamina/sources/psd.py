"""Layer trees of image documents, from decoded layer rows, as node rows.

layers: doc_id, layer_id, parent_id, ord, name, left, top, right, bottom, opacity, hidden, blend_mode,
clipping, adjustment (struct, see `functions.filters`), has_pixels, mask_on, mask_density, mask_feather,
text (struct characters, font, size, justification, r, g, b, a). Boxes and rows may be null. vector_mask_on,
vector_mask_density and vector_mask_feather may be missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.filters import combine_filters, has_filters, map_adjustment
from lamina.functions.geometry import color, hex_color, unit_channel, unit_opacity
from lamina.functions.strings import text_align
from lamina.operators import ordered, tree
from lamina.operators.report import item
from lamina.session import cut

EMPTY = "map<string,double>"


def _none() -> Column:
    return F.create_map().cast(EMPTY)


def _masked(layers: DataFrame) -> tuple[DataFrame, Column, Column]:
    """(layers with the columns of vector masks, has a pixel mask, has a vector mask)."""
    types = {"vector_mask_on": "boolean", "vector_mask_density": "double", "vector_mask_feather": "double"}
    full = layers.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in layers.columns})
    return full, F.coalesce("mask_on", F.lit(False)), F.coalesce("vector_mask_on", F.lit(False))


def boxes(layers: DataFrame) -> DataFrame:  # P31, G4
    """doc_id, layer_id, l, t, w, h: a layer's own box; for a group without right or bottom the box of its shown children."""
    left, top = F.coalesce("left", F.lit(0.0)), F.coalesce("top", F.lit(0.0))
    own = layers.select("doc_id", "layer_id", left.alias("l"), top.alias("t"), F.greatest(F.lit(1.0), F.coalesce("right", left + 1) - left).alias("w"), F.greatest(F.lit(1.0), F.coalesce("bottom", top + 1) - top).alias("h"), (F.col("right").isNotNull() & F.col("bottom").isNotNull()).alias("given"))
    kids = tree.group_bounds(layers.filter("parent_id is not null").select("doc_id", F.col("parent_id").alias("layer_id"), "left", "top", "right", "bottom", "hidden"), ["doc_id", "layer_id"])
    both = own.join(kids.select("doc_id", "layer_id", F.col("left").alias("kl"), F.col("top").alias("kt"), F.col("width").alias("kw"), F.col("height").alias("kh")), ["doc_id", "layer_id"], "left")
    use = F.col("kl").isNotNull() & ~F.col("given")
    return both.select("doc_id", "layer_id", *[F.when(use, F.col(f"k{c}")).otherwise(F.col(c)).alias(c) for c in "ltwh"])


def flowing(layers: DataFrame) -> DataFrame:  # W11
    """doc_id, layer_id, filters: what adjustments above a layer, on its own level and on its ancestors', do to it.

    On each level the unclipped adjustments before the layer act in order, then the sum of the clipped
    ones since the last layer; outer levels act first. Hidden and masked adjustments don't flow.
    """
    keys = ["doc_id", "parent_id"]
    layers, pixel, vector = _masked(layers)
    is_adj = F.col("adjustment").isNotNull()
    acts = is_adj & ~F.coalesce("hidden", F.lit(False)) & ~pixel & ~vector
    rows = layers.withColumn("_m", F.when(is_adj, map_adjustment(F.col("adjustment"))["filters"]))
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_block", F.coalesce(F.sum(F.when(is_adj, 0).otherwise(1)).over(w), F.lit(0)))
    wb = Window.partitionBy(*keys, "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    clipped = F.coalesce("clipping", F.lit(False))
    pick = lambda c: F.when(acts & c & has_filters(F.col("_m")), F.struct("ord", "_m"))
    maps = lambda pairs: F.transform(pairs, lambda p: p["_m"])
    rows = rows.withColumn("_flow", F.concat(maps(F.collect_list(pick(~clipped)).over(w)), F.array(combine_filters(maps(F.collect_list(pick(clipped)).over(wb))))))
    nodes = layers.select("doc_id", F.col("layer_id").alias("node_id"), "parent_id")
    up = tree.closure(nodes).withColumnRenamed("ancestor_id", "layer_id")
    path = up.join(rows.select("doc_id", "layer_id", "_flow"), ["doc_id", "layer_id"]).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct(F.col("distance").alias("d"), F.col("_flow").alias("f"))), lambda a, b: b["d"] - a["d"]).alias("p"))
    return path.select("doc_id", F.col("node_id").alias("layer_id"), combine_filters(F.flatten(F.transform("p", lambda x: x["f"]))).alias("filters"))


NEEDED = ("layer_id", "parent_id", "ord", "_l", "_t", "_w", "_h", "_given", "shown", "is_adj", "masked", "_clip", "_effect", "_image")
FOLDED = f"first boolean, is_group boolean, l double, t double, w double, h double, ol double, ot double, ow double, oh double, _flow array<array<{EMPTY}>>, reaches boolean"


def _folded(ids, parents, ords, left, top, width, height, given, shown, is_adj, masked, clipped, effects, image):
    """What `boxes`, `flowing` and `masked_overlays` find, for one document's layers in their order; an effect is a shown adjustment's filters."""
    n, at, levels = len(ids), {}, {}
    for i in range(n):
        at.setdefault(ids[i], i)
        levels.setdefault(parents[i], []).append(i)
    at.pop(None, None)
    up = [at.get(p) for p in parents]
    below = [levels.get(i, ()) if i is not None else () for i in ids]
    order = [i for i in range(n) if up[i] is None]
    for i in order:
        if below[i] and at[ids[i]] == i:
            order.extend(below[i])
    if len(order) < n:
        raise ValueError("the parents form a cycle")
    # NaN is the greatest number, as in Spark
    more = lambda a, b: b if b != b or b > a else a
    less = lambda a, b: b if a != a or b < a else a
    box = []
    for i in range(n):
        if given[i] or not below[i]:
            box.append((left[i], top[i], width[i], height[i]))
            continue
        kids = [k for k in below[i] if shown[k]]
        if not kids:
            box.append((0.0, 0.0, 1.0, 1.0))
            continue
        k = kids[0]
        l, t, r, b = left[k], top[k], left[k] + width[k], top[k] + height[k]  # noqa: E741
        for k in kids[1:]:
            l, t, r, b = less(l, left[k]), less(t, top[k]), more(r, left[k] + width[k]), more(b, top[k] + height[k])  # noqa: E741
        box.append((l, t, more(1.0, r - l), more(1.0, b - t)))
    flow, reaches = [[]] * n, [False] * n
    drawn = [image[i] and not below[i] for i in range(n)]
    for i in reversed(order):
        if drawn[i] and up[i] is not None:
            drawn[up[i]] = True
    for level in levels.values():
        if not any(effects[i] for i in level):
            continue
        free, block = [], []
        for i in level:
            flow[i] = [*free, [*block]] if block else [*free]
            if not is_adj[i]:
                block = []
            elif effects[i] and not masked[i]:
                if clipped[i]:
                    block.append(effects[i])
                else:
                    free.append([effects[i]])
        # backwards: whether an image follows, and whether the next ordinary layer is or holds one
        some = following = False
        later, ordinal = [], None
        for i in reversed(level):
            if ords[i] is None:
                break
            if ords[i] != ordinal:
                for k in later:
                    some, following = some or drawn[k], drawn[k]
                later, ordinal = [], ords[i]
            if not is_adj[i]:
                later.append(i)
            elif effects[i] and masked[i]:
                reaches[i] = following if clipped[i] else some
    for i in order:
        if up[i] is not None and flow[up[i]]:
            flow[i] = flow[up[i]] + flow[i]
    none = (None,) * 4
    outer = [none if u is None else box[u] for u in up]
    plain = [None if is_adj[i] or below[i] else flow[i] for i in range(n)]
    return [True] + [False] * (n - 1), [bool(b) for b in below], *map(list, zip(*box, strict=True)), *map(list, zip(*outer, strict=True)), plain, reaches


def import_layers(layers: DataFrame, text_mode: str = "editable", unsupported: str = "rasterize") -> tuple[DataFrame, DataFrame]:  # S2, P21 to P24, X8, P37
    """(nodes, report items). Options are literals, so the branches fold away.

    Each document's tree is folded in one pass and the rows are written once: nodes and items are branches of that
    table, without a join or a window of their own.
    """
    layers, pixel, vector = _masked(layers)
    is_adj, shown = F.col("adjustment").isNotNull(), ~F.coalesce("hidden", F.lit(False))
    editable = F.col("text").isNotNull() & F.lit(text_mode == "editable")
    pixels = F.coalesce("has_pixels", F.lit(False))
    left, top = F.coalesce("left", F.lit(0.0)), F.coalesce("top", F.lit(0.0))
    rows = layers.withColumns({"is_adj": is_adj, "shown": shown, "masked": pixel | vector, "pixel_masked": pixel, "vector_masked": vector, "mapping": F.when(is_adj, map_adjustment(F.col("adjustment"))), "_type": F.col("adjustment.type")})
    rows = rows.withColumns({"_l": left, "_t": top, "_w": F.greatest(F.lit(1.0), F.coalesce("right", left + 1) - left), "_h": F.greatest(F.lit(1.0), F.coalesce("bottom", top + 1) - top), "_given": F.col("right").isNotNull() & F.col("bottom").isNotNull()})
    rows = rows.withColumns({"_clip": F.coalesce("clipping", F.lit(False)), "_effect": F.when(F.col("shown") & has_filters(F.col("mapping.filters")), F.col("mapping.filters")), "_image": ~is_adj & pixels & ~editable & F.lit(unsupported != "skip")})
    rows = ordered.fold_documents(rows.drop("adjustment", "left", "top", "right", "bottom", "hidden", "clipping"), NEEDED, _folded, FOLDED, ["ord", "layer_id"])
    has_text = F.coalesce(F.col("text.characters"), F.lit(""))
    decision = F.when(F.col("is_adj"), "adjustment").when(F.col("is_group"), "group").when(editable & (has_text != ""), "text").when(editable, "nothing").when(F.lit(unsupported == "skip"), "skipped").when(pixels, "raster").otherwise("empty")
    filters = combine_filters(F.transform(F.coalesce("_flow", F.array().cast(f"array<array<{EMPTY}>>")), combine_filters))
    rows = cut(rows.withColumns({"filters": filters, "decision": decision}).drop("_flow", "_given", "_clip", "_image", "_l", "_t", "_w", "_h"))
    drawn = F.col("decision").isin("adjustment", "group", "text", "raster")
    live = rows.filter(drawn & F.col("layer_id").isNotNull())
    name = F.coalesce("name", F.when(F.col("is_adj"), F.col("_type")), F.element_at(F.create_map(*[F.lit(x) for kv in {"group": "Group", "text": "Text", "raster": "Pixel Layer"}.items() for x in kv]), F.col("decision")))
    x, y = F.when(F.col("is_adj"), 0.0).otherwise(F.col("l") - F.coalesce("ol", F.lit(0.0))), F.when(F.col("is_adj"), 0.0).otherwise(F.col("t") - F.coalesce("ot", F.lit(0.0)))
    width, height = F.when(F.col("is_adj"), F.coalesce("ow", "w")).otherwise(F.col("w")), F.when(F.col("is_adj"), F.coalesce("oh", "h")).otherwise(F.col("h"))
    wrap = F.col("masked") & (F.col("decision") != "group")
    kind = F.when(F.col("decision") == "group", "group").when(F.col("decision") == "text", "text").otherwise("image")
    flat = F.when(F.col("is_adj"), F.col("mapping.filters")).when(F.col("decision") == "raster", F.col("filters"))
    fill = F.when(F.col("text.r").isNotNull(), color(unit_channel(F.col("text.r")), unit_channel(F.col("text.g")), unit_channel(F.col("text.b")), unit_channel(F.coalesce("text.a", F.lit(1.0))))).otherwise(hex_color(F.lit("111111")))
    base = live.withColumns({"_name": name, "_x": x, "_y": y, "_w": width, "_h": height, "_wrap": wrap, "_kind": kind, "_filters": F.when(has_filters(flat), flat), "_fill": F.when(F.col("decision") == "text", fill)})
    cols = lambda id_, parent, order, kind, nm, px, py, opacity, visible, blend, filters, own: ["doc_id", id_.alias("node_id"), parent.alias("parent_id"), order.alias("ord"), kind.alias("type"), nm.alias("name"), px.alias("x"), py.alias("y"), F.col("_w").alias("width"), F.col("_h").alias("height"), opacity.alias("opacity"), visible.alias("visible"), blend.alias("blend_mode"), filters.alias("filters"), *[F.when(own & (F.col("decision") == "text"), c).alias(n) for n, c in (("characters", F.col("text.characters")), ("font_family", F.coalesce("text.font", F.lit("Arial"))), ("font_size", F.greatest(F.lit(1.0), F.coalesce("text.size", F.lit(16.0)))), ("align", text_align(F.col("text.justification"))), ("fill", F.col("_fill")))], (own & F.lit(False)).alias("is_mask"), F.lit(None).cast("double").alias("blur")]
    none = F.lit(None).cast(EMPTY)
    id_ = F.col("layer_id").cast("string")
    outer_nodes = base.select(*cols(id_, F.col("parent_id").cast("string"), F.col("ord"), F.when(F.col("_wrap"), "group").otherwise(F.col("_kind")), F.col("_name"), F.col("_x"), F.col("_y"), unit_opacity(F.col("opacity")), F.col("shown"), F.col("blend_mode"), F.when(~F.col("_wrap"), F.col("_filters")), ~F.col("_wrap")))
    content = base.filter("_wrap").select(*cols(F.concat(id_, F.lit(":content")), id_, F.lit(1), F.col("_kind"), F.concat("_name", F.lit(" content")), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(True), F.lit("normal"), F.col("_filters"), F.lit(True)))

    def mask_nodes(kind: str, suffix: str, order: int) -> DataFrame:
        feather = F.col(f"{kind}mask_feather")
        got = base.filter(f"{kind or 'pixel_'}masked").select(*cols(F.concat(id_, F.lit(suffix)), id_, F.lit(order), F.lit("image"), F.concat("_name", F.lit(f" {kind.replace('_', ' ')}mask")), F.lit(0.0), F.lit(0.0), F.coalesce(f"{kind}mask_density", F.lit(1.0)), F.lit(True), F.lit(None).cast("string"), none, F.lit(False)), feather.alias("_feather"))
        return got.withColumns({"is_mask": F.lit(True), "blur": F.when(F.col("_feather") > 0, F.col("_feather"))}).drop("_feather")

    nodes = outer_nodes.unionByName(content).unionByName(mask_nodes("", ":mask", -1)).unionByName(mask_nodes("vector_", ":vector-mask", 0))
    # an overlay that reaches no image, neither a layer nor one in a group, changes nothing
    overlay = F.col("is_adj") & F.col("masked") & F.col("shown") & has_filters(F.col("mapping.filters"))
    names = lambda c: F.array_join(f"mapping.{c}", ", ")
    said = [
        (F.col("decision") == "empty", "PSD_EMPTY_LAYER", "a layer without pixels was skipped"), (F.col("decision") == "raster", "PSD_RASTER_LAYER", "pixels were kept as an image"), (F.col("decision") == "skipped", "PSD_LAYER_SKIPPED", "skipped by the chosen strategy"),
        ((F.col("decision") == "text") & has_filters(F.col("filters")), "PSD_ADJUSTMENT_NON_IMAGE_TARGET", "image filters don't apply to text"), (F.col("pixel_masked") & drawn, "PSD_PIXEL_MASK_NATIVE", "the mask was kept"), (F.col("vector_masked") & drawn, "PSD_VECTOR_MASK_NATIVE", "the vector mask was kept"),
        (overlay & ~F.col("reaches"), "PSD_MASKED_ADJUSTMENT_EMPTY", "no image lies in its reach"), (overlay, "PSD_MASKED_ADJUSTMENT_NATIVE", "rebuilt as a mask with filtered copies"), (F.col("is_adj") & (F.size("mapping.mapped") > 0), "PSD_ADJUSTMENT_NATIVE", names("mapped")), (F.col("is_adj") & (F.size("mapping.unsupported") > 0), "PSD_ADJUSTMENT_PARTIAL", names("unsupported")),
    ]
    told = [F.when(F.col("layer_id").isNotNull() & when, item(code, m if isinstance(m, Column) else F.lit(m), F.col("name"))) for when, code, m in said]
    told.append(F.when(F.col("first"), item("PSD_IMPORT", F.lit("layers were imported"))))
    return nodes, rows.select("doc_id", F.explode(F.filter(F.array(*told), lambda i: i.isNotNull())).alias("i")).select("doc_id", "i.*")


def masked_overlays(layers: DataFrame) -> DataFrame:  # W11
    """doc_id, overlay_id, layer_id, filters: ordinary layers that each masked adjustment copies and filters.

    A clipped one reaches the next ordinary layer of its level, any other all that follow.
    """
    layers, pixel, vector = _masked(layers)
    is_adj = F.col("adjustment").isNotNull()
    keys = ["doc_id", "parent_id"]
    o = layers.filter(is_adj & (pixel | vector) & ~F.coalesce("hidden", F.lit(False)))
    o = o.select("doc_id", F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("_p"), F.col("layer_id").alias("overlay_id"), F.col("ord").alias("o_ord"), F.coalesce("clipping", F.lit(False)).alias("clip"), map_adjustment(F.col("adjustment"))["filters"].alias("filters")).filter(has_filters(F.col("filters")))
    plain = layers.filter(~is_adj).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    n_before = plain.select("doc_id", F.coalesce(F.col("parent_id").cast("string"), F.lit("")).alias("_p"), "layer_id", "ord", "_n")
    hit = o.join(n_before, ["doc_id", "_p"]).filter("ord > o_ord")
    first = Window.partitionBy("doc_id", "overlay_id").orderBy("ord")
    return hit.withColumn("_r", F.row_number().over(first)).filter("not clip or _r = 1").select("doc_id", "overlay_id", "layer_id", "filters")


def image_offset(left: Column, top: Column, relative: Column, layer_left: Column, layer_top: Column) -> Column:  # X7
    """Where a mask starts within its layer."""
    l, t = F.coalesce(left, F.lit(0.0)), F.coalesce(top, F.lit(0.0))  # noqa: E741
    return F.struct(F.when(relative, l).otherwise(l - layer_left).alias("x"), F.when(relative, t).otherwise(t - layer_top).alias("y"))
