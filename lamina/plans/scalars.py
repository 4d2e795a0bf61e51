"""Scalar and array functions bound to the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import filters, geometry, pixels, strings
from lamina.session import table as T
from lamina.sources import packages


def format_router(spark, d):
    url = F.regexp_replace("url", r"[?#].*$", "")
    name = F.concat(url, F.lit("."), F.element_at(F.array(*map(F.lit, ("pptx", "PSD", "ai", "svg", "pdf", "zip", "txt"))), (F.col("page_id") % 7 + 1).cast("int")))
    return T(spark, d, "pages").select("page_id", name.alias("n")).select("page_id", strings.file_extension(F.col("n")).alias("extension"), strings.detect_format(F.col("n")).alias("format"), strings.is_zip(F.col("n")).alias("zip"))


FORMAT_ROUTER = """
with p as (select page_id, regexp_replace(url, '[?#].*$', '') || '.' || ['pptx','PSD','ai','svg','pdf','zip','txt'][page_id % 7 + 1] as n from pages),
q as (select page_id, n, lower(string_split(n, '.')[-1]) as e from p)
select page_id, e as extension, case when e in ('pptx','psd') then e when e in ('ai','svg','pdf') then 'ai' end as format, ends_with(lower(n), '.zip') as zip from q"""


def size_guard(spark, d):
    """S18: each text is a file whose length stands for kilobytes of its kind; a source with a file over the limit is refused."""
    kind = F.when(F.col("lang") == "en", ".pptx").otherwise(".ai")
    rows = T(spark, d, "documents").select("source", F.concat(F.col("doc_id").cast("string"), kind).alias("name"), (F.coalesce(F.length("text"), F.lit(0)).cast("long") * 250_000).alias("size"))
    over = packages.oversized(rows).groupBy("source").agg(F.count("*").alias("oversized"))
    files = rows.groupBy("source").agg(F.count("*").alias("files"), F.max("size").alias("largest"))
    return files.join(over, "source", "left").select("source", "files", F.coalesce("oversized", F.lit(0)).alias("oversized"), "largest", F.col("oversized").isNull().alias("accepted"))


SIZE_GUARD = """
select source, count(*) as files, count(*) filter (where n > most) as oversized, max(n) as largest, count(*) filter (where n > most) = 0 as accepted
from (select source, coalesce(length(text), 0) * 250000::bigint as n, case when lang = 'en' then 500 * 1048576::bigint else 1536 * 1048576::bigint end as most from documents) group by source"""


def natural_sort(spark, d):
    rows = T(spark, d, "documents").select("source").distinct()
    return rows.select("source", strings.natural_key(F.col("source")).alias("sort_key"), F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("number"))


NATURAL_SORT = r"""
select distinct source, regexp_extract(source, '^(\D+)', 1) || lpad(cast(length(regexp_extract(source, '(\d+)', 1)) as varchar), 4, '0') || regexp_extract(source, '(\d+)', 1) as sort_key,
cast(regexp_extract(source, '(\d+)', 1) as integer) as number from documents"""


def path_normalize(spark, d):
    path = F.concat(F.lit("../media/./"), F.col("role"), F.lit("/../img"), F.col("turn").cast("string"), F.lit(".PNG"))
    base = F.concat(F.lit("ppt/slides/s"), F.col("conv_id").cast("string"), F.lit(".xml"))
    return T(spark, d, "conversations").select("conv_id", "turn", strings.normalize_path(base, path).alias("path"), strings.normalize_path(base, F.concat(F.lit("/a//b/../../../"), F.col("role"))).alias("absolute"))


PATH_NORMALIZE = "select conv_id, turn, 'ppt/media/img' || turn || '.PNG' as path, role as absolute from conversations"


def mime_map(spark, d):
    name = F.concat(F.col("p_name"), F.lit("."), F.element_at(F.array(*map(F.lit, ("png", "JPG", "svg", "tiff", "webp", "bin"))), (F.col("p_partkey") % 6 + 1).cast("int")))
    return T(spark, d, "part").select("p_partkey", strings.mime_type(name).alias("mime"))


MIME_MAP = "select p_partkey, ['image/png','image/jpeg','image/svg+xml','image/tiff','image/webp','application/octet-stream'][p_partkey % 6 + 1] as mime from part"


def style_extract(spark, d):
    css = F.regexp_extract("html", "(?s)<style>(.*?)</style>", 1)
    decl = F.regexp_extract(css, r"\{([^}]*)\}", 1)
    extra = F.concat(decl, F.lit(";fill: url(#a:b) ;fill:"), F.col("page_id").cast("string"))
    m = strings.declarations(extra)
    return T(spark, d, "pages").select("page_id", F.map_keys(m).alias("k"), m["margin"].alias("margin"), m["fill"].alias("fill")).select("page_id", F.array_join(F.array_sort("k"), ",").alias("names"), "margin", "fill")


STYLE_EXTRACT = r"""
with s as (select page_id, regexp_extract(regexp_extract(html, '<style>(.*?)</style>', 1, 's'), '\{([^}]*)\}', 1) as decl from pages)
select page_id, case when decl like '%margin:%' then 'fill,margin' else 'fill' end as names,
case when decl like '%margin:%' then trim(regexp_extract(decl, 'margin:([^;]*)', 1)) end as margin, cast(page_id as varchar) as fill from s"""


def null_strip(spark, d):
    dirty = F.concat(F.col("text"), F.lit("\u0000&ns_ai;\u0000adobe-blending-mode: ColorBurn;"), F.col("source"))
    out = strings.normalize_svg(dirty)
    return T(spark, d, "documents").select("doc_id", strings.null_count(dirty).alias("nulls"), out.alias("xml"))


#: For texts without entities and blending modes of their own; tests/test_whole_texts.py has such texts.
NULL_STRIP = "select doc_id, 2 + length(text) - length(replace(text, chr(0), '')) as nulls, replace(text, chr(0), '') || 'http://ns.adobe.com/AdobeIllustrator/10.0/mix-blend-mode:color-burn;' || source as xml from documents"


def blend_map(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("source-over", "color-burn", "Soft Light", "hardLight", "pass-through", "linear-dodge", "nonsense"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return T(spark, d, "part").select("p_partkey", strings.sink_blend(raw).alias("sink"), strings.pdf_blend(raw).alias("pdf"), strings.sink_blend(F.col("p_type")).alias("of_type"))


BLEND_MAP = """
select p_partkey, ['NORMAL','COLOR_BURN','SOFT_LIGHT','NORMAL','PASS_THROUGH','LINEAR_DODGE','NORMAL'][p_partkey % 7 + 1] as sink,
['normal','color-burn','soft light','hard-light','pass-through','linear-dodge','nonsense'][p_partkey % 7 + 1] as pdf, 'NORMAL' as of_type from part"""


def normalized_key(spark, d):
    return T(spark, d, "part").select("p_partkey", strings.separators_off(F.col("p_name")).alias("family_key"), strings.font_key(F.col("p_brand"), F.col("p_type")).alias("font_key"), strings.element_name(F.lit(""), F.concat(F.col("p_name"), F.lit("_x5f_a")), F.lit("x")).alias("element"))


NORMALIZED_KEY = r"""
select p_partkey, regexp_replace(lower(p_name), '[\s._-]+', '', 'g') as family_key, lower(trim(p_brand) || '::' || trim(p_type)) as font_key, p_name || '_a' as element from part"""


def number_formats(spark, d):
    v = F.col("l_extendedprice") * F.col("l_discount")
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", strings.format_bytes((F.col("l_extendedprice") * 100).cast("long"), ties_to_even=True).alias("size_label"), strings.parse_float(F.concat(F.col("l_quantity").cast("string"), F.lit("px"))).alias("length"), strings.js_number(F.lit("")).alias("blank"), strings.js_round(v).alias("rounded"))


NUMBER_FORMATS = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
case when s < 1048576 then cast(cast(greatest(1, floor(s / 1024 + 0.5)) as bigint) as varchar) || ' KB' else printf('%.1f MB', s / 1024 / 1024) end as size_label,
l_quantity as length, 0.0::double as blank, cast(floor(l_extendedprice * l_discount + 0.5) as bigint) as rounded
from (select *, cast(trunc(l_extendedprice * 100) as bigint) as s from lineitem)"""


def round_js(spark, d):
    return T(spark, d, "orders").select("o_orderkey", strings.js_round(F.col("o_totalprice") / 2 - 50000).alias("rounded"), strings.utf16_length(F.col("o_orderpriority")).alias("units"))


ROUND_JS = "select o_orderkey, cast(floor(o_totalprice / 2 - 50000 + 0.5) as bigint) as rounded, length(o_orderpriority) as units from orders"


def hex_color(spark, d):
    h = F.lpad(F.lower(F.hex((F.col("doc_id") * 7919) % 16777216)), 6, "0")
    c, short = geometry.hex_color(F.concat(F.lit("#"), h)), geometry.parse_color(F.concat(F.lit("#"), F.substring(h, 1, 3)))
    return T(spark, d, "documents").select("doc_id", c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), short["r"].alias("short_r"), geometry.css_hex(F.array(c["r"], c["g"], c["b"])).alias("css"), geometry.parse_color(F.lit("rgba(255, 0, 51, 0.5)"))["a"].alias("alpha"), geometry.parse_color(F.lit("Grey"))["g"].alias("grey"))


HEX_COLOR = """
with n as (select doc_id, (doc_id * 7919) % 16777216 as v from documents)
select doc_id, (v // 65536) / 255.0::double as r, (v // 256 % 256) / 255.0::double as g, (v % 256) / 255.0::double as b,
(v // 1048576 * 17) / 255.0::double as short_r, '#' || lower(lpad(printf('%x', v), 6, '0')) as css, 0.5::double as alpha, 128 / 255.0::double as grey from n"""


def emu_transform(spark, d):
    s = lambda c: F.col(c).cast("string")
    box = geometry.transform_box(s("l_partkey"), s("l_suppkey"), s("l_orderkey"), F.lit("abc"), s("l_linenumber"))
    scale = geometry.child_scale(F.col("l_quantity"), F.col("l_linenumber") - 1.0)
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", box["x"].alias("x"), box["y"].alias("y"), box["width"].alias("width"), box["height"].alias("height"), box["rotation"].alias("rotation"), scale.alias("scale"))


EMU_TRANSFORM = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey / 9525.0::double as x, l_suppkey / 9525.0::double as y, greatest(1.0::double, l_orderkey / 9525.0::double) as width,
1.0::double as height, l_linenumber / 60000.0::double as rotation, l_quantity / coalesce(nullif(l_linenumber - 1.0::double, 0), l_quantity) as scale from lineitem"""


def matrix_chain(spark, d):
    n = lambda c: F.format_string("%d", c)
    t = F.concat(F.lit("translate("), n(F.col("p_size")), F.lit(", "), n(F.col("p_partkey") % 100), F.lit(") scale(2,3) translate(1)"))
    m = geometry.parse_transform(t)
    back = geometry.apply_matrix(geometry.inverse(m), F.get(m, F.lit(4)), F.get(m, F.lit(5)))
    box = geometry.corner_bounds(geometry.matrix(0, 1, -1, 0, 0, 0), F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(10.0))
    return T(spark, d, "part").select("p_partkey", F.get(m, F.lit(0)).alias("a"), F.get(m, F.lit(3)).alias("d"), F.get(m, F.lit(4)).alias("e"), F.get(m, F.lit(5)).alias("f"), (F.abs(back["x"]) < 1e-9).alias("x0"), box["left"].alias("left"), box["bottom"].alias("bottom"), strings.matrix_string(m).alias("css"), geometry.only_translation(t)["y"].alias("ty"))


MATRIX_CHAIN = """
select p_partkey, 2.0::double as a, 3.0::double as d, p_size + 2.0::double as e, (p_partkey % 100)::double as f, true as x0, -10.0::double as left, p_size::double as bottom,
'matrix(2 0 0 3 ' || (p_size + 2) || ' ' || (p_partkey % 100) || ')' as css, (p_partkey % 100)::double as ty from part"""


def adjustment_map(spark, d):
    v = F.col("value")
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "brightness/contrast", "purchase", "exposure", "view", "vibrance", "click", "levels", "error", "invert")])
    names = ("type", "brightness", "contrast", "legacy", "exposure", "gamma", "offset", "saturation", "vibrance", "hue", "lightness", "per_color", "shadow_in", "highlight_in", "shadow_out", "highlight_out", "midtone", "per_channel", "points", "tones", "r", "g", "b", "density", "tinted", "monochrome")
    given = {"type": kinds[F.col("event_type")], "brightness": v, "contrast": -v, "exposure": v / 10, "gamma": F.lit(0.4), "offset": F.lit(0.1), "saturation": v, "vibrance": v, "shadow_in": F.lit(10.0), "highlight_in": F.lit(245.0), "shadow_out": F.lit(5.0), "highlight_out": F.lit(250.0), "midtone": F.lit(0.8)}
    types = {"legacy": "boolean", "per_color": "boolean", "per_channel": "boolean", "tinted": "boolean", "monochrome": "boolean", "points": "array<struct<input:double,output:double>>", "tones": "array<struct<name:string,cyan_red:double,magenta_green:double,yellow_blue:double>>"}
    a = F.struct(*[(given[n] if n in given else F.lit(None).cast(types.get(n, "double"))).alias(n) for n in names])
    m = filters.map_adjustment(a)
    f = lambda k: F.round(F.try_element_at(m["filters"], F.lit(k)), 9)
    return T(spark, d, "events").select("event_id", f("exposure").alias("exposure"), f("contrast").alias("contrast"), f("saturation").alias("saturation"), f("shadows").alias("shadows"), F.array_join(m["unsupported"], ",").alias("unsupported"), filters.has_filters(m["filters"]).alias("any"))


ADJUSTMENT_MAP = """
with e as (select *, greatest(-1, least(1, value / 150)) as b150, greatest(-1, least(1, -value / 100)) as c100, greatest(-1, least(1, value / 10 / 20)) as e200, greatest(-1, least(1, value * 1.5 / 100)) as s100 from events)
select event_id,
round(case event_type when 'signup' then b150 when 'purchase' then e200 when 'click' then (1 - 0.8::double) / 2 end, 9) as exposure,
round(case event_type when 'signup' then c100 when 'click' then 255.0::double / 235 - 1 end, 9) as contrast,
round(case event_type when 'view' then s100 end, 9) as saturation,
round(case event_type when 'purchase' then 0.2::double when 'click' then -5 / 255.0::double end, 9) as shadows,
case event_type when 'error' then 'invert' else '' end as unsupported,
case event_type when 'signup' then value <> 0 when 'purchase' then true when 'view' then value <> 0 when 'click' then true else false end as any from e"""


def curve_sample(spark, d):
    points = F.transform("embedding", lambda v, i: F.struct((i * 32).cast("double").alias("input"), v.cast("double").alias("output")))
    s = lambda x: F.round(filters.sample_curve(points, x), 9)
    return T(spark, d, "embeddings").select("vec_id", s(64).alias("at_64"), s(80).alias("at_80"), s(1e6).alias("beyond"), s(-5).alias("below"))


CURVE_SAMPLE = """
select vec_id, round(embedding[3]::double, 9) as at_64, round(embedding[3]::double + (embedding[4]::double - embedding[3]::double) * 0.5, 9) as at_80,
round(embedding[-1]::double, 9) as beyond, round(embedding[1]::double, 9) as below from embeddings"""


def pixel_overlay(spark, d):
    byte = lambda k: F.transform(F.slice("embedding", k, 8), lambda v: (F.floor(v.cast("double") * 1000 + 512) % 256).cast("int"))
    back, comp, src = byte(1), byte(9), byte(17)
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return T(spark, d, "embeddings").select("vec_id", text(pixels.normal_overlay(back, comp, src, F.lit(0.5))).alias("overlay"), text(pixels.restore_opacity(src, F.lit(0.5))).alias("restored"), text(pixels.least_alpha_overlay(back, comp)).alias("least"), pixels.any_visible(src).alias("visible"))


_CH = "cast(floor(greatest(0.0::double, least(1.0::double, (c[{i}]/255.0::double - b[{i}]/255.0::double*(1-{a}))/{a}))*255 + 0.5) as integer)"


def _overlay_sql(p: int, a: str) -> str:
    ch = ", ".join(_CH.format(i=p * 4 + k, a=a) for k in (1, 2, 3))
    return f"case when {a} <= 1/255.0::double then [0,0,0,0] else [{ch}, cast(floor({a}*255+0.5) as integer)] end"


def _need_sql(p: int) -> str:
    one = "case when c[{i}] > b[{i}] then (c[{i}]/255.0::double - b[{i}]/255.0::double)/(1 - b[{i}]/255.0::double) when c[{i}] < b[{i}] then (b[{i}]/255.0::double - c[{i}]/255.0::double)/(b[{i}]/255.0::double) else 0.0::double end"
    return "greatest(" + ", ".join(one.format(i=p * 4 + k) for k in (1, 2, 3)) + ")"


PIXEL_OVERLAY = f"""
with v as (select vec_id, list_transform(embedding[1:8], lambda x: cast(floor(x::double*1000+512) as bigint) % 256) as b, list_transform(embedding[9:16], lambda x: cast(floor(x::double*1000+512) as bigint) % 256) as c,
list_transform(embedding[17:24], lambda x: cast(floor(x::double*1000+512) as bigint) % 256) as s from embeddings),
n as (select *, s[4]/255.0::double*0.5::double as a1, s[8]/255.0::double*0.5::double as a2, {_need_sql(0)} as m1, {_need_sql(1)} as m2 from v),
q as (select *, case when m1 <= 1/255.0::double then 0.0::double else least(1.0::double, ceil(m1*255)/255.0::double) end as q1, case when m2 <= 1/255.0::double then 0.0::double else least(1.0::double, ceil(m2*255)/255.0::double) end as q2 from n)
select vec_id, array_to_string(list_concat({_overlay_sql(0, "a1")}, {_overlay_sql(1, "a2")}), ',') as overlay,
array_to_string([s[1],s[2],s[3],least(255, cast(floor(s[4]/0.5::double+0.5) as bigint)),s[5],s[6],s[7],least(255, cast(floor(s[8]/0.5::double+0.5) as bigint))], ',') as restored,
array_to_string(list_concat({_overlay_sql(0, "q1")}, {_overlay_sql(1, "q2")}), ',') as least, (s[4] > 0 or s[8] > 0) as visible from q"""


def tile_explode(spark, d):
    rows = T(spark, d, "part").select("p_partkey", (F.col("p_size") * 300).alias("w"), (F.col("p_size") * 250).alias("h"))
    return rows.select("p_partkey", F.posexplode(geometry.tiles(F.col("w"), F.col("h"))).alias("tile", "t")).select("p_partkey", "tile", "t.x", "t.y", "t.width", "t.height")


TILE_EXPLODE = """
with p as (select p_partkey, p_size*300 as w, p_size*250 as h from part),
t as (select p_partkey, w, h, unnest(range(0, h, 4096)) as y from p), u as (select *, unnest(range(0, w, 4096)) as x from t)
select p_partkey, cast(y // 4096 * ((w + 4095) // 4096) + x // 4096 as integer) as tile, cast(x as integer) as x, cast(y as integer) as y, cast(least(4096, w - x) as integer) as width, cast(least(4096, h - y) as integer) as height from u"""


def sink_defaults(spark, d):
    """K1 to K6: defaults and clamps of the sink view."""
    from lamina.sources.sink import sink_view

    p = T(spark, d, "part")
    nodes = p.select(
        F.lit("d").alias("doc_id"), F.col("p_partkey").cast("string").alias("node_id"), F.when(F.col("p_size") % 3 == 0, "group").when(F.col("p_size") % 3 == 1, "polygon").otherwise("text").alias("type"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_size") / 20 - 0.5).alias("opacity"), F.when(F.col("p_size") % 2 == 0, F.lit(False)).alias("visible"), F.when(F.col("p_size") % 4 == 0, "soft-light").alias("blend_mode"),
    )
    return sink_view(nodes).select(F.col("node_id").cast("long").alias("p_partkey"), "type", F.round("opacity", 9).alias("opacity"), "visible", "locked", "rotation", "blend_mode", "point_count")


SINK_DEFAULTS = """
select p_partkey, case p_size % 3 when 0 then 'GROUP' when 1 then 'POLYGON' else 'TEXT' end as type, round(greatest(0.0::double, least(1.0::double, coalesce(case when p_size % 5 > 0 then p_size / 20.0::double - 0.5::double end, 1.0::double))), 9) as opacity,
p_size % 2 <> 0 as visible, false as locked, 0.0::double as rotation, case when p_size % 4 = 0 then 'SOFT_LIGHT' when p_size % 3 = 0 then 'PASS_THROUGH' else 'NORMAL' end as blend_mode, case when p_size % 3 = 1 then 3 end as point_count from part"""

QUERIES = {
    k: (globals()[k], globals()[k.upper()])
    for k in ("format_router", "size_guard", "natural_sort", "path_normalize", "mime_map", "style_extract", "null_strip", "blend_map", "normalized_key", "number_formats", "round_js", "hex_color", "emu_transform", "matrix_chain", "adjustment_map", "curve_sample", "pixel_overlay", "tile_explode", "sink_defaults")
}
