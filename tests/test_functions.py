"""Golden vectors of scalar functions."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import filters, geometry, pixels, strings


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict(recursive=True)


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_colors(spark):
    r = one(spark, a=geometry.hex_color(F.lit("#0af")), b=geometry.parse_color(F.lit("none")), c=geometry.parse_color(F.lit("nonsense")), d=geometry.css_hex(arr(1, 0.5, 0)), e=geometry.css_hex(arr(255, 128, 0)))
    assert r["a"] == {"r": 0.0, "g": 170 / 255, "b": 1.0, "a": 1.0} and r["b"] is None and r["c"] is None
    assert r["d"] == "#ff8000" == r["e"]


def test_matrices(spark):
    m = geometry.parse_transform(F.lit("rotate(90, 10, 20) scale(2)"))
    r = one(spark, p=geometry.apply_matrix(m, F.lit(5.0), F.lit(10.0)), i=geometry.inverse(geometry.matrix(1, 2, 2, 4, 0, 0)), g=geometry.gradient_transform(F.lit("linear"), F.lit(0.25), F.lit(1.0), F.lit(0.25), F.lit(0.0)), t=geometry.only_translation(F.lit("translate(10 5)")))
    assert r["p"]["x"] == pytest.approx(10) and r["p"]["y"] == pytest.approx(20)
    assert r["i"] == [1, 0, 0, 1, 0, 0] and r["t"] == {"x": 10.0, "y": 5.0}
    a, b, c, d, e, f = r["g"]
    assert [a, c, e] == pytest.approx([0, -1, 1]) and [b, d, f] == pytest.approx([1, 0, 0.25])


def test_strings(spark):
    r = one(
        spark,
        p=strings.normalize_path(F.lit("ppt/slides/slide1.xml"), F.lit("../media/./a.png")), up=strings.normalize_path(F.lit("a"), F.lit("../../b")),
        n=strings.format_number(F.lit(1.5)), w=strings.format_number(F.lit(2.0)), x=strings.format_number(F.lit(float("nan"))),
        svg=strings.svg_markup(F.lit('<svg:svg xmlns:svg="u" width="1"></svg:svg>')), same=strings.svg_markup(F.lit('<svg xmlns="u" a="1"/>')),
        k=F.array_sort(F.array(strings.natural_key(F.lit("s10")), strings.natural_key(F.lit("s2")))), u=strings.utf16_length(F.lit("a🙂b")),
        f=strings.pdf_font_family(F.lit("ABCDEF+Foo-Bold")), z=strings.parse_float(F.lit("12px")), q=strings.parse_float(F.lit("px"), 7.0), j=strings.js_number(F.lit(" 12 ")), bad=strings.js_number(F.lit("1x"), 3),
        fmt=strings.sniff_format(F.lit(b"%PDF-1.7")), none=strings.sniff_format(F.lit(b"hello")), loc=strings.locked_layer(F.lit("BG_Color")),
    )
    assert (r["p"], r["up"]) == ("ppt/media/a.png", "b")
    assert (r["n"], r["w"], r["x"]) == ("1.5", "2", "0")
    assert r["svg"] == '<svg xmlns="http://www.w3.org/2000/svg" width="1"></svg>' and r["same"] == '<svg xmlns="u" a="1"/>'
    assert r["k"][0].endswith("2") and r["u"] == 4 and r["f"] == "Foo-Bold"
    assert (r["z"], r["q"], r["j"], r["bad"]) == (12, 7, 12, 3) and (r["fmt"], r["none"], r["loc"]) == ("pdf", None, True)


def test_rounding_and_tiles(spark):
    r = one(spark, a=strings.js_round(F.lit(-2.5)), t=geometry.tiles(F.lit(3000), F.lit(6000)), u=geometry.tiles(F.lit(5000), F.lit(5000)), none=geometry.tiles(F.lit(0), F.lit(5)))
    assert r["a"] == -2 and len(r["t"]) == 2 and [t["width"] for t in r["u"]] == [4096, 904, 4096, 904] and r["none"] == []


def test_size_labels(spark):
    """Exact ties of the tenths: up as in the reference, or to the even digit as printf in SQL."""
    sizes = (6553600, 6029312, 6553599, 6553601, 1048575, 1)
    up, even = ([one(spark, s=strings.format_bytes(F.lit(n), ties_to_even=e))["s"] for n in sizes] for e in (False, True))
    assert up == ["6.3 MB", "5.8 MB", "6.2 MB", "6.3 MB", "1024 KB", "1 KB"]
    assert even == ["6.2 MB", "5.8 MB", "6.2 MB", "6.3 MB", "1024 KB", "1 KB"]


def test_clamped_filters(spark):
    m = F.array(F.create_map(F.lit("exposure"), F.lit(0.7), F.lit("contrast"), F.lit(-0.4)), F.create_map(F.lit("exposure"), F.lit(0.6), F.lit("saturation"), F.lit(0.25)))
    assert one(spark, f=filters.combine_filters(m))["f"] == {"exposure": 1.0, "contrast": -0.4, "saturation": 0.25}
    r = one(spark, f=filters.clamped_sum(F.array(F.lit(0.9), F.lit(0.9), F.lit(-0.5), F.lit(float("nan")), F.lit(None).cast("double"))))
    assert r["f"] == pytest.approx(0.5)  # a clamp of the total would give 1


def adjust(spark, **kv):
    names = [f.split(":")[0].strip() for f in filters.ADJUSTMENT[7:-1].replace("array<struct<input:double,output:double>>", "P").replace("array<struct<name:string,cyan_red:double,magenta_green:double,yellow_blue:double>>", "T").split(",")]
    types = {"type": "string", "points": "array<struct<input:double,output:double>>", "tones": "array<struct<name:string,cyan_red:double,magenta_green:double,yellow_blue:double>>"} | {k: "boolean" for k in ("legacy", "per_color", "per_channel", "tinted", "monochrome")}
    a = F.struct(*[(kv[n]() if callable(kv.get(n)) else F.lit(kv.get(n))).cast(types.get(n, "double")).alias(n) for n in names])
    return one(spark, m=filters.map_adjustment(a))["m"]


@pytest.mark.parametrize(
    "given, want, unsupported",
    [
        ({"type": "brightness/contrast", "brightness": 75, "contrast": -50}, {"exposure": 0.5, "contrast": -0.5}, []),
        ({"type": "exposure", "exposure": 10, "gamma": 0.4, "offset": 0.1}, {"exposure": 0.5, "shadows": 0.2, "highlights": 0.4}, []),
        ({"type": "levels", "shadow_in": 10, "highlight_in": 245, "shadow_out": 5, "highlight_out": 250, "midtone": 0.8}, {"shadows": -5 / 255, "highlights": 5 / 255, "exposure": 0.1, "contrast": 255 / 235 - 1}, []),
        ({"type": "invert"}, {}, ["invert"]),
        ({"type": "hue/saturation", "saturation": 13}, {"saturation": 0.13, "exposure": 0}, []),
        ({"type": "color balance", "tones": lambda: F.array(F.struct(F.lit("midtones"), F.lit(50.0), F.lit(0.0), F.lit(-20.0)))}, {"temperature": 0.45, "tint": 0.25}, []),
        ({"type": "black & white"}, {"saturation": -1}, []),
    ],
)
def test_adjustments(spark, given, want, unsupported):
    m = adjust(spark, **given)
    assert m["filters"] == pytest.approx(want) and m["unsupported"] == unsupported


def test_pixels(spark):
    px = F.array(*map(F.lit, (10, 20, 30, 64, 1, 2, 3, 128)))
    assert one(spark, p=pixels.restore_opacity(px, F.lit(0.5)))["p"] == [10, 20, 30, 128, 1, 2, 3, 255]
    back, comp = F.array(*map(F.lit, (32, 64, 96, 255))), F.array(*map(F.lit, (60, 84, 108, 255)))
    o = one(spark, p=pixels.normal_overlay(back, comp, F.array(*map(F.lit, (0, 0, 0, 128))), F.lit(0.5)))["p"]
    assert o[3] == 64
    for b, c, v in zip((32, 64, 96), (60, 84, 108), o, strict=False):
        assert abs(b * (1 - 64 / 255) + v * 64 / 255 - c) <= 0.5
    o = one(spark, p=pixels.least_alpha_overlay(back, F.array(*map(F.lit, (180, 24, 140, 255)))))["p"]
    assert 0 < o[3] < 255
    for b, c, v in zip((32, 64, 96), (180, 24, 140), o, strict=False):
        assert abs(b * (1 - o[3] / 255) + v * o[3] / 255 - c) <= 0.6
    r = one(spark, a=pixels.opacity_strategy(F.lit(0.4), F.lit(True), F.lit(True)), b=pixels.compositing_placement(F.lit("multiply"), F.lit(0.4), F.lit(False), F.lit(True)))
    assert r["a"] == {"normalize_alpha": False, "node_opacity": 1.0} and r["b"]["image_blend"] == "multiply" and r["b"]["group_blend"] is None
