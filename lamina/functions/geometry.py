"""Colour, matrix and unit arithmetic as native column expressions. Matrices are array<double> (a, b, c, d, e, f)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.strings import js_number, parse_float

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
# fixed values: colour names that markup may use
NAMED_COLORS = {"black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "008000", "blue": "0000FF", "gray": "808080", "grey": "808080"}
EMU = 9525


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def color(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.cast("double").alias("r"), g.cast("double").alias("g"), b.cast("double").alias("b"), a.cast("double").alias("a"))


def hex_color(value: Column, alpha: Column | None = None) -> Column:  # M1
    """#rgb doubles its digits; anything else is padded with zeros to six."""
    plain = F.regexp_replace(value, "^#", "")
    six = F.when(F.length(plain) == 3, F.regexp_replace(plain, "(.)", "$1$1")).otherwise(F.rpad(plain, 6, "0"))
    part = lambda i: F.coalesce(F.conv(F.substring(six, i, 2), 16, 10).cast("double"), F.lit(0.0)) / 255
    return color(part(1), part(3), part(5), F.lit(1.0) if alpha is None else alpha)


def parse_color(value: Column) -> Column:  # M7
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMED_COLORS.items() for x in kv]), F.lower(value))
    channels = F.split(F.regexp_extract(value, r"(?i)rgba?\(([^)]+)\)", 1), ",")
    at = lambda i, d: parse_float(F.trim(F.get(channels, F.lit(i))), d)
    rgb = color(at(0, 0.0) / 255, at(1, 0.0) / 255, at(2, 0.0) / 255, at(3, 1.0))
    return (
        F.when(value.isNull() | value.isin("", "none", "transparent"), None)
        .when(value.startswith("#"), hex_color(value))
        .when(value.rlike(r"(?i)rgba?\(([^)]+)\)"), rgb)
        .when(named.isNotNull(), hex_color(named))
    )


def css_hex(values: Column) -> Column:  # F22
    """#rrggbb of three numbers; all within 0 to 1 means shares of 255."""
    three = F.slice(values, 1, 3)
    scale = F.when(F.forall(three, lambda v: (v >= 0) & (v <= 1)), 255.0).otherwise(1.0)
    byte = lambda v: F.lower(F.lpad(F.conv(clamp(F.floor(v * scale + 0.5), 0, 255).cast("int").cast("string"), 10, 16), 2, "0"))
    return F.concat(F.lit("#"), F.array_join(F.transform(three, byte), ""))


def solid_paint(c: Column, opacity: Column) -> Column:  # M21, M22
    """The sink's solid paint: channels clamped; opacity, else the colour's own, else 1."""
    return F.struct(F.lit("SOLID").alias("type"), clamp(c["r"]).alias("r"), clamp(c["g"]).alias("g"), clamp(c["b"]).alias("b"), F.coalesce(opacity, c["a"], F.lit(1.0)).alias("opacity"))


def unit_opacity(v: Column) -> Column:  # M12
    return F.when(v.isNull(), 1.0).when(v > 1, v / 255).otherwise(v)


def unit_channel(v: Column) -> Column:  # M12
    return F.when(v.isNull(), 0.0).when(v > 1, v / 255).otherwise(v)


def emu(c: Column) -> Column:  # P1
    return js_number(c) / EMU


def transform_box(x: Column, y: Column, cx: Column, cy: Column, rot: Column) -> Column:  # P3
    return F.struct(emu(x).alias("x"), emu(y).alias("y"), F.greatest(F.lit(1.0), emu(cx)).alias("width"), F.greatest(F.lit(1.0), emu(cy)).alias("height"), (js_number(rot) / 60000).alias("rotation"))


def child_scale(size: Column, child_size: Column) -> Column:  # P4
    """Scale from a group's own child extent to its frame; no extent means the frame's size."""
    return size / F.coalesce(F.nullif(child_size, F.lit(0.0)), size)


def scaled_child(x: Column, origin: Column, scale: Column) -> Column:  # P5
    return (x - origin) * scale


def matrix(*v: Column | float) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in v])


def multiply(m: Column, n: Column) -> Column:  # M2
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    g, h, i, j, k, l = (F.get(n, F.lit(i)) for i in range(6))  # noqa: E741
    return matrix(a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f)


def inverse(m: Column) -> Column:  # M3
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    det = a * d - b * c
    inv = matrix(d / det, -b / det, -c / det, a / det, (c * f - e * d) / det, (e * b - a * f) / det)
    return F.when(det == 0, matrix(*IDENTITY)).otherwise(inv)


def apply_matrix(m: Column, x: Column, y: Column) -> Column:  # M4
    a, b, c, d, e, f = (F.get(m, F.lit(i)) for i in range(6))
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def chain(matrices: Column) -> Column:
    """Product of an array of matrices, left to right."""
    return F.aggregate(matrices, matrix(*IDENTITY), multiply)


def parse_transform(value: Column) -> Column:  # M5
    """The matrix of a transform list: matrix, translate, scale, rotate (about a point), skewX, skewY."""
    pattern = r"(?i)([a-z]+)\s*\(([^)]*)\)"
    text = F.coalesce(value, F.lit(""))
    names, bodies = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    numbers = lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"(?i)([-+]?(?:\d*\.?\d+)(?:e[-+]?\d+)?)"), 1), lambda x: x.cast("double"))
    ops = F.zip_with(names, bodies, lambda n, b: F.struct(F.lower(n).alias("n"), numbers(b).alias("v")))

    def one(op: Column) -> Column:
        v = lambda i, d=0.0: F.coalesce(F.get(op["v"], F.lit(i)), d if isinstance(d, Column) else F.lit(float(d)))
        angle = F.radians(v(0))
        cos, sin, x, y = F.cos(angle), F.sin(angle), v(1), v(2)
        about = matrix(cos, sin, -sin, cos, x - cos * x + sin * y, y - sin * x - cos * y)
        return (
            F.when((op["n"] == "matrix") & (F.size(op["v"]) >= 6), F.slice(op["v"], 1, 6))
            .when(op["n"] == "translate", matrix(1, 0, 0, 1, v(0), v(1)))
            .when(op["n"] == "scale", matrix(v(0, 1.0), 0, 0, v(1, v(0, 1.0)), 0, 0))
            .when(op["n"] == "rotate", about)
            .when(op["n"] == "skewx", matrix(1, 0, F.tan(angle), 1, 0, 0))
            .when(op["n"] == "skewy", matrix(1, F.tan(angle), 0, 1, 0, 0))
            .otherwise(matrix(*IDENTITY))
        )

    return chain(F.transform(ops, one))


def only_translation(value: Column) -> Column:  # M6
    number = r"([-\d.]+)"
    t = rf"translate\(\s*{number}(?:[,\s]+{number})?"
    m = rf"matrix\(\s*[-\d.]+[,\s]+[-\d.]+[,\s]+[-\d.]+[,\s]+[-\d.]+[,\s]+{number}[,\s]+{number}"
    pick = lambda i: F.when(value.rlike(t), parse_float(F.regexp_extract(value, t, i))).when(value.rlike(m), parse_float(F.regexp_extract(value, m, i))).otherwise(0.0)
    return F.struct(pick(1).alias("x"), pick(2).alias("y"))


def corner_bounds(m: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:  # G12
    """Box of a rectangle's four corners under a matrix."""
    p = [apply_matrix(m, x, y) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))]
    return F.struct(F.least(*[q["x"] for q in p]).alias("left"), F.least(*[q["y"] for q in p]).alias("top"), F.greatest(*[q["x"] for q in p]).alias("right"), F.greatest(*[q["y"] for q in p]).alias("bottom"))


def rotation(m: Column) -> Column:  # M15
    return -F.degrees(F.atan2(F.get(m, F.lit(1)), F.get(m, F.lit(0))))


def scales(m: Column) -> Column:  # M15
    x = F.hypot(F.get(m, F.lit(0)), F.get(m, F.lit(1)))
    x = F.when(x == 0, 1.0).otherwise(x)
    y = F.hypot(F.get(m, F.lit(2)), F.get(m, F.lit(3)))
    return F.struct(x.alias("x"), F.when(y == 0, x).otherwise(y).alias("y"))


def gradient_transform(kind: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:  # M16
    """The sink's 2x3 gradient matrix, as (a, b, c, d, e, f), from a linear or radial axis; near-singular axes give the identity."""
    dx, dy = x1 - x0, y1 - y0
    radial = kind == "radial"
    a = F.when(radial, 2 * dx).otherwise(dx)
    b = F.when(radial, 2 * dy).otherwise(dy)
    e = F.when(radial, x0 - dx + dy).otherwise(x0 + dy / 2)
    f = F.when(radial, y0 - dy - dx).otherwise(y0 - dx / 2)
    m = matrix(a, b, -b, a, e, f)
    return F.when(F.abs(a * a + b * b) < 1e-8, matrix(*IDENTITY)).otherwise(inverse(m))


def text_width(text: Column, size: Column, spacing: Column) -> Column:  # M14
    """Estimated width: a full em beyond Latin-1, else 0.56 em; spacing counts UTF-16 gaps."""
    from lamina.functions.strings import utf16_length

    wide = F.length(F.regexp_replace(text, "[\\x{0}-\\x{FF}]", ""))
    glyphs = wide * size + (F.length(text) - wide) * size * 0.56
    return F.greatest(size, glyphs + F.greatest(F.lit(0), utf16_length(text) - 1) * spacing)


def font_style(weight: Column, style: Column) -> Column:  # P32
    bold = (weight == "bold") | (F.coalesce(F.regexp_extract(weight, r"^\s*([-+]?\d+)", 1).try_cast("int"), F.lit(0)) >= 600)
    italic = style != "normal"
    return F.when(bold & italic, "Bold Italic").when(bold, "Bold").when(italic, "Italic").otherwise("Regular")


def preset_shape(preset: Column) -> Column:  # P7
    return (
        F.when(preset == "ellipse", "ellipse")
        .when((preset == "line") | preset.endswith("Arrow"), "line")
        .when(preset.contains("triangle") | preset.contains("pentagon") | preset.contains("hexagon"), "polygon")
        .otherwise("rectangle")
    )


def cubic_from_quadratic(x0: Column, y0: Column, cx: Column, cy: Column, x: Column, y: Column) -> Column:  # M23
    t = F.lit(2.0) / 3
    return F.array(x0 + t * (cx - x0), y0 + t * (cy - y0), x + t * (cx - x), y + t * (cy - y), x, y)


def min_max(v: Column) -> Column:  # M24
    return F.when(F.size(v) >= 4, F.array(*[F.get(v, F.lit(i)) for i in (0, 2, 1, 3)]))


def tiles(width: Column, height: Column, most: int = 4096) -> Column:  # P14
    """Tiles of at most `most` pixels a side, row by row, clipped at the edges."""
    axis = lambda n: F.when(n > 0, F.sequence(F.lit(0), (F.ceil(n / most) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    tile = lambda r, c: F.struct((c * most).alias("x"), (r * most).alias("y"), F.least(F.lit(most), width - c * most).alias("width"), F.least(F.lit(most), height - r * most).alias("height"))
    return F.flatten(F.transform(axis(height), lambda r: F.transform(axis(width), lambda c: tile(r, c))))


def grid_cell(row: Column, col: Column, rows: Column, cols: Column, width: Column, height: Column) -> Column:  # P29, G11
    """x, y, width, height of a cell of an equal grid over a frame; a grid has one column at least."""
    w, h = width / F.greatest(F.lit(1), cols), height / rows
    return F.struct((col * w).alias("x"), (row * h).alias("y"), w.alias("width"), h.alias("height"))
