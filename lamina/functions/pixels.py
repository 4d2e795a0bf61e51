"""Pixel arithmetic on RGBA arrays (array<int>, four values a pixel) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.strings import js_round


def restore_opacity(px: Column, opacity: Column) -> Column:  # X1
    """Alpha divided by a uniform opacity strictly between 0 and 1; anything else changes nothing."""
    fix = F.transform(px, lambda v, i: F.when(i % 4 == 3, F.least(F.lit(255), js_round(v / opacity))).otherwise(v).cast("int"))
    return F.when((opacity > 0) & (opacity < 1), fix).otherwise(px)


def _pixels(*arrays: Column) -> Column:
    """Array of pixels; each is a struct of the arrays' four values in turn."""
    n = (F.size(arrays[0]) / 4).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(*[F.slice(a, i * 4 + 1, F.lit(4)).alias(f"p{k}") for k, a in enumerate(arrays)]))


def _overlay(before: Column, after: Column, alpha: Column) -> Column:
    """The pixel that turns `before` into `after` at an alpha."""
    ch = lambda i: js_round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.get(after, F.lit(i)) / 255 - F.get(before, F.lit(i)) / 255 * (1 - alpha)) / alpha)) * 255).cast("int")
    return F.when(alpha <= 1 / 255, F.array(*[F.lit(0)] * 4)).otherwise(F.array(ch(0), ch(1), ch(2), js_round(alpha * 255).cast("int")))


def normal_overlay(backdrop: Column, composited: Column, source: Column, opacity: Column) -> Column:  # X2
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), opacity))
    return F.flatten(F.transform(_pixels(backdrop, composited, source), lambda p: _overlay(p["p0"], p["p1"], F.get(p["p2"], F.lit(3)) / 255 * share)))


def least_alpha_overlay(backdrop: Column, composited: Column) -> Column:  # X3
    """The most transparent overlay that explains the change, alpha rounded up to a byte."""

    def need(p: Column, i: int) -> Column:
        before, after = F.get(p["p0"], F.lit(i)) / 255, F.get(p["p1"], F.lit(i)) / 255
        up = F.when(before >= 1, 1.0).otherwise((after - before) / (1 - before))
        down = F.when(before <= 0, 1.0).otherwise((before - after) / before)
        return F.when(after > before, up).when(after < before, down).otherwise(0.0)

    def one(p: Column) -> Column:
        alpha = F.greatest(F.lit(0.0), *[need(p, i) for i in range(3)])
        whole = F.least(F.lit(1.0), F.ceil(alpha * 255) / 255)
        return F.when(alpha <= 1 / 255, F.array(*[F.lit(0)] * 4)).otherwise(_overlay(p["p0"], p["p1"], whole))

    return F.flatten(F.transform(_pixels(backdrop, composited), one))


def any_visible(px: Column) -> Column:  # P18
    return F.exists(F.filter(px, lambda v, i: i % 4 == 3), lambda v: v > 0)


def to_bytes(values: Column, kind: str) -> Column:  # X6
    """Samples of 8, 16 or 32 (float) bits as bytes."""
    scale = {"uint8": lambda v: v, "uint16": lambda v: v / 257, "float32": lambda v: v * 255}[kind]
    return F.transform(values, lambda v: F.greatest(F.lit(0), F.least(F.lit(255), js_round(scale(v)))).cast("int"))


def numeric_array(values: Column) -> Column:  # X5
    return F.transform(values, lambda v: v.try_cast("double"))


def opacity_strategy(opacity: Column, soft_mask: Column, baked: Column) -> Column:  # X4
    normalize = ~soft_mask & baked & (opacity > 0) & (opacity < 1)
    return F.struct(normalize.alias("normalize_alpha"), F.when(soft_mask & baked, 1.0).otherwise(opacity).alias("node_opacity"))


def compositing_placement(blend: Column, opacity: Column, soft_mask: Column, baked: Column) -> Column:  # X4
    node = opacity_strategy(opacity, soft_mask, baked)["node_opacity"]
    return F.struct(F.when(soft_mask, "normal").otherwise(blend).alias("image_blend"), node.alias("image_opacity"), F.when(soft_mask, blend).alias("group_blend"), F.when(soft_mask, 1.0).alias("group_opacity"))
