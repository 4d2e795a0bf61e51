"""Intervals over ordered logs: bracket matching, containment, overlap, positional matching.

Interval joins are equi-joins on dyadic cells: a range has the level of the power of two that its length
needs, and touches two cells of that size at most; a point is listed once for each level that the
ranges have. Rows thus grow with the number of ranges and points and not with their lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ordered import depth
from lamina.session import cut


def match_brackets(log: DataFrame, keys: Sequence[str], order: str, opens: Column, closes: Column, payload: Sequence[str] = ()) -> DataFrame:  # J1
    """keys, start (position after the opening), end (position of the closing), level and the opening's payload, for each matched pair."""
    keys = list(keys)
    rows = depth(log, keys, [order], opens, closes)
    rows = rows.withColumn("_o", opens).withColumn("_c", closes & (F.col("level_before") > 0)).filter("_o or _c")
    rows = rows.withColumn("level", F.when(F.col("_o"), F.col("level_after")).otherwise(F.col("level_before")))
    w = Window.partitionBy(*keys, "level").orderBy(order)
    back = [F.lag(c).over(w).alias(f"_{c}") for c in dict.fromkeys([order, *payload])]
    rows = rows.select("*", *back).filter("_c")
    return rows.select(*keys, (F.col(f"_{order}") + 1).alias("start"), F.col(order).alias("end"), "level", *[F.col(f"_{p}").alias(p) for p in payload])


def drop_placeholders(ranges: DataFrame, keys: Sequence[str], name: str = "name", visible: str = "visible") -> DataFrame:  # J2
    """Without the visible empty ranges that share a name (trimmed, any case) with a hidden one."""
    key = F.lower(F.trim(F.col(name)))
    hidden = ranges.filter(~F.col(visible)).select(*keys, key.alias("_name")).distinct()
    rows = ranges.withColumn("_name", key).withColumn("_empty", F.col(visible) & (F.col("start") == F.col("end")))
    marked = rows.join(hidden.withColumn("_hit", F.lit(True)), [*keys, "_name"], "left")
    return marked.filter(~(F.col("_empty") & F.coalesce("_hit", F.lit(False)))).drop("_name", "_empty", "_hit")


def _level(start: Column, end: Column) -> Column:
    return F.ceil(F.log2(F.greatest(F.lit(1), end - start + 1))).cast("int")


def _cells(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """A row for each cell of level `_level` that a range touches, two at most."""
    size = F.pow(F.lit(2.0), F.col("_level"))
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(start / size), F.floor(end / size))))


def _levels(ranges: DataFrame) -> DataFrame:
    """One row with the levels that ranges have, 64 at most, so it can be broadcast."""
    return F.broadcast(ranges.agg(F.collect_set("_level").alias("_levels")))


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    return cond


def containing(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, how: str = "inner") -> DataFrame:  # J4
    """Points joined with every range (start, end; both ends count) that holds them; or the points that have one (left_semi) or none (left_anti)."""
    keys = list(keys)
    own = ranges.withColumn("_level", _level(F.col("start"), F.col("end")))
    near = _cells(own, F.col("start"), F.col("end"))
    if how != "inner":
        spots = points.select(*keys, at).distinct()
        return points.join(containing(spots, ranges, keys, at).select(*keys, at).distinct(), [*keys, at], how)
    rows = points.crossJoin(_levels(own)).withColumn("_level", F.explode("_levels")).withColumn("_cell", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_level"))))
    cond = _same("p", "r", [*keys, "_level", "_cell"]) & (F.col("r.start") <= F.col(f"p.{at}")) & (F.col("r.end") >= F.col(f"p.{at}"))
    return rows.alias("p").join(near.alias("r"), cond).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"r.{c}") for c in ranges.columns if c not in keys])


def innermost(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str) -> DataFrame:  # J3, O5
    """The range with the greatest start that holds each point, of several the shortest; points without one stay, with null."""
    more = [c for c in ranges.columns if c not in keys]
    held = containing(points.select(*keys, at).distinct(), ranges, keys, at)
    best = held.groupBy(*keys, at).agg(F.max_by(F.struct(*more), F.struct(F.col("start"), -F.col("end"))).alias("_best"))
    return points.join(best, [*keys, at], "left").select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in more])


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:  # J4, J5
    """The ranges of `a` that touch (left_semi) or don't touch (left_anti) a range of `b`.

    Two ranges meet in a cell of the longer one's level, so each is listed at its own level and at those above.
    """
    keys, id_ = list(keys), ["start", "end"]
    own = lambda df: df.select(*keys, *id_).distinct().withColumn("_own", _level(F.col("start"), F.col("end")))
    left, right = own(a), own(b)
    levels = _levels(left.select(F.col("_own").alias("_level")).unionByName(right.select(F.col("_own").alias("_level"))))
    listed = lambda df: _cells(df.crossJoin(levels).withColumn("_level", F.explode("_levels")).filter("_level >= _own"), F.col("start"), F.col("end"))
    cond = _same("l", "r", [*keys, "_level", "_cell"]) & (F.col("l._level") == F.greatest("l._own", "r._own")) & (F.col("l.start") <= F.col("r.end")) & (F.col("l.end") >= F.col("r.start"))
    hit = listed(left).alias("l").join(listed(right).alias("r"), cond, "left_semi").select(*keys, *id_).distinct()
    return a.join(hit, [*keys, *id_], how)


def distinct_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:  # U3
    return ranges.dropDuplicates([*keys, "start", "end"])


def layer_ranges(ops: DataFrame, groups: DataFrame) -> DataFrame:  # J1 + J2
    """Layers of an operator log. ops: doc_id, idx, op, tag, group_id; groups: doc_id, group_id, name, visible."""
    opens, closes = F.col("op").isin("beginMarkedContentProps", "beginMarkedContent"), F.col("op") == "endMarkedContent"
    marked = ops.withColumn("layer_id", F.when((F.col("op") == "beginMarkedContentProps") & (F.col("tag") == "OC"), F.col("group_id")))
    found = match_brackets(marked, ["doc_id"], "idx", opens, closes, ["layer_id"]).filter("layer_id is not null")
    named = found.join(groups.withColumnRenamed("group_id", "layer_id"), ["doc_id", "layer_id"], "left")
    named = named.select("doc_id", "layer_id", F.coalesce("name", "layer_id").alias("name"), "start", "end", F.coalesce("visible", F.lit(True)).alias("visible"))
    return drop_placeholders(named, ["doc_id"])


def soft_mask_groups(ops: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:  # J5
    """Outermost groups with a soft mask that hold an image. ops: keys, idx, op, soft_mask, is_image."""
    keys = list(keys)
    pairs = match_brackets(ops, keys, "idx", F.col("op") == "beginGroup", F.col("op") == "endGroup", ["soft_mask"]).filter("soft_mask")
    # pairs, masks and save ranges are read by many joins: written once, the log is matched once for each
    pairs = cut(pairs.select(*keys, (F.col("start") - 1).alias("start"), "end").distinct())
    images = ops.filter("is_image").select(*keys, F.col("idx").alias("at"))
    full = containing(images, pairs, keys, "at").select(*keys, "start", "end").distinct()
    # outermost: no other mask group starts before and ends after
    starts = full.select(*keys, F.col("start").alias("at"), F.col("end").alias("own_end"))
    inside = containing(starts, pairs, keys, "at").filter("start < at and end > own_end").select(*keys, F.col("at").alias("start"), F.col("own_end").alias("end")).distinct()
    return full.join(inside, [*keys, "start", "end"], "left_anti")


def image_segments(ops: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:  # J3
    """Ranges to draw images by: soft-mask groups, and for each other image its innermost save range free of them, else itself."""
    keys = list(keys)
    masks = cut(soft_mask_groups(ops, keys))
    saves = match_brackets(ops, keys, "idx", F.col("op") == "save", F.col("op") == "restore").select(*keys, (F.col("start") - 1).alias("start"), "end").distinct()
    free = cut(overlapping(cut(saves), masks, keys, how="left_anti"))
    images = ops.filter("is_image").select(*keys, F.col("idx").alias("at"))
    loose = containing(images, masks, keys, "at", how="left_anti")
    own = innermost(loose, free, keys, "at").select(*keys, F.coalesce("start", "at").alias("start"), F.coalesce("end", "at").alias("end"))
    return distinct_ranges(masks.select(*keys, "start", "end").unionByName(own), keys)


def positional(items: DataFrame, styles: DataFrame, keys: Sequence[str], order: str) -> DataFrame:  # J16
    """The k-th item with the k-th style, the last style for those beyond; styles: keys, k (from 0) and more."""
    keys = list(keys)
    n = styles.groupBy(*keys).agg((F.max("k") + 1).alias("_n"))
    rows = items.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    rows = rows.join(n, keys, "left").withColumn("k", F.least(F.col("_k"), F.col("_n") - 1)).drop("_k", "_n")
    return rows.join(styles, [*keys, "k"], "left")


def text_by_layer(items: DataFrame, layers: DataFrame) -> DataFrame:  # J15
    """Text items with the layer whose marker is open. items: doc_id, idx, kind ('open', 'close', 'text'), text; layers: doc_id, k, layer_id.

    The k-th marker opens the k-th layer; a close, also of a nested mark, ends it.
    """
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("_n", F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(w))
    state = F.when(F.col("kind") == "open", F.col("_n")).when(F.col("kind") == "close", F.lit(-1))
    rows = rows.withColumn("k", F.last(state, ignorenulls=True).over(w) - 1).filter("kind = 'text' and k >= 0 and text <> ''")
    return rows.join(layers, ["doc_id", "k"]).drop("_n", "k")
