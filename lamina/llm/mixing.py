"""Mixing sources to target weights along a time-varying curriculum, in DataFrame expressions only.

1. Targets: source weights share the budget; no target passes `most` times its source's size, and
   what is cut off is shared again by weight until none passes (water-filling, solved in one pass
   over the sources ordered by size per weight).
2. Demand: each source's documents stand in a fixed hash order; a document takes part once for each
   round in which its middle word lies before the target. Whole documents only, so a source's taken
   words differ from its target by at most half of one document.
3. Positions: a source's weight over training time is piecewise linear; its integral is inverted at
   the share of the demand that stands before the document, and documents are range-sorted by it.

Edge cases: a null source is a source of its own, last in order; null, empty and blank texts have
size 0 and are taken 0 times; a very long text counts whole; rows that are equal in doc_id, source and
size follow each other in the demand, each with its own place; ties in the hash order are broken by
doc_id and size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm._common import WORD, stable_hash, written

#: Weight by training time, as (time, weight) knots; sources take them in turn.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Rows that one prefix-sum task gets on average.
BLOCK_ROWS = 20_000


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """The integral of a piecewise linear weight, as segments that start at share c0 of the whole."""
    pieces = [(t0, t1 - t0, w0, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(p[4] for p in pieces), 0.0, []
    for t0, h, w0, w1, area in pieces:
        out.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in (("t0", t0), ("h", h), ("w0", w0 / total), ("w1", w1 / total), ("c0", done / total))]))
        done += area
    return F.array(*out)


def invert(share: Column, segments: Column) -> Column:
    """The time at which the integral of the weight reaches `share` (0 to 1)."""
    s = F.element_at(F.filter(segments, lambda x: (x["c0"] <= share) | (x["c0"] <= 0)), -1)
    d = F.greatest(share - s["c0"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + F.lit(2.0) * (s["w1"] - s["w0"]) / s["h"] * d, F.lit(0.0)))
    return s["t0"] + F.when(d == 0, 0.0).otherwise(F.lit(2.0) * d / (s["w0"] + root))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, idx, target from a row for each source and its size."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = sources.withColumn("idx", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("idx") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    upto = Window.orderBy("ratio", "idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("budget", share * F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    # the level if exactly the sources before this one, in order of cap per weight, are capped
    rows = rows.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    rows = rows.withColumn("reached", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return rows.select("source", "source_size", "idx", F.least(F.col("cap"), F.coalesce(F.col("reached") * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, schedules=SCHEDULES) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken, positions (one for each copy)."""
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = written(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_times")), "mix-sizes")
    blocks = max(32, -(-rows.count() // BLOCK_ROWS))
    rows = rows.withColumn("_h", stable_hash("mix", "doc_id", "size")).withColumn("_block", F.pmod("_h", F.lit(blocks))).withColumn("_words", F.col("size") * F.col("_times"))
    sums = rows.groupBy("source", "_block").agg(F.sum("_words").alias("_n"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    goal = targets(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, most)
    starts = starts.alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select(F.col("a.source").alias("_s"), F.col("a._block").alias("_b"), "_start", "source_size", "idx", "target")
    inside = Window.partitionBy("source", "_block").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    rows = rows.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    middle = F.col("_start") + F.col("_in") + F.col("_nth") * F.col("size") + F.col("size") / 2
    copies = F.when(F.col("source_size") > 0, F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size")))).otherwise(0)
    rows = rows.withColumn("_mid", middle).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int"))
    segments = F.element_at(F.array(*map(_segments, schedules)), (F.col("idx") % len(schedules) + 1).cast("int"))
    round_share = lambda k: F.least(F.lit(1.0), (F.col("_mid") + k * F.col("source_size")) / F.col("target"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: invert(round_share(k), segments))).otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"))


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by position: what a trainer reads."""
    rows = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return rows.orderBy("position", "doc_id", "copy")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, range-sorted by training position.

    Rows without words have no demand; they stay once, at the end. Places in the mix are joined back by
    (doc_id, source, size): rows that are equal in these share all their places, so of several such rows
    that differ in their texts each stands where any of them does, as often as one of them.
    """
    places = mix(docs, **options).groupBy(F.col("doc_id").alias("_lamina_d"), F.col("source").alias("_lamina_s"), F.col("size").alias("_lamina_n")).agg(F.max("positions").alias("_lamina_at"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.withColumn("_lamina_size", size)
    same = F.col("doc_id").eqNullSafe(F.col("_lamina_d")) & F.col("source").eqNullSafe(F.col("_lamina_s")) & (F.col("_lamina_size") == F.col("_lamina_n"))
    at = F.when(F.col("_lamina_n") == 0, F.array(F.lit(None).cast("double"))).otherwise(F.col("_lamina_at"))
    rows = rows.join(places, same).select(*docs.columns, F.posexplode(at).alias("_lamina_copy", "_lamina_position"))
    return rows.orderBy(F.col("_lamina_position").asc_nulls_last(), "doc_id", "_lamina_copy").select(*docs.columns)
