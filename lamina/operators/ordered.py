"""Operators on ordered rows. `keys` partition (a page, a user, a text block), `order` decides within.

One partition is one page or one block; rows of a partition meet in one task, spilling if they must.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamina.functions.filters import clamped_sum
from lamina.functions.strings import utf16_length


def _w(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def _before(keys, order):
    return _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def layout_cursor(df: DataFrame, keys, order, width: Column, gap: float = 120.0, out: str = "x") -> DataFrame:  # W1, G18
    """Where each page starts: the widths and gaps of those before it."""
    return df.withColumn(out, F.coalesce(F.sum(width + gap).over(_before(keys, order)), F.lit(0.0)))


def carry(df: DataFrame, keys, order, value: Column, out: str, inclusive: bool = True) -> DataFrame:  # W10, W9, W2 without brackets
    """The last value that is not null, up to this row or before it."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def depth(df: DataFrame, keys, order, opens: Column, closes: Column) -> DataFrame:  # J1, W13
    """Adds `level_before` and `level_after`: open brackets around each row; a close without an open is ignored."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    upto = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_sum", F.sum(step).over(upto))
    df = df.withColumn("level_after", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto)))
    return df.withColumn("level_before", F.coalesce(F.lag("level_after").over(_w(keys, order)), F.lit(0))).drop("_sum")


def state_with_brackets(df: DataFrame, keys, order, saves: Column, restores: Column, value: Column, initial: Column, out: str) -> DataFrame:  # W2, W13, W9
    """The state after each row where a save remembers it, a matched restore brings it back, and `value` sets it.

    A stack can't be an aggregate of windows, so each group (a page) is folded in one task.
    """
    flags = df.withColumns({"_s": saves, "_r": restores, "_v": value, "_i": initial})
    schema = df.withColumn(out, F.coalesce(value, initial)).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        state, stack, states = pdf["_i"].iloc[0], [], []
        for s, r, v in zip(pdf["_s"], pdf["_r"], pdf["_v"], strict=True):
            if s:
                stack.append(state)
            elif r:
                state = stack.pop() if stack else state
            elif not pd.isna(v):
                state = v
            states.append(state)
        pdf[out] = states
        return pdf.drop(columns=["_s", "_r", "_v", "_i"])

    return flags.groupBy(*keys).applyInPandas(fold, schema)


def islands(df: DataFrame, keys, order, joins: Column, out: str = "island") -> DataFrame:  # W5
    """Numbers runs of rows; a row starts a new run unless `joins` (which may use lag) holds."""
    w = _w(keys, order)
    return df.withColumn(out, F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def previous(column: str, keys, order) -> Column:
    return F.lag(column).over(_w(keys, order))


def neighbour_distance(df: DataFrame, keys, order, value: str, out: str = "line_height") -> DataFrame:  # W7
    """Distance to the next row's value, else to the previous one's."""
    w = _w(keys, order)
    return df.withColumn(out, F.abs(F.col(value) - F.coalesce(F.lead(value).over(w), F.lag(value).over(w))))


def greedy_bins(values: Column, tolerance: float = 2.0) -> Column:  # W6
    """For an ordered array: the bin of each value, being the first bin whose founder is within the tolerance."""
    start = F.struct(F.array().cast("array<double>").alias("founders"), F.array().cast("array<int>").alias("bins"))

    def step(acc: Column, v: Column) -> Column:
        at = F.array_position(F.transform(acc["founders"], lambda f: F.abs(f - v) <= tolerance), F.lit(True)).cast("int")
        new = at == 0
        return F.struct(F.when(new, F.concat(acc["founders"], F.array(v))).otherwise(acc["founders"]).alias("founders"), F.concat(acc["bins"], F.array(F.when(new, F.size(acc["founders"])).otherwise(at - 1))).alias("bins"))

    return F.aggregate(values, start, step, lambda acc: acc["bins"])


def text_runs(df: DataFrame, keys, order, text: str, new_line: Column) -> DataFrame:  # W8, W4
    """Adds `run_start`, `run_end` in UTF-16 units of the joined text; a line end belongs to the run before it."""
    w = _w(keys, order)
    df = df.withColumn("_nl", F.when(F.coalesce(new_line, F.lit(False)), 1).otherwise(0)).withColumn("_len", utf16_length(F.col(text)))
    total = F.sum(F.col("_len") + F.col("_nl")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("run_start", total - F.col("_len")).withColumn("run_end", total + F.coalesce(F.lead("_nl").over(w), F.lit(0)))
    return df.drop("_nl", "_len")


def joined_text(df: DataFrame, keys, order: str, text: str, new_line: Column) -> DataFrame:  # W4, W8
    """One row for each group: its texts joined, a line end before each row that starts a line."""
    piece = F.concat(F.when(F.coalesce(new_line, F.lit(False)), "\n").otherwise(""), F.col(text))
    rows = df.withColumn("_piece", piece)
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("_piece"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_piece"]), "").alias("characters"))


def merges_with_previous(keys, order) -> Column:  # W5: columns x, y, width, height, has_eol
    """Whether a text item goes on the paragraph of the item before it."""
    p = {c: previous(c, keys, order) for c in ("x", "y", "width", "height", "has_eol")}
    c = {k: F.col(k) for k in ("x", "y", "width", "height")}
    tall = F.greatest(p["height"], c["height"])
    near = tall * 0.35 + 2
    edges = [(p["x"], c["x"]), ((p["x"] * 2 + p["width"]) / 2, (c["x"] * 2 + c["width"]) / 2), (p["x"] + p["width"], c["x"] + c["width"])]
    aligned = (F.abs(edges[0][0] - edges[0][1]) <= near) | (F.abs(edges[1][0] - edges[1][1]) <= near) | (F.abs(edges[2][0] - edges[2][1]) <= near)
    gap = F.abs(p["y"] - c["y"])
    return (p["has_eol"] & aligned & (gap <= tall * 2.25)) | ((gap <= 2) & (c["x"] <= p["x"] + p["width"] + tall))


def alignment(lines: DataFrame, keys, left: str = "left", right: str = "right", height: str = "height") -> DataFrame:  # G10, O6
    """left, center or right: the edge whose positions spread least over the lines, if within tolerance; a tie goes in this order."""
    mid = (F.col(left) + F.col(right)) / 2
    spread = lambda c: F.max(c) - F.min(c)
    ranked = F.array_min(F.array(*[F.struct(spread(c).alias("spread"), F.lit(i).alias("rank"), F.lit(n).alias("name")) for i, (c, n) in enumerate(((F.col(left), "left"), (mid, "center"), (F.col(right), "right")))]))
    got = lines.groupBy(*keys).agg(F.count("*").alias("lines"), ranked.alias("best"), F.max(height).alias("_h"))
    fits = (F.col("lines") >= 2) & (F.col("best.spread") <= F.greatest(F.lit(6.0), F.col("_h") * 0.35))
    return got.select(*keys, "lines", F.when(fits, F.col("best.name")).otherwise("left").alias("alignment"))


def clamped_fold(df: DataFrame, keys, order: str, value: Column, low: float = -1.0, high: float = 1.0, out: str = "total") -> DataFrame:  # G5
    """The clamped running sum at the end of each group. A group's (order, value) pairs meet in one row."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(clamped_sum(F.transform(pairs, lambda p: p["v"]), low, high).alias(out))


def flowing_filters(layers: DataFrame, keys, order: str) -> DataFrame:  # W11; columns kind ('persistent', 'clipped', 'layer'), value
    """For each ordinary layer, the filters that flow to it: all persistent ones before it, then the sum of the clipped ones since the last layer."""
    w = _before(keys, [order])
    is_layer = F.col("kind") == "layer"
    rows = layers.withColumn("_block", F.coalesce(F.sum(F.when(is_layer, 1).otherwise(0)).over(w), F.lit(0)))
    persistent = F.collect_list(F.when(F.col("kind") == "persistent", F.struct(F.col(order), F.col("value")))).over(w)
    clipped = F.collect_list(F.when(F.col("kind") == "clipped", F.struct(F.col(order), F.col("value")))).over(_before([*keys, "_block"], [order]))
    fold = lambda pairs: clamped_sum(F.transform(F.array_sort(pairs), lambda p: p["value"]))
    return rows.withColumn("filter", clamped_sum(F.array(fold(persistent), fold(clipped)))).filter(is_layer).drop("_block")


def latest(df: DataFrame, keys, version: str) -> DataFrame:  # 2.10
    """Rows at the highest version of their key; older answers are stale."""
    top = df.groupBy(*keys).agg(F.max(version).alias(version))
    return df.join(top, [*keys, version], "left_semi")


def merge_later_wins(df: DataFrame, keys, priority: Sequence[Column]) -> DataFrame:  # U5
    w = Window.partitionBy(*keys).orderBy(*[p.desc() for p in priority])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def fold_documents(rows: DataFrame, needs: Sequence[str], fold, adds: str, order: Sequence[str]) -> DataFrame:
    """As `fold_ordered`, for rows in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fold_ordered(rows.repartition(n, "doc_id").sortWithinPartitions("doc_id", *order), needs, fold, adds)


def fold_ordered(rows: DataFrame, needs: Sequence[str], fold, adds: str) -> DataFrame:
    """Rows, which stand document by document, with the columns `adds` (DDL). fold gets a list of each column of `needs` over one document's rows, in order, and returns a list of each new one.

    A document is bounded by what one file can hold, so its rows meet in one task; columns that the fold
    doesn't need stay Arrow data.
    """
    new = StructType.fromDDL(adds)
    fields, columns = list(to_arrow_schema(new)), list(rows.columns)
    needs, doc = [columns.index(c) for c in needs], columns.index("doc_id")

    def folded(parts):
        table = pa.Table.from_batches(parts)
        docs, cols = table.column(doc).to_pylist(), [table.column(c).to_pylist() for c in needs]
        out, i = [[] for _ in fields], 0
        while i < len(docs):
            j = i + 1
            while j < len(docs) and docs[j] == docs[i]:
                j += 1
            for o, got in zip(out, fold(*[c[i:j] for c in cols]), strict=True):
                o.extend(got)
            i = j
        arrays = [*table.columns, *[pa.chunked_array([pa.array(o, f.type)]) for o, f in zip(out, fields, strict=True)]]
        yield from pa.Table.from_arrays(arrays, names=[*columns, *[f.name for f in fields]]).to_batches()

    def run(batches):
        held = []  # rows of one document, which may go on in the next batch
        for b in batches:
            docs = b.column(doc).to_pylist()
            if not docs:
                continue
            k = len(docs) - 1
            while k and docs[k - 1] == docs[-1]:
                k -= 1
            if k or (held and held[0].column(doc)[0].as_py() != docs[0]):
                if whole := [*held, *([b.slice(0, k)] if k else [])]:
                    yield from folded(whole)
                held = []
            held.append(b.slice(k))
        if held:
            yield from folded(held)

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *new.fields]))
