"""Trees as adjacency rows (doc_id, node_id, parent_id, ord, ...): closures, roll-ups, inheritance.

What goes up or down a tree does so by doubling: a tree of depth d takes log2(d) rounds, each written to
the checkpoint folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.geometry import IDENTITY, matrix, multiply
from lamina.session import cut


def _parents(nodes: DataFrame) -> DataFrame:
    return nodes.filter("parent_id is not null").select("doc_id", "node_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))


def _cycle(rounds: int, nodes: int) -> None:
    """No path has more steps than there are nodes, so more doublings than these need a cycle."""
    if 1 << (rounds - 1) > max(1, nodes):
        raise ValueError("the parents form a cycle")


def closure(nodes: DataFrame) -> DataFrame:  # J18, F26, P13
    """doc_id, node_id, ancestor_id, distance (0 is the node itself), by doubling: as many joins as the logarithm of the depth, whatever the depth. A cycle is an error.

    A row for each pair; `subtree_sums`, `inherited` and `world_matrices` need a row for each node only.
    """
    step = _parents(nodes)
    reach = nodes.select("doc_id", "node_id", F.col("node_id").alias("ancestor_id"), F.lit(0).alias("distance")).unionByName(step)
    hop, size, rounds, count = step, 1, 0, nodes.count()
    while True:
        # hop: exactly `size` steps up; reach: up to `size` steps up
        far = hop.alias("h").join(reach.alias("r"), (F.col("h.doc_id") == F.col("r.doc_id")) & (F.col("h.ancestor_id") == F.col("r.node_id")))
        far = cut(far.select("h.doc_id", "h.node_id", "r.ancestor_id", (F.col("h.distance") + F.col("r.distance")).alias("distance")).filter(F.col("distance") > size))
        if far.isEmpty():
            return reach
        rounds += 1
        _cycle(rounds, count)
        reach, size = cut(reach.unionByName(far)), size * 2
        hop = far.filter(F.col("distance") == size)


def doubling(nodes: DataFrame, state: DataFrame, step) -> DataFrame:
    """step(state, hops) with hops (doc_id, node_id, ancestor_id) 1, 2, 4, ... levels up, until no node has an ancestor so far up."""
    hops, rounds, count = cut(_parents(nodes).drop("distance")), 0, nodes.count()
    while not hops.isEmpty():
        rounds += 1
        _cycle(rounds, count)
        state = cut(step(state, hops))
        up = hops.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("_next"))
        hops = cut(hops.join(up, ["doc_id", "ancestor_id"]).select("doc_id", "node_id", F.col("_next").alias("ancestor_id")))
    return state


def count_nodes(nodes: DataFrame) -> DataFrame:  # G1
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"))


def subtree_sums(nodes: DataFrame, value: Column) -> DataFrame:
    """doc_id, node_id, total: the sum of a value over a node and all below it, in a row for each node.

    After k rounds a node has the sum of what lies less than 2**k levels below it.
    """

    def step(state, hops):
        more = hops.join(state, ["doc_id", "node_id"]).groupBy("doc_id", F.col("ancestor_id").alias("node_id")).agg(F.sum("total").alias("_more"))
        return state.join(more, ["doc_id", "node_id"], "left").select("doc_id", "node_id", (F.col("total") + F.coalesce("_more", F.lit(0))).alias("total"))

    return doubling(nodes, nodes.select("doc_id", "node_id", value.cast("long").alias("total")), step)


def subtree_sizes(nodes: DataFrame) -> DataFrame:  # G2
    return subtree_sums(nodes, F.lit(1)).withColumnRenamed("total", "nodes")


def group_bounds(children: DataFrame, keys: Sequence[str]) -> DataFrame:  # G4, P31
    """Box of the children that aren't hidden; at least 1x1, and 0,0,1,1 where none is left. children: keys, left, top, right, bottom, hidden."""
    shown = ~F.coalesce("hidden", F.lit(False))
    left, top = F.coalesce("left", F.lit(0.0)), F.coalesce("top", F.lit(0.0))
    right, bottom = left + F.greatest(F.lit(1.0), F.coalesce(F.col("right"), left + 1) - left), top + F.greatest(F.lit(1.0), F.coalesce(F.col("bottom"), top + 1) - top)
    got = children.groupBy(*keys).agg(*[f(F.when(shown, c)).alias(n) for n, f, c in (("l", F.min, left), ("t", F.min, top), ("r", F.max, right), ("b", F.max, bottom))])
    some = F.col("l").isNotNull()
    return got.select(*keys, F.coalesce("l", F.lit(0.0)).alias("left"), F.coalesce("t", F.lit(0.0)).alias("top"), F.when(some, F.greatest(F.lit(1.0), F.col("r") - F.col("l"))).otherwise(1.0).alias("width"), F.when(some, F.greatest(F.lit(1.0), F.col("b") - F.col("t"))).otherwise(1.0).alias("height"))


def scale_children(nodes: DataFrame, groups: DataFrame) -> DataFrame:  # P5
    """Direct children of groups moved and scaled into the group's frame. groups: doc_id, group_id, ox, oy, sx, sy."""
    g = groups.withColumnRenamed("group_id", "parent_id")
    rows = nodes.join(g, ["doc_id", "parent_id"], "left")
    hit = F.col("sx").isNotNull()
    return rows.withColumns({"x": F.when(hit, (F.col("x") - F.col("ox")) * F.col("sx")).otherwise(F.col("x")), "y": F.when(hit, (F.col("y") - F.col("oy")) * F.col("sy")).otherwise(F.col("y")), "width": F.when(hit, F.col("width") * F.col("sx")).otherwise(F.col("width")), "height": F.when(hit, F.col("height") * F.col("sy")).otherwise(F.col("height"))}).select(*nodes.columns)


def class_styles(rules: DataFrame) -> DataFrame:  # F8, J8: doc_id, sheet, ord, class, name, value -> last wins
    return rules.groupBy("doc_id", "class", "name").agg(F.max_by("value", F.struct("sheet", "ord")).alias("value"))


def inherited(nodes: DataFrame, values: DataFrame) -> DataFrame:  # J18
    """The value of each property at each node: the nearest ancestor that has one, inline before class before attribute, later classes before earlier.

    values: doc_id, node_id, name, value, rank (0 inline, 1 class, 2 attribute), class_pos. After k
    rounds a node has what lies less than 2**k levels above it.
    """
    own = F.min_by("value", F.struct(F.col("rank"), -F.coalesce("class_pos", F.lit(0))))
    state = values.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi").groupBy("doc_id", "node_id", "name").agg(own.alias("value"))

    def step(state, hops):
        above = hops.join(state.withColumnRenamed("node_id", "ancestor_id"), ["doc_id", "ancestor_id"]).select("doc_id", "node_id", "name", "value")
        return state.unionByName(above.join(state, ["doc_id", "node_id", "name"], "left_anti"))

    return doubling(nodes, state, step)


def world_matrices(nodes: DataFrame, own: Column) -> DataFrame:  # F26, W13
    """doc_id, node_id, matrix: product of the matrices from the root down."""

    def step(state, hops):
        above = hops.join(state.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("matrix").alias("_above")), ["doc_id", "ancestor_id"]).select("doc_id", "node_id", "_above")
        rows = state.join(above, ["doc_id", "node_id"], "left")
        return rows.select("doc_id", "node_id", F.when(F.col("_above").isNull(), F.col("matrix")).otherwise(multiply(F.col("_above"), F.col("matrix"))).alias("matrix"))

    # a node without a matrix of its own counts as the unit matrix
    return doubling(nodes, nodes.select("doc_id", "node_id", F.coalesce(own, matrix(*IDENTITY)).alias("matrix")), step)


def drop_empty_groups(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:  # P12
    """(nodes without groups that hold no leaf, the named groups among those dropped)."""
    leaves = subtree_sums(nodes, F.when(F.col("is_group"), 0).otherwise(1)).filter("total > 0").select("doc_id", "node_id")
    empty = nodes.filter("is_group").join(leaves, ["doc_id", "node_id"], "left_anti")
    return nodes.join(empty.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti"), empty.filter("name is not null and name <> ''")


def image_subtrees(nodes: DataFrame, root_ids: DataFrame) -> DataFrame:  # P24
    """Copies of subtrees that keep images and the branches above them; ids are new."""
    roots = root_ids.select("doc_id", "node_id", F.lit("inside").alias("name"), F.lit(True).alias("value"), F.lit(0).alias("rank"), F.lit(0).alias("class_pos"))
    inside = inherited(nodes, roots).select("doc_id", "node_id")
    image, mask = F.coalesce(F.col("type") == "image", F.lit(False)), F.coalesce("is_mask", F.lit(False))
    live = subtree_sums(nodes, F.when(image & ~mask, 1).otherwise(0)).filter("total > 0").select("doc_id", "node_id")
    live = live.unionByName(nodes.filter(image & mask).select("doc_id", "node_id")).distinct()
    kept = nodes.join(inside, ["doc_id", "node_id"], "left_semi").join(live, ["doc_id", "node_id"], "left_semi")
    return kept.withColumn("node_id", F.concat(F.lit("copy/"), "node_id")).withColumn("parent_id", F.concat(F.lit("copy/"), "parent_id"))


def in_z_order(nodes: DataFrame) -> DataFrame:  # O10, J17
    """Position among siblings: document order at the top level, inside a group by kind and then order."""
    # fixed values: the order of kinds inside a group
    rank = F.when(F.col("parent_id").isNull(), 0).otherwise(F.array_position(F.array(*map(F.lit, ("sp", "pic", "graphicFrame", "grpSp"))), F.col("tag")))
    w = Window.partitionBy("doc_id", "parent_id").orderBy(rank, "ord")
    return nodes.withColumn("z", F.row_number().over(w) - 1)
