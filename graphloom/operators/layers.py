"""Layers of a directed graph: strongly connected components, longest-path layers over them, order and coordinates.

Edges are (src, dst); edges with a null end, from a node to itself and repeated ones change nothing. Ends of edges are
nodes, too, whether they are listed or not. Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import graph
from graphloom.session import bucketed, cut_lineage

#: Trimming goes on as long as it leaves at most this share of the edges.
TRIMMED = 0.9


class Sizes(NamedTuple):
    """Width and height of a node, and the gaps between nodes of a layer and between layers."""

    width: int
    height: int
    node_gap: int = 50
    layer_gap: int = 80


#: Sizes of nodes in the graph's view, in a flow and in the view of one feature's flow.
GRAPH, FLOW, FEATURE = Sizes(200, 60), Sizes(300, 120), Sizes(380, 150)


def _parts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct nodes, ends included, and distinct edges; the latter once, in buckets by src, for all that reads them."""
    pairs = bucketed(edges.select("src", "dst").where("src <> dst"), "pairs", "src")
    return cut_lineage(nodes.select("node").where("node is not null").unionByName(_ends(pairs)).distinct()), pairs


def _ends(pairs: DataFrame) -> DataFrame:
    """(node) of both ends; sources are told apart in their bucket, targets are not."""
    return pairs.select(F.col("src").alias("node")).distinct().unionByName(pairs.select(F.col("dst").alias("node")))


def _trimmed(inner: DataFrame) -> tuple[DataFrame, int]:
    """Edges that begin where one ends and end where one begins, again and again while that drops many, and their number."""
    size, before = inner.count(), 0
    while size and (not before or size <= TRIMMED * before):
        ahead, behind = inner.select(F.col("dst").alias("src")).distinct(), inner.select(F.col("src").alias("dst")).distinct()
        inner = cut_lineage(inner.join(ahead, "src", "left_semi").join(behind, "dst", "left_semi").select("src", "dst"))
        before, size = size, inner.count()
    return _untailed(inner, size) if size else (inner, size)


def _untailed(inner: DataFrame, size: int) -> tuple[DataFrame, int]:
    """inner between nodes that walks of many edges lead to and from, and its number of edges.

    A node on a cycle has such walks of any length, so tails go at once, not edge by edge. Walks are doubled as long as
    they are few and their ends still become fewer.
    """
    links, length, kept, many = inner, 1, None, 0
    while length < size and (longer := graph.doubled(links, size)) is not None:
        links, length, before = longer, 2 * length, many
        ahead, behind = links.select(F.col("dst").alias("node")).distinct(), links.select(F.col("src").alias("node"))
        kept = cut_lineage(ahead.join(behind, "node", "left_semi"))
        many = kept.count()
        if many in (0, before):
            break
    if kept is None:
        return inner, size
    inner = cut_lineage(graph.induced(inner, kept))
    return inner, inner.count()


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): nodes that reach each other share a component, named by its smallest node.

    Edges that nothing leads to or from are trimmed off, and tails of any length; nodes without an edge then are
    components of their own. Each of the rest takes the least random number of all nodes that reach it; those of one number that reach its owner backwards are the owner's
    component. What is left goes on by itself, along edges between equal numbers: the largest part halves or so every
    time, so the rounds grow with the logarithm of the nodes, chains included. All state is written tables.
    """
    return _components(*_parts(nodes, edges))


def _components(left: DataFrame, inner: DataFrame) -> DataFrame:
    """strong_components of what _parts gives."""
    found, turn = [], 0
    while True:
        inner, size = _trimmed(inner)
        if not size:
            found.append(left.select("node", F.col("node").alias("root")))
            break
        kept = cut_lineage(_ends(inner).distinct())
        found.append(cut_lineage(left.join(kept, "node", "left_anti").select("node", F.col("node").alias("root"))))
        values = kept.select("node", F.struct(F.xxhash64("node", F.lit(turn)).alias("draw"), "node").alias("value"))
        colours = cut_lineage(graph.spread(values, inner).select("node", F.col("value.node").alias("root")))
        same = inner.join(colours.select(F.col("node").alias("src"), "root"), "src").join(colours.select(F.col("node").alias("dst"), F.col("root").alias("other")), "dst")
        same = cut_lineage(same.where("root = other").select("src", "dst"))
        owners = colours.where("node = root").select("node")
        inside = cut_lineage(graph.reachable(owners, same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        found.append(cut_lineage(colours.join(inside, "node", "left_semi")))
        left = cut_lineage(kept.join(inside, "node", "left_anti"))
        inner, turn = cut_lineage(graph.induced(same, left)), turn + 1
    every = reduce(DataFrame.unionByName, found)
    if len(found) == 1:  # nothing but nodes by themselves
        return every.select("node", F.col("root").alias("component"))
    # components of one node are named already, only others are looked up
    names = cut_lineage(every.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n_")).where("n_ > 1").drop("n_"))
    names = F.broadcast(names) if names.count() <= graph.BROADCAST_ROWS else names
    return every.join(names, "root", "left").select("node", F.coalesce("component", "node").alias("component"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, layer): the longest path over components that leads to the node's, 0 if none does."""
    return _layers(*_parts(nodes, edges))[0]


def _layers(left: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """layers of what _parts gives, and the edges between nodes of different layers.

    An edge that leaves a component leads to a greater layer, one inside it stays. Where every node is a component of
    its own, edges are taken as they are.
    """
    member = cut_lineage(_components(left, pairs))
    moved = member.where("node <> component")
    many = moved.count()
    if not many:
        depth = graph.spread(member.select("node", F.lit(0).cast("long").alias("value")), pairs, lambda value, length: value - length, True)
        return depth.select("node", F.col("node").alias("component"), (-F.col("value")).alias("layer")), pairs
    moved = F.broadcast(moved) if many <= graph.BROADCAST_ROWS else moved
    across = pairs
    for end in ("src", "dst"):
        across = across.join(moved.select(F.col("node").alias(end), F.col("component").alias(f"{end}_")), end, "left")
    across = cut_lineage(across.select("src", "dst", F.coalesce("src_", "src").alias("src_"), F.coalesce("dst_", "dst").alias("dst_")).where("src_ <> dst_"))
    start = member.select(F.col("component").alias("node"), F.lit(0).cast("long").alias("value")).distinct()
    depth = graph.spread(start, across.select(F.col("src_").alias("src"), F.col("dst_").alias("dst")), lambda value, length: value - length)
    found = member.join(depth.withColumnRenamed("node", "component"), "component").select("node", "component", (-F.col("value")).alias("layer"))
    return found, across.select("src", "dst")


def placed(rows: DataFrame, order: str) -> DataFrame:
    """(node, component, layer, place): places of each layer from 0, by `order`, then node; a layer may be of any size.

    Rows are sorted by range over all tasks and counted per task; only those counts, one a task, meet in one place.
    Ranges are sampled in a pass of its own, so rows should be a written table.
    """
    keys = ["layer", order, "node"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut_lineage(rows.select("node", "component", "layer", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
    tasks = rows.groupBy("task").agg(F.count("*").alias("n_"), F.min("at").alias("first"))
    tasks = tasks.select("task", (F.sum("n_").over(Window.orderBy("task")) - F.col("n_") - F.col("first")).alias("shift"))
    rows = rows.join(F.broadcast(tasks), "task").withColumn("at", F.col("at") + F.col("shift"))
    starts = rows.groupBy("layer").agg(F.min("at").alias("start"))
    return rows.join(starts, "layer").select("node", "component", "layer", (F.col("at") - F.col("start")).alias("place"))


def layout(nodes: DataFrame, edges: DataFrame, sizes: Sizes = GRAPH, sweeps: int = 1, down: bool = True) -> DataFrame:
    """(node, component, layer, place, x, y): the top left corner of every node, layers from top to bottom or left to right.

    Places start in order of names; each sweep orders all layers at once by the mean place of predecessors from
    other layers, where a node without one keeps its place. Nodes of one component share a layer.
    """
    rows, pairs = _layers(*_parts(nodes, edges))
    found = cut_lineage(placed(cut_lineage(rows), "node"))
    for _ in range(sweeps):
        mean = pairs.join(found.select(F.col("node").alias("src"), F.col("place").alias("from")), "src")
        mean = mean.groupBy(F.col("dst").alias("node")).agg((F.sum("from").cast("double") / F.count("*")).alias("mean"))
        rows = found.join(mean, "node", "left").select("node", "component", "layer", F.coalesce("mean", F.col("place").cast("double")).alias("mean"))
        found = cut_lineage(placed(cut_lineage(rows), "mean"))
    step, rank = (sizes.width, sizes.height) if down else (sizes.height, sizes.width)
    across, along = F.col("place") * (step + sizes.node_gap), F.col("layer") * (rank + sizes.layer_gap)
    return found.select("*", (across if down else along).alias("x"), (along if down else across).alias("y"))
