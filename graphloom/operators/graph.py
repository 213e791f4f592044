"""Graph operators over edges (src, dst): reachability, neighbours, degrees."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import bucketed, cut_lineage

#: Rounds of one edge each before walks are lengthened (a power of two), and how many more walks than edges may be made.
PATIENCE, GROWTH = 4, 8
#: Rows of a frontier, or groups, that may be broadcast; groups that are numbered in one partition.
BROADCAST_ROWS, GROUPS = 200_000, 1_000_000


def adjacency(edges: DataFrame, nodes: DataFrame, source: str = "src", target: str = "dst", node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Forward and reverse adjacency: an edge counts forward if its source is a node, in reverse if both ends are."""
    names = nodes.select(F.col(node).alias("n_"))
    pairs = bucketed(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")), "pairs", "src")  # read for both
    forward = pairs.join(names, pairs["src"] == names["n_"], "left_semi")
    back = forward.join(names, forward["dst"] == names["n_"], "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward, back


def _steps(rows: DataFrame, size: int, links: DataFrame) -> DataFrame:
    """(node, word, bits) of all ends of links that begin at rows, at most `size`; one row per end and word."""
    ahead = F.broadcast(rows) if size <= BROADCAST_ROWS else rows
    hit = links.join(ahead, links["src"] == ahead["node"])
    return hit.groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))


def _merged(one: DataFrame, two: DataFrame) -> DataFrame:
    return one.unionByName(two).groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def _unseen(rows: DataFrame, seen: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows without the bits that are known."""
    for _, known in seen:
        rows = rows.join(known.withColumnRenamed("bits", "old_"), ["node", "word"], "left").select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old_", F.lit(0).cast("long")))).alias("bits"))
    return rows.where("bits <> 0")


def doubled(links: DataFrame, edges: int) -> DataFrame | None:
    """(src, dst) of all walks of two links; None if they would be many more than the graph has edges."""
    into, out = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i_")), links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o_"))
    walks = into.join(out, "node").agg(F.sum(F.col("i_").cast("double") * F.col("o_"))).first()[0] or 0
    if walks > GROWTH * edges:
        return None
    second = links.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    return bucketed(links.join(second, links["dst"] == second["mid"]).select("src", F.col("end").alias("dst")), "walks", "src")


def reach_words(starts: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, word, bits): for every node the set of groups that reach it, 63 groups a word, sets without members left out.

    starts, known: node, word, bits; edges: src, dst, without nulls. Rows of `known` count as reached and lead nowhere
    that isn't known or a start. The first PATIENCE rounds go one edge further each, from
    what is new only: wide, shallow graphs end here. Deep ones go on by walks of 4, 8, 16, ... edges, each found by
    joining the walks of half the length with themselves, so the rounds grow with the logarithm of the depth. Walks
    are lengthened as long as there are few of them; beyond that the longest walks so far are repeated.

    Edges and walks are written once, bucketed and sorted by source; repeated edges change nothing, so edges are told
    apart only when walks are to be counted. What is known is kept in few tables: two of like size are
    merged. Each round cuts the lineage, so a lost executor redoes one round at most.
    """
    near = bucketed(edges.select("src", "dst"), "edges", "src", False)
    seen = [] if known is None else [(known.count(), known)]
    fresh = cut_lineage(_unseen(starts.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")), seen))
    links, length, covered, many = near, 1, 0, 0
    while size := fresh.count():
        seen.append((size, fresh))
        while len(seen) > 1 and 2 * seen[-1][0] >= seen[-2][0]:
            (m, late), (n, early) = seen.pop(), seen.pop()
            seen.append((m + n, cut_lineage(_merged(early, late))))
        ahead = fresh  # what the last round found, as far away as walks are long
        while covered >= PATIENCE and 2 * length <= covered + 1 and many is not None:
            if not many:
                links = bucketed(near, "edges", "src")
                many = links.count()
            longer = doubled(links, many)
            if longer is None:
                many = None  # walks stay as long as they are
            else:
                links, length, ahead, size = longer, 2 * length, reduce(_merged, [rows for _, rows in seen]), sum(n for n, _ in seen)
        fresh = cut_lineage(_unseen(_steps(ahead, size, links), seen))
        covered += length
    return reduce(_merged, [rows for _, rows in seen]) if len(seen) > 1 else seen[0][1] if seen else fresh


def reachable(starts: DataFrame, edges: DataFrame, by: tuple[str, ...] = (), nodes: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Every node reachable from the starts (by..., node), starts included, per value of `by`.

    With `nodes` (node), starts that are none don't count and only nodes are returned; paths may lead through
    other names, such as modules. Null names are no starts and no ends; a null in `by` is a value like others;
    repeated rows count once. The values of `by` that reach a node are one set of bits (see reach_words), not rows.
    Rows of `known` (by..., node) are returned, too, and aren't followed: their successors must be known or starts.
    """
    starts = starts.select(*by, "node").where("node is not null").distinct()
    names = None if nodes is None else nodes.select("node")
    starts = cut_lineage(starts if names is None else starts.join(names, "node", "left_semi").select(*by, "node"))
    spark, number = starts.sparkSession, F.monotonically_increasing_id()
    if by:
        groups = starts.select(*by) if known is None else starts.select(*by).union(known.select(*by))
        groups = cut_lineage(groups.distinct())
        many = groups.count()
        # numbers have gaps between partitions only, so words are full
        groups = groups.coalesce(1 + many // GROUPS).withColumn("id_", number)
    else:
        many, groups = 1, spark.range(1).select(F.col("id").alias("id_"))
    groups = cut_lineage(groups.select(*by, F.floor(F.col("id_") / 63).alias("word"), F.expr("shiftleft(1L, cast(id_ % 63 as int))").alias("bit")))
    groups = F.broadcast(groups) if many <= BROADCAST_ROWS else groups

    def words(rows: DataFrame) -> DataFrame:
        same = reduce(lambda a, c: a & rows[c].eqNullSafe(groups[c]), by, F.lit(True))
        return rows.join(groups, same).select("node", "word", F.col("bit").alias("bits"))

    before = None if known is None else cut_lineage(words(known.select(*by, "node")).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    found = reach_words(words(starts), edges.where("src is not null and dst is not null"), before)
    found = found if names is None else found.join(names, "node", "left_semi")
    return found.join(groups, "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select(*by, "node")


def maintained(reached: DataFrame, old_edges: DataFrame, new_edges: DataFrame, old_starts: DataFrame, new_starts: DataFrame, by: str = "cluster") -> DataFrame:
    """(by, node) reachable over new_edges from new_starts, given what was reachable over old_edges from old_starts.

    Over-delete, then derive anew: what removed edges and starts led to is followed over the old edges and dropped;
    the rest still stands. What starts, and edges of rows that stand, lead to beyond it is followed over the new edges.
    So the work grows with what the change touches. `by` must not be null; repeated rows count once.
    """
    pair = lambda edges: edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    was, now = cut_lineage(pair(old_edges)), cut_lineage(pair(new_edges))
    begun, begins = (s.select(by, "node").where("node is not null").distinct() for s in (old_starts, new_starts))
    cut = was.join(now, ["src", "dst"], "left_anti")
    lost = reached.join(cut, reached["node"] == cut["src"]).select(by, F.col("dst").alias("node"))
    lost = lost.unionByName(begun.join(begins, [by, "node"], "left_anti"))
    stands = cut_lineage(reached.select(by, "node").join(reachable(lost, was, by=(by,)), [by, "node"], "left_anti").distinct())
    onward = stands.join(now, stands["node"] == now["src"]).select(by, F.col("dst").alias("node"))
    seeds = onward.unionByName(begins).distinct().join(stands, [by, "node"], "left_anti")
    return reachable(seeds, now, by=(by,), known=stands)


def spread(values: DataFrame, edges: DataFrame, along: Callable[[Column, int], Column] = lambda value, length: value, ready: bool = False) -> DataFrame:
    """(node, value): the least value that any walk brings to a node, its own included; along(value, length) is what a walk makes of it.

    values: one row per node, without nulls; edges: src, dst. Values that walks lower (layers, say) need a graph without
    cycles. Rounds go as in reach_words: a few of one edge each, then by walks of doubling length, as long as they are few.
    ready: edges are a table of `bucketed`, by src, and aren't written again.
    """
    near = edges if ready else bucketed(edges.select("src", "dst"), "edges", "src")
    state = ahead = cut_lineage(values.select("node", "value"))
    links, length, covered, many = near, 1, 0, 0
    while True:
        hit = links.join(ahead, links["src"] == ahead["node"]).groupBy(F.col("dst").alias("node")).agg(F.min(along(F.col("value"), length)).alias("value"))
        fresh = cut_lineage(hit.join(state.withColumnRenamed("value", "old_"), "node").where("value < old_").select("node", "value"))
        if fresh.isEmpty():
            return state
        covered += length
        state = cut_lineage(state.join(fresh.withColumnRenamed("value", "new_"), "node", "left").select("node", F.coalesce("new_", "value").alias("value")))
        ahead = fresh
        while covered >= PATIENCE and 2 * length <= covered + 1 and many is not None:
            many = many or near.count()
            longer = doubled(links, many)
            if longer is None:
                many = None
            else:
                links, length, ahead = longer, 2 * length, state


def unreachable(nodes: DataFrame, starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no start reaches."""
    return nodes.join(reachable(starts, edges), "node", "left_anti")


def callers_of(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("dst") == target).select(F.col("src").alias("node")).distinct()


def callees_of(edges: DataFrame, source: str) -> DataFrame:
    return edges.where(F.col("src") == source).select(F.col("dst").alias("node")).distinct()


def incoming(edges: DataFrame) -> DataFrame:
    """(node, callers, only_self) for every target."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("callers"), F.bool_and(F.col("src") == F.col("dst")).alias("only_self"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, callers, callees, only_self), 0 and false without edges."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("callees"))
    both = nodes.select("node").distinct().join(incoming(edges), "node", "left").join(out, "node", "left")
    return both.select("node", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"), F.coalesce("only_self", F.lit(False)).alias("only_self"))


def targets_by_type(edges: DataFrame) -> DataFrame:
    """(node, imported, called): whether any edge of that kind ends in the node."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("edge_type") == "imports").alias("imported"), F.max(F.col("edge_type").isin("calls", "instantiates", "inherits")).alias("called"))


def references(edges: DataFrame) -> DataFrame:
    """(node, referenced, only_self, imported, called) for every target, in one grouping: true, and as in incoming and targets_by_type."""
    kind = F.col("edge_type")
    called = F.max(kind.isin("calls", "instantiates", "inherits")).alias("called")
    return edges.groupBy(F.col("dst").alias("node")).agg(F.lit(True).alias("referenced"), F.bool_and(F.col("src") == F.col("dst")).alias("only_self"), F.max(kind == "imports").alias("imported"), called)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    names = nodes.select(F.col("node").alias("n_"))
    kept = edges.join(names, edges["src"] == names["n_"], "left_semi")
    return kept.join(names, kept["dst"] == names["n_"], "left_semi")


def novel(edges: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("src", "dst", "edge_type")) -> DataFrame:
    """Distinct edges that aren't known yet."""
    return edges.dropDuplicates(list(keys)).join(known.select(*keys).distinct(), list(keys), "left_anti")
