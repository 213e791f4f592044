"""Features: clusters of entry points, what they reach, who owns it, and their names.

Null nodes and features take no part; repeated rows of a node in a feature count once; ties go to the least
feature, order column or name, so results don't depend on the order of rows; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators.graph import reachable

#: Verbs that say nothing about a feature.
VERBS = ("get", "set", "list", "create", "update", "delete", "post", "put")
MORE_VERBS = (*VERBS, "start", "stop", "run", "is", "has", "do")


def cluster_entry_points(entry_points: DataFrame) -> DataFrame:
    """Adds cluster_idx and cluster_name, which stays the same when others come or go: routes by URL prefix, commands by group, others by folder; in order of first appearance.

    Reads node_name, entry_type, route_info (map) and ep_seq.
    """
    url, command = F.col("route_info")["url"], F.col("route_info")["command"]
    kind = F.when(F.col("entry_type") == "http_route", 0).when(F.col("entry_type") == "websocket", 1).when(F.col("entry_type") == "cli", 2).otherwise(3)
    key = F.when(kind < 2, fn.url_prefix(F.coalesce(url, F.lit("")))).when(kind == 2, fn.cli_group(command, F.col("node_name"))).otherwise(fn.directory_key(F.col("node_name")))
    keyed = entry_points.withColumn("kind_", kind).withColumn("cluster_key", key)
    order = keyed.groupBy("kind_", "cluster_key").agg(F.min("ep_seq").alias("first_"))
    # one row per cluster, not per entry point, is numbered
    order = order.withColumn("cluster_idx", F.row_number().over(Window.orderBy("kind_", "first_")) - 1).drop("first_")
    return keyed.join(order, ["kind_", "cluster_key"]).withColumn("cluster_name", F.concat_ws(":", F.col("kind_").cast("string"), "cluster_key")).drop("kind_")


def tag_nodes(clusters: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, node): all nodes that the entry points of each cluster reach, in one loop for all clusters."""
    return reachable(clusters.select("cluster", "node"), edges, by=("cluster",), nodes=nodes)


def buckets(nodes: DataFrame, tagged: DataFrame) -> DataFrame:
    """(node, bucket): exclusive to one cluster, shared by several, or unmatched."""
    ends = tagged.groupBy("node").agg(F.coalesce(F.min("cluster") < F.max("cluster"), F.lit(False)).alias("several"))
    kind = F.when(F.col("several").isNull(), "unmatched").when(F.col("several"), "shared").otherwise("exclusive")
    return nodes.select("node").distinct().join(ends, "node", "left").select("node", kind.alias("bucket"))


def assign_exclusive(membership: DataFrame, entry_counts: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(node, feature): the smallest feature that holds the node, then the least feature.

    membership (feature, node), entry_counts (feature, entries). With listed (feature, node), nodes that a feature lists
    belong to it beside what it reaches, and its size is what it lists.
    """
    sized = membership if listed is None else listed
    size = sized.groupBy("feature").agg(F.countDistinct("node").alias("nodes_")).join(entry_counts, "feature", "full")
    size = size.select("feature", (F.coalesce("nodes_", F.lit(0)) + F.coalesce("entries", F.lit(0))).alias("size_"))
    held = membership.select("feature", "node") if listed is None else membership.select("feature", "node").unionByName(listed.select("feature", "node"))
    best = held.where("node is not null").join(size, "feature", "left").groupBy("node").agg(F.min(F.struct(F.coalesce("size_", F.lit(0)).alias("size_"), "feature")).alias("best"))
    return best.select("node", F.col("best.feature").alias("feature"))


def chunks(entry_points: DataFrame, names: int, order: Column) -> DataFrame:
    """Adds chunk (from 0): equal runs for each of `names` suggested features, the rest in the last.

    Meant for the entry points of one feature, a handful by nature; many features go in one call with a
    column `feature`.
    """
    whole = Window.partitionBy("feature")
    place = F.row_number().over(whole.orderBy(order)) - 1
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(whole) / names))
    return entry_points.withColumn("chunk", F.least(F.floor(place / size), F.lit(names - 1)).cast("int"))


def overlap(members: DataFrame, one: str, two: str) -> DataFrame:
    """Jaccard similarity of two clusters' node sets, counted, not collected."""
    both = members.where(F.col("cluster").isin(one, two)).groupBy("node").agg(F.countDistinct("cluster").alias("n_"))
    return both.agg(F.coalesce(F.avg(F.when(F.col("n_") == 2, 1.0).otherwise(0.0)), F.lit(0.0)).alias("jaccard"))


def structure(features: DataFrame, membership: DataFrame, entry_counts: DataFrame, reached: DataFrame) -> DataFrame:
    """(feature, nodes, unreached, ratio, issue): issues of features, null if there is none.

    reached (feature, node) are the nodes that a feature's own entry points reach.
    """
    hit = reached.select("feature", "node", F.lit(1).alias("hit_")).distinct()
    count = membership.distinct().join(hit, ["feature", "node"], "left").groupBy("feature").agg(F.count("*").alias("nodes"), F.sum(F.when(F.col("hit_").isNull(), 1).otherwise(0)).alias("unreached"))
    out = features.select("feature").join(count, "feature", "left").join(entry_counts, "feature", "left").na.fill(0, ["nodes", "unreached", "entries"])
    ratio = F.when(F.col("nodes") > 0, F.col("unreached") / F.col("nodes")).otherwise(0.0)
    issue = F.when(F.col("entries") == 0, "no_entry_points").when(F.col("nodes") == 0, "no_nodes").when(ratio > 0.5, "mostly_unreachable")
    return out.select("feature", "nodes", "unreached", ratio.alias("ratio"), issue.alias("issue"))


def most_common_word(words: DataFrame) -> DataFrame:
    """(group, word): the most frequent word of each group; of several the one that comes first. Reads group, word, seq."""
    count = words.groupBy("group", "word").agg(F.count("*").alias("n_"), F.min("seq").alias("first_"))
    best = count.groupBy("group").agg(F.min(F.struct((-F.col("n_")).alias("n_"), "first_", "word")).alias("best"))
    return best.select("group", F.col("best.word").alias("word"))


def shared_words(sets: Column) -> Column:
    """Words that all of an array's word lists hold, without verbs."""
    return F.array_except(F.aggregate(sets, sets[0], lambda a, s: F.array_intersect(a, s)), F.array(*map(F.lit, VERBS)))


def _cluster_words(flat: DataFrame, sizes: DataFrame) -> DataFrame:
    """(idx_, shared, common): words that all functions of a cluster hold, without verbs, and the most frequent longer word, first of several.

    flat: cluster_idx, ep_seq, short; sizes: cluster_idx, points_, named_. A cluster with a function without a name has neither.
    """
    words = flat.select("cluster_idx", "ep_seq", "short", F.posexplode(F.split("short", "_")).alias("at", "word"))
    first = F.struct("ep_seq", "short", "at")
    counted = words.groupBy("cluster_idx", "word").agg(F.count("*").alias("n_"), F.sum(F.when(F.col("at") + 1 == F.array_position(F.split("short", "_"), F.col("word")), 1)).alias("points"), F.min(first).alias("first_"))
    whole = sizes.where("points_ = named_").select(F.col("cluster_idx").alias("idx_"), "points_")
    counted = counted.join(whole, F.col("cluster_idx").eqNullSafe(F.col("idx_")))
    told = ~F.lower("word").isin(*MORE_VERBS) & (F.length("word") > 2)
    shared = F.collect_list(F.when((F.col("points") == F.col("points_")) & ~F.col("word").isin(*VERBS), F.col("word")))
    return counted.groupBy("idx_").agg(shared.alias("shared"), F.min_by("word", F.when(told, F.struct((-F.col("n_")).alias("n_"), "first_"))).alias("common"))


def name_clusters(entry_points: DataFrame) -> DataFrame:
    """(cluster_idx, name, description): from what the cluster's URLs share, else its functions' words, command or type.

    Reads cluster_idx, node_name, entry_type, route_info and ep_seq. Words are counted as rows; a cluster's functions
    make one array, for its description lists them.
    """
    short = fn.short_name(F.col("node_name"))
    url = F.nullif(fn.strip_params(F.coalesce(F.col("route_info")["url"], F.lit(""))), F.lit(""))
    flat = entry_points.select("cluster_idx", "ep_seq", "entry_type", short.alias("short"), url.alias("url"), F.nullif(F.col("route_info")["command"], F.lit("")).alias("command"), F.nullif(F.upper(F.col("route_info")["method"]), F.lit("")).alias("method"))
    row = flat.groupBy("cluster_idx").agg(
        F.min("url").alias("low"), F.max("url").alias("high"), F.sort_array(F.collect_list(F.struct("ep_seq", "short"))).alias("list"),
        F.min_by("command", F.when(F.col("command").isNotNull(), F.col("ep_seq"))).alias("command"), F.min("entry_type").alias("low_type"), F.max("entry_type").alias("high_type"),
        F.min_by("url", F.when(F.col("entry_type") == "websocket", F.col("ep_seq"))).alias("socket"), F.array_sort(F.collect_set("method")).alias("methods"),
        F.count("*").alias("points_"), F.count("short").alias("named_"),
    )
    row = row.join(_cluster_words(flat, row.select("cluster_idx", "points_", "named_")), F.col("cluster_idx").eqNullSafe(F.col("idx_")), "left").drop("idx_")
    names, shared = F.transform("list", lambda x: x["short"]), F.col("shared")
    common = F.regexp_replace(fn.common_prefix(F.col("low"), F.col("high")), "^/+|/+$", "")
    alone = F.col("low_type") == F.col("high_type")
    name = F.coalesce(
        F.when(fn.snake(common) != "", fn.title(common)),
        F.when(F.size(names) == 1, fn.title(names[0])),
        F.when(F.size(shared) > 0, F.array_join(F.transform(F.array_sort(shared), fn.title), " ")),
        F.nullif(fn.snake(F.col("command")), F.lit("")),
        F.when(alone & (F.col("low_type") == "websocket"), F.concat(F.coalesce(F.nullif(fn.title(F.col("socket")), F.lit("")), F.lit("WebSocket")), F.lit(" (WS)"))),
        F.when(alone & (F.col("low_type") == "cli"), F.concat(F.lit("CLI "), F.col("cluster_idx").cast("string"))),
        fn.title(F.col("common")),
        F.nullif(F.array_join(F.transform(F.slice(names, 1, 2), fn.title), " & "), F.lit("")),
        F.concat(F.lit("feature_"), F.col("cluster_idx").cast("string")),
    )
    route = F.when(F.size("methods") > 0, F.concat(F.array_join("methods", "/"), F.lit(" /"), common)).otherwise(F.concat(F.lit("Handles /"), common))
    listed = F.concat(F.when(F.size(names) == 1, "Endpoint: ").otherwise("Endpoints: "), F.array_join(names, ", "))
    return row.select("cluster_idx", name.alias("name"), F.when(fn.snake(common) != "", route).otherwise(listed).alias("description"))


def drop_empty(features: DataFrame, membership: DataFrame, entry_points: DataFrame) -> DataFrame:
    """Features (feature, ...) with a node (feature, node) or an entry point (feature, ...)."""
    used = membership.select("feature").union(entry_points.select("feature")).where("feature is not null").distinct()
    return features.join(used, "feature", "left_semi")


def split_features(entry_points: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Adds part and name of the sub-feature to the entry points of features that are to be split; the others go.

    entry_points: feature, ep_seq and any others; suggestions: feature, names (array, in order). Entry points are
    dealt in their order in runs of equal length, what is left goes to the last name; features without names stay whole.
    """
    rows = entry_points.join(suggestions.where(F.size("names") > 0).select("feature", "names"), "feature")
    whole = Window.partitionBy("feature")
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(whole) / F.size("names")))
    place = F.row_number().over(whole.orderBy("ep_seq")) - 1
    part = F.least(F.floor(place / size), F.size("names") - 1).cast("int")
    return rows.withColumn("part", part).withColumn("name", F.element_at("names", F.col("part") + 1)).drop("names")


def valid_splits(changes: DataFrame, entry_points: DataFrame, reached: DataFrame) -> DataFrame:
    """Of suggested changes (type, feature) those that the graph allows: reviews, and splits of features whose first
    two entry points with a node reach sets that share less than half of their nodes.

    entry_points: feature, ep_seq, start (null if it is no node); reached: start, node.
    """
    starts = entry_points.where("start is not null")
    place = F.row_number().over(Window.partitionBy("feature").orderBy("ep_seq"))
    two = starts.withColumn("place_", place).where("place_ <= 2").join(reached.select("start", "node").distinct(), "start")
    counted = two.groupBy("feature", "node").agg(F.countDistinct("place_").alias("n_"), F.max("place_").alias("p_"))
    shared = counted.groupBy("feature").agg(F.avg(F.when(F.col("n_") == 2, 1.0).otherwise(0.0)).alias("share_"))
    many = entry_points.groupBy("feature").agg(F.count("*").alias("points_"), F.count("start").alias("starts_")).where("points_ >= 2 and starts_ >= 2")
    apart = many.join(shared.where("share_ < 0.5"), "feature").select("feature")
    return changes.where("type = 'review'").unionByName(changes.where("type = 'split'").join(apart, "feature", "left_semi"))


def by_name(features: DataFrame, name: str | Column) -> DataFrame:
    """The feature of a name, or of a scalar subquery's name; of several the last (greatest feature_idx)."""
    found = features.where(F.col("name") == name)
    return found.groupBy("name").agg(F.max_by(F.struct(*features.columns), "feature_idx").alias("f")).select("f.*")


def qualify_names(features: DataFrame) -> DataFrame:
    """Adds unique_name: repeated names get a qualifier in brackets, else their number. Reads name, qualifier, idx."""
    same = Window.partitionBy("name")
    place = F.row_number().over(same.orderBy("idx"))
    made = F.when(F.col("qualifier").isNotNull() & (F.col("qualifier") != ""), F.concat("name", F.lit(" ("), "qualifier", F.lit(")"))).otherwise(F.concat("name", F.lit(" "), place.cast("string")))
    return features.withColumn("unique_name", F.when(F.count("*").over(same) > 1, made).otherwise(F.col("name")))
