"""Resolution of symbolic names: call targets, imports, entry points, class members, foreign keys.

Suffix conditions become equalities by exploding the suffixes of the shorter-lived side, so no join here
is a product.

Null names resolve to nothing; ties go to the first or last node in order of `seq`, as each function says; repeated
nodes and ids of one key count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suffixes(path: Column, separator: str = "/") -> Column:
    """All suffixes of a path at its separators, the whole path first."""
    parts = F.split(path, separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), separator))


def first_wins(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("place_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("place_ = 1").drop("place_")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return first_wins(rows, key, [F.desc(c) for c in order])


def lookup_table(nodes: DataFrame) -> DataFrame:
    """(strategy, scope, key, fqn): every way in which a target may name a node; ambiguous names are left out.

    nodes: fqn, qualified_name (module:Class.name), name, file_path, seq. Strategies, best first: 1 the
    exact name; 2 module and name; 3 Class.name; 4 the only such name of a file; 5 the only one at all.
    """
    module = F.substring_index("qualified_name", ":", 1)
    local = F.substring_index("qualified_name", ":", -1)
    none = F.lit("").alias("scope")
    exact = nodes.select(F.lit(1).alias("strategy"), none, F.col("fqn").alias("key"), "fqn", "seq")
    dotted = nodes.select(F.lit(2), none, F.concat_ws("::", module, F.col("name")), "fqn", "seq")
    tail = nodes.select(F.lit(2), none, F.concat_ws("::", F.substring_index(module, ".", -1), F.col("name")), "fqn", "seq")
    member = nodes.where(local.contains(".")).select(F.lit(3), none, F.concat_ws(".", F.element_at(F.split(local, r"\."), -2), F.col("name")), "fqn", "seq")
    last = last_wins(exact.union(dotted).union(tail).union(member), ["strategy", "scope", "key"], ["seq"]).drop("seq")
    in_file = nodes.groupBy("file_path", "name").agg(F.count("*").alias("n_"), F.min("fqn").alias("fqn")).where("n_ = 1").select(F.lit(4), F.col("file_path"), F.col("name"), "fqn")
    anywhere = nodes.groupBy("name").agg(F.count("*").alias("n_"), F.min("fqn").alias("fqn")).where("n_ = 1").select(F.lit(5), F.lit(""), F.col("name"), "fqn")
    return last.union(in_file).union(anywhere)


def resolve_targets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds resolved (null if nothing matches) to edges (edge_id, source, target): the best strategy that hits.

    source is a qualified name; `self.x` means the source's class, else its file.
    """
    home = last_wins(nodes.select(F.col("qualified_name").alias("source"), F.col("file_path").alias("home"), _owner().alias("owner"), "seq"), ["source"], ["seq"]).drop("seq")
    rows = edges.join(home, "source", "left")
    target, own = F.col("target"), F.when(F.col("target").startswith("self."), F.substring(F.col("target"), 6, 1 << 20))
    head = F.regexp_extract(target, r"^(.*)\.[^.]+$", 1)
    short = F.element_at(F.split(target, r"\."), -1)

    def way(priority: int, strategy: int, scope: Column, key: Column) -> Column:
        return F.struct(F.lit(priority).alias("priority"), F.lit(strategy).alias("strategy"), scope.alias("scope"), key.alias("key"))

    empty = F.lit("")
    ways = F.array(
        way(1, 1, empty, target), way(2, 2, empty, F.regexp_replace(target, r"^([^.]*)\.", "$1::")), way(3, 2, empty, F.when(head != "", F.concat_ws("::", head, short))),
        way(4, 3, empty, F.when(own.isNull(), target)), way(5, 3, empty, F.when(F.col("owner").isNotNull() & own.isNotNull(), F.concat_ws(".", "owner", own))),
        way(6, 4, F.coalesce("home", empty), F.coalesce(own, short)), way(7, 5, empty, F.coalesce(own, short)),
    )
    tried = rows.select("edge_id", F.explode(ways).alias("w")).select("edge_id", "w.*").where("key is not null")
    # merged, whatever the nodes' files say of their size: the table holds each node six times
    hits = tried.join(lookup_table(nodes).hint("merge"), ["strategy", "scope", "key"]).groupBy("edge_id").agg(F.min_by("fqn", "priority").alias("resolved"))
    return edges.join(hits, "edge_id", "left")


def _owner() -> Column:
    local = F.substring_index("qualified_name", ":", -1)
    return F.when(local.contains("."), F.element_at(F.split(local, r"\."), -2))


def resolve_sources(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds source_fqn: a node's own name, its qualified name's node, its module's first node, else unchanged."""
    own = nodes.select(F.col("fqn").alias("source"), F.col("fqn").alias("a_")).distinct()
    qualified = nodes.groupBy(F.col("qualified_name").alias("source")).agg(F.min_by("fqn", "seq").alias("b_"))
    module = nodes.groupBy(F.substring_index("qualified_name", ":", 1).alias("source")).agg(F.min_by("fqn", "seq").alias("c_"))
    rows = edges.join(own, "source", "left").join(qualified, "source", "left").join(module, "source", "left")
    return rows.withColumn("source_fqn", F.coalesce("a_", "b_", "c_", "source")).drop("a_", "b_", "c_")


def module_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(module_path, file_path): files that a dotted module names, whole or by suffix."""
    stem = F.regexp_replace(F.regexp_replace("file_path", r"\.py$", ""), "/__init__$", "")
    ends = files.select("file_path", F.explode(suffixes(stem)).alias("key"))
    return modules.select("module_path", F.replace("module_path", F.lit("."), F.lit("/")).alias("key")).distinct().join(ends, "key").select("module_path", "file_path").distinct()


def resolve_imports(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(import_id, symbol, fqn): nodes that imported names stand for. imports: import_id, module_path, imported_names."""
    names = imports.select("import_id", "module_path", F.explode("imported_names").alias("symbol"))
    places = module_files(imports, nodes.select("file_path").distinct())
    return names.join(places, "module_path").join(nodes.select("file_path", F.col("name").alias("symbol"), "fqn"), ["file_path", "symbol"]).select("import_id", "symbol", "fqn").distinct()


def expand_modules(adjacency: DataFrame, nodes: DataFrame) -> DataFrame:
    """(module, fqn): all nodes of the first file that a module pseudo-node names. adjacency (src, dst)."""
    outside = adjacency.select(F.col("dst").alias("module_path")).distinct().join(nodes.select(F.col("fqn").alias("module_path")), "module_path", "left_anti")
    first = nodes.groupBy("file_path").agg(F.min("seq").alias("seq"))
    found = first_wins(module_files(outside, first).join(first, "file_path"), ["module_path"], ["seq"])
    return found.select(F.col("module_path").alias("module"), "file_path").join(nodes.select("file_path", "fqn"), "file_path").select("module", "fqn")


def class_members(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, method) of one file where the method's qualified name holds the class. classes: file_path, class; methods: file_path, method, qualified_name."""
    inside = F.concat(F.lit(":"), F.col("qualified_name"))
    rows = classes.join(methods, "file_path")
    return rows.where(inside.contains(F.concat(F.lit(":"), F.col("class"), F.lit("."))) | inside.contains(F.concat(F.lit("."), F.col("class"), F.lit(".")))).select("file_path", "class", "method")


def resolve_entry_points(entry_points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds fqn: the node of that key or qualified name, else the first node of that short name."""
    exact = nodes.select(F.col("fqn").alias("node_name"), F.col("fqn").alias("a_")).union(nodes.select("qualified_name", "fqn"))
    exact = exact.groupBy("node_name").agg(F.min("a_").alias("a_"))
    by_name = nodes.groupBy(F.col("name").alias("short_")).agg(F.min_by("fqn", "seq").alias("b_"))
    rows = entry_points.withColumn("short_", F.substring_index("node_name", ":", -1)).join(exact, "node_name", "left").join(by_name, "short_", "left")
    return rows.withColumn("fqn", F.coalesce("a_", "b_")).drop("a_", "b_", "short_")


def resolve_keys(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends have an id (fqn, id), with source_id and target_id; the others go. Of a name's ids the least counts."""
    least = ids.groupBy("fqn").agg(F.min("id").alias("id"))
    one = least.select(F.col("fqn").alias("src"), F.col("id").alias("source_id"))
    two = least.select(F.col("fqn").alias("dst"), F.col("id").alias("target_id"))
    return edges.join(one, "src").join(two, "dst")


def token_match(items: DataFrame, features: DataFrame) -> DataFrame:
    """(item, feature_idx, shared): the feature that shares most tokens, at least one; then the first. items (item, tokens), features (feature_idx, tokens).

    Items, and features, of one set of tokens are compared once.
    """
    known = F.array_sort(F.array_distinct("tokens")).alias("set_")
    sets = items.select("item", known)
    left = sets.select("set_").distinct().select("set_", F.explode("set_").alias("token"))
    right = features.select("feature_idx", known).groupBy("set_").agg(F.min("feature_idx").alias("feature_idx")).select("feature_idx", F.explode("set_").alias("token"))
    shared = left.join(right, "token").groupBy("set_", "feature_idx").agg(F.count("*").alias("n_"))
    best = shared.groupBy("set_").agg(F.min(F.struct((-F.col("n_")).alias("n_"), "feature_idx")).alias("best"))
    return sets.join(best, "set_").select("item", F.col("best.feature_idx").alias("feature_idx"), (-F.col("best.n_")).alias("shared"))
