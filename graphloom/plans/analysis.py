"""The analysis of a repository: parse, discover, match, find dead code, verify; each stage one plan."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import dead_code, diff, enrich, features, graph, resolve
from graphloom.plans import cross_check
from graphloom.session import cut_lineage, written
from graphloom.sources import files as file_source
from graphloom.sources import parse as parsing
from graphloom.sources import snapshots

#: Rounds of verification at most.
ROUNDS = 3


@dataclass
class Analysis:
    """Tables of an analysis."""

    parsed: DataFrame
    nodes: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    clusters: DataFrame
    tagged: DataFrame
    buckets: DataFrame
    features: DataFrame
    assigned: DataFrame
    dead: DataFrame
    # what the next analysis starts from; only whole analyses have them
    manifest: DataFrame | None = None
    links: DataFrame | None = None
    starts: DataFrame | None = None
    reached: DataFrame | None = None


@dataclass
class Previous:
    """What an earlier analysis of a repository left."""

    manifest: DataFrame
    parsed: DataFrame
    links: DataFrame
    starts: DataFrame
    reached: DataFrame


def previous(spark: SparkSession, folder: str, repo_id: str) -> Previous | None:
    """The newest committed snapshot of a repository, if it was analysed to the end."""
    last = snapshots.latest(spark, folder, repo_id)
    if last is None:
        return None
    held = [snapshots.load(spark, folder, name, last).drop("snapshot_id") for name in ("manifests", "parsed", "links", "starts", "reached")]
    return None if held[0].isEmpty() else Previous(*held)


def reparsed(sources: DataFrame, manifest: DataFrame, before: Previous) -> DataFrame:
    """All files parsed, of which only new and changed ones are parsed now."""
    fresh = diff.needs_analysis(manifest, before.manifest).select("path")
    same = manifest.select("path").join(fresh, "path", "left_anti")
    again = parsing.parse(sources.join(fresh, "path", "left_semi"))
    return before.parsed.join(same, "path", "left_semi").unionByName(again)


def call_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, contained, entry points) with resolved names.

    Edges whose target is neither a node nor a module of the repository stay listed with dst null. An import
    leads to its module and, if it names some, to the nodes of these names. src is a node: a module stands for
    its first one; `source` keeps what the file says. contained leads from modules to the nodes of their file and
    from classes to their methods. Nodes and entry points of one name: the first one counts.
    """
    # sizes of written files, compressed and columnar, say little of the rows: such tables are merged, never broadcast
    parsed = parsed.hint("merge")
    nodes = parsing.nodes(parsed).withColumn("seq", F.struct("file_path", "node_seq"))
    # a method's key is its qualified name; fqn stays a lookup column
    nodes = nodes.withColumn("node", F.col("qualified_name"))
    nodes = cut_lineage(resolve.first_wins(nodes, ["node"], ["seq"]))
    keyed = nodes.hint("merge")
    lookup = keyed.select(F.col("node").alias("fqn"), "qualified_name", "name", "file_path", "seq")
    raw = parsing.edges(parsed).withColumn("edge_id", F.concat_ws("#", "file_path", F.col("edge_seq").cast("string")))
    found = resolve.resolve_targets(raw.select("edge_id", "source", "target", "edge_type", "line_number"), lookup)
    calls = found.select("source", F.col("resolved").alias("dst"), "target", "edge_type", "line_number")

    imported = parsing.imports(parsed).withColumn("import_id", F.concat_ws("#", "file_path", F.col("import_seq").cast("string")))
    inside = parsing.import_files(imported, parsed.select("path")).select("file_path", "import_seq", fn.module_name(F.col("target")).alias("module"), "names")
    one = F.concat_ws("#", "import_id", "module").alias("import_id")  # an import may name several modules
    inside = imported.join(inside, ["file_path", "import_seq"]).select(one, fn.module_name(F.col("file_path")).alias("source"), "module", F.col("names").alias("imported_names"), "line_number")
    inside = cut_lineage(inside).hint("merge")
    symbols = resolve.resolve_imports(inside.where(F.size("imported_names") > 0).select("import_id", F.col("module").alias("module_path"), "imported_names"), lookup)
    kind = F.lit("imports").alias("edge_type")
    to_symbols = inside.join(symbols, "import_id").select("source", F.col("fqn").alias("dst"), F.col("symbol").alias("target"), kind, "line_number")
    hit = symbols.select("import_id", F.lit(True).alias("hit")).distinct()
    module = F.when((F.size("imported_names") == 0) | F.col("hit"), F.col("module"))
    to_modules = inside.join(hit, "import_id", "left").select("source", module.alias("dst"), F.col("module").alias("target"), kind, "line_number")
    edges = cut_lineage(resolve.resolve_sources(calls.unionByName(to_symbols).unionByName(to_modules), lookup).withColumnRenamed("source_fqn", "src"))

    modules = resolve.expand_modules(edges.hint("merge").where("dst is not null"), lookup).select(F.col("module").alias("src"), F.col("fqn").alias("dst"))
    classes = keyed.where("node_type = 'class'").select("file_path", F.col("name").alias("class"), F.col("node").alias("src"))
    methods = keyed.where("node_type = 'method'").select("file_path", F.col("node").alias("method"), "qualified_name")
    owned = resolve.class_members(classes.select("file_path", "class").distinct(), methods)
    contained = modules.union(classes.join(owned, ["file_path", "class"]).select("src", F.col("method").alias("dst"))).withColumn("edge_type", F.lit("contains"))
    entries = resolve.first_wins(parsing.entry_points(parsed), ["node_name"], ["file_path", "ep_seq"])
    entries = resolve.resolve_entry_points(entries, lookup).withColumn("ep_seq", F.struct("file_path", "ep_seq"))
    return nodes, edges, contained, entries


def analyze_sources(sources: DataFrame, progress: Callable[[str, float], None] | None = None, partial: Callable[[Analysis], None] | None = None, before: Previous | None = None, client: enrich.Client | None = None) -> Analysis:
    """Runs all stages over (path, content). A progress callback that fails is logged and changes nothing.

    With `before`, files whose content it knows under their path aren't parsed again, and what entry points reach is
    changed where edges have come or gone; the result is that of a full run. With a client, clusters are named, features verified and
    split (verify_grouping). Features without nodes and entry points are left out. partial gets the call graph, with empty features, as soon as it is there, for those who keep it if a later stage fails.
    """

    def tell(stage: str, share: float) -> None:
        if progress is not None:
            try:
                progress(stage, share)
            except Exception:  # whoever listens must not end the run
                logging.getLogger(__name__).warning("progress callback failed at %s", stage, exc_info=True)

    tell("code_parsing", 0.0)
    manifest = written(file_source.manifest(sources), "manifest")
    parsed = written(parsing.parse(sources) if before is None else reparsed(sources, manifest, before), "parsed")
    nodes, edges, contained, entries = call_graph(parsed)
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    if partial is not None:
        spark = nodes.sparkSession
        none = {"clusters": "cluster_idx int", "tagged": "cluster int, node string", "buckets": "node string, bucket string", "features": "idx int, unique_name string, color string", "assigned": "node string, feature int", "dead": "node string, reason string, confidence double"}
        partial(Analysis(parsed, nodes, edges, entries, **{k: spark.createDataFrame([], v) for k, v in none.items()}))
    tell("feature_discovery", 25.0)
    clusters = cut_lineage(features.cluster_entry_points(entries))
    # a main block starts at what its module calls and imports
    main = clusters.where("entry_type = 'main'").select("cluster_name", F.substring_index("node_name", ":", 1).alias("source"))
    seeds = main.join(edges, "source").select("cluster_name", F.col("dst").alias("node"))
    starts = clusters.select("cluster_name", F.col("fqn").alias("node")).union(seeds).where("node is not null").withColumnRenamed("cluster_name", "cluster")
    starts = cut_lineage(starts.join(nodes.select("node"), "node", "left_semi").select("cluster", "node").distinct())
    links = edges.where("src is not null and dst is not null").select("src", "dst", "edge_type").union(contained.select("src", "dst", "edge_type")).distinct()
    links = written(links, "links")
    # clusters go by their names here, which stay the same from run to run
    reached = graph.reachable(starts, links, by=("cluster",)) if before is None else graph.maintained(before.reached, before.links, links, before.starts, starts)
    reached = cut_lineage(reached)
    numbers = clusters.select("cluster_name", F.col("cluster_idx").alias("number")).distinct()
    tagged = reached.join(nodes.select("node").distinct(), "node", "left_semi").join(numbers, F.col("cluster") == F.col("cluster_name"))
    tagged = cut_lineage(tagged.select(F.col("number").alias("cluster"), "node"))
    kinds = features.buckets(nodes, tagged)
    tell("feature_matching", 50.0)
    named = features.name_clusters(clusters)
    named = named if client is None else cross_check.renamed(named, clusters, client)
    named = named.withColumn("color", fn.color(F.col("cluster_idx")))
    keys = clusters.groupBy("cluster_idx").agg(F.min("cluster_key").alias("qualifier"))
    listed = features.qualify_names(named.join(keys, "cluster_idx").withColumnRenamed("cluster_idx", "idx"))
    points, members = clusters.withColumnRenamed("cluster_idx", "feature"), tagged.select(F.col("cluster").alias("feature"), "node")
    if client is not None:
        groups = listed.select(F.col("idx").alias("feature"), F.col("unique_name").alias("name"))
        starting = points.select("feature", "ep_seq", "node_name", F.col("fqn").alias("start"))
        groups, points, members, _ = verify_grouping(groups, starting, members, links, client)
        told = listed.select(F.col("unique_name").alias("name"), "description").distinct()
        listed = groups.join(told, "name", "left").withColumn("color", fn.color(F.col("feature"))).withColumn("unique_name", F.col("name")).withColumnRenamed("feature", "idx")
    listed = features.drop_empty(listed.withColumnRenamed("idx", "feature"), members, points).withColumnRenamed("feature", "idx")
    counts = points.groupBy("feature").agg(F.count("*").alias("entries"))
    if client is None:
        assigned = features.assign_exclusive(members, counts)
    else:  # parts of a split list what they kept, and own what they reach beside it
        begun = points.where("start is not null").select("feature", F.col("start").alias("node"))
        assigned = features.assign_exclusive(graph.reachable(begun, links, by=("feature",), nodes=nodes.select("node")), counts, members)
    tell("unmatched_analysis", 75.0)
    dead = dead_code.detect(nodes.select("node", "node_type", "file_path", "line_start", "line_end"), links, tagged.select("node").distinct(), kinds.where("bucket <> 'unmatched'"))
    tell("done", 100.0)
    return Analysis(parsed, nodes, edges, entries, clusters, tagged, kinds, listed, assigned, dead, manifest, links, starts, reached)


def analyze(spark: SparkSession, root: str, progress: Callable[[str, float], None] | None = None) -> Analysis:
    """Analyses the files under a root."""
    return analyze_sources(file_source.sources(spark, root), progress)


def verify(nodes: DataFrame, edges: DataFrame, client: enrich.Client, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """Edges with those that a client infers, and the rounds it took until none was new."""
    for number in range(1, rounds + 1):
        known = edges.select("src", "dst", "edge_type")
        asked = enrich.describable(nodes).where(fn.has_dynamic_hint(F.col("source_code")))
        names = nodes.select("name").distinct().orderBy("name").limit(100).agg(F.array_sort(F.collect_list("name")).alias("known"))
        prompts = asked.join(F.broadcast(names)).select(F.col("node").alias("id"), enrich.calls_prompt(F.col("name"), F.col("source_code"), F.col("known")).alias("prompt"))
        found = enrich.inferred_edges(enrich.ask_json(prompts, client))
        hit = found.join(nodes.select(F.col("name").alias("target"), F.col("node").alias("dst")), "target").select(F.col("source").alias("src"), "dst", "edge_type")
        new = cut_lineage(graph.novel(hit, known))
        if new.isEmpty():
            return edges, number
        edges = cut_lineage(known.unionByName(new))
    return edges, rounds


def verify_grouping(groups: DataFrame, entry_points: DataFrame, membership: DataFrame, links: DataFrame, client: enrich.Client | None = None, rounds: int = ROUNDS, language: str = "en") -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(features, entry points, membership, rounds) after splits that a client suggests, until nothing is wrong.

    groups: feature (int), name; entry_points: feature, ep_seq, node_name and start (its node or null); membership:
    feature, node; links: src, dst. In every round features are checked by their structure and by the client, which
    answers {"features": [{"name", "valid", "suggested_split"}]}. An invalid feature's entry points are dealt to the
    suggested names, whose members are what they reach of the old ones; without entry points a part doesn't exist.
    Structural issues alone change nothing, so the rounds go on until the last. Ids of features are given anew.
    """
    for number in range(1, rounds + 1):
        starts = entry_points.where("start is not null").select(F.col("feature").alias("cluster"), F.col("start").alias("node"))
        reached = graph.reachable(starts, links, by=("cluster",)).withColumnRenamed("cluster", "feature")
        counts = entry_points.groupBy("feature").agg(F.count("*").alias("entries"))
        sound = features.structure(groups, membership, counts, reached).where("issue is not null").isEmpty()
        splits = None
        if client is not None:
            listed = entry_points.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("ep_seq", "node_name"))).alias("points"))  # one prompt names them all
            line = F.concat("name", F.lit(": "), F.array_join(F.transform("points", lambda x: x["node_name"]), ", "))
            lines = groups.join(listed, "feature", "left").select("feature", F.coalesce(line, F.col("name")).alias("line"))
            names = F.transform(F.array_sort(F.collect_list(F.struct("feature", "line"))), lambda x: x["line"])
            asked = enrich.ask_json(lines.agg(names.alias("names")).select(F.lit(1).alias("id"), enrich.grouping_prompt(F.col("names"), language).alias("prompt")), client)
            said = F.explode(F.try_variant_get("answer", "$.features", "array<struct<name:string,valid:boolean,suggested_split:array<string>>>"))
            wrong = cut_lineage(asked.select(said.alias("f")).where("not f.valid").select("f.name", F.col("f.suggested_split").alias("names")))
            sound = sound and wrong.isEmpty()
            splits = cut_lineage(groups.join(resolve.first_wins(wrong.where(F.size("names") > 0).withColumnRenamed("name", "name_"), ["name_"], ["names"]), F.col("name") == F.col("name_")).select("feature", "names"))
        if sound:
            return groups, entry_points, membership, number
        if splits is None or splits.isEmpty():
            continue
        parted = cut_lineage(features.split_features(entry_points, splits))
        order = parted.select("feature", "part", "name").distinct().unionByName(groups.join(splits, "feature", "left_anti").select("feature", F.lit(0).alias("part"), "name"))
        order = cut_lineage(order.withColumn("new", F.row_number().over(Window.orderBy("feature", "part")) - 1))  # features are few by nature
        old = order.join(splits, "feature", "left_anti").select("feature", "new")
        within = parted.join(order.drop("name"), ["feature", "part"])
        again = graph.reachable(within.where("start is not null").select(F.col("new").alias("cluster"), F.col("start").alias("node")), links, by=("cluster",))
        again = again.withColumnRenamed("cluster", "new").join(order.select("feature", "new"), "new").join(membership, ["feature", "node"], "left_semi").select("new", "node")
        membership = cut_lineage(membership.join(old, "feature").select("new", "node").unionByName(again).distinct().withColumnRenamed("new", "feature"))
        kept = entry_points.join(old, "feature").unionByName(within.drop("part", "name")).drop("feature").withColumnRenamed("new", "feature")
        entry_points = cut_lineage(kept)
        groups = cut_lineage(order.select(F.col("new").alias("feature"), "name"))
    return groups, entry_points, membership, rounds


def statistics(a: Analysis) -> DataFrame:
    """(name, value): sizes of an analysis."""
    sizes = {"files": a.parsed, "nodes": a.nodes, "edges": a.edges, "features": a.features, "dead_code": a.dead}
    out = None
    for name, rows in sizes.items():
        one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def persist(a: Analysis, folder: str, repo_id: str, snapshot_id: str) -> None:
    """Commits a snapshot: its nodes, edges and features, and of a whole analysis what the next one starts from.

    Ids are hashes of snapshot and name, and the commit replaces an earlier one of the snapshot for all readers, so a
    second run gives the same rows once; a run that dies before its end leaves none (see sources.snapshots).
    """

    def ident(c: str):
        return F.sha2(F.concat_ws("::", F.lit(snapshot_id), F.col(c)), 256)

    owner = a.assigned.select("node", F.sha2(F.concat_ws("::", F.lit(repo_id), F.col("feature").cast("string")), 256).alias("feature_id"))
    rows = a.nodes.drop("seq").join(owner, "node", "left").join(a.dead.select("node", F.lit(True).alias("is_dead"), "reason", "confidence"), "node", "left")
    entry = a.entry_points.select(F.col("fqn").alias("node"), F.lit(True).alias("is_entry")).where("node is not null").distinct()
    rows = rows.join(entry, "node", "left").withColumn("id", ident("node")).withColumn("snapshot_id", F.lit(snapshot_id))
    meta = F.to_json(F.struct("reason", "confidence"))
    kept = rows.select("id", "snapshot_id", "file_path", "node_type", "name", "language", "line_start", "line_end", "source_code", "docstring", meta.alias("metadata"), "feature_id", F.coalesce("is_entry", F.lit(False)).alias("is_entry_point"), F.coalesce("is_dead", F.lit(False)).alias("is_dead_code"))
    ids = a.nodes.select(F.col("node").alias("fqn"), ident("node").alias("id"))
    edges = resolve.resolve_keys(a.edges, ids).select(F.sha2(F.concat_ws("::", "source_id", "target_id", "edge_type"), 256).alias("id"), F.lit(snapshot_id).alias("snapshot_id"), F.col("source_id").alias("source_node_id"), F.col("target_id").alias("target_node_id"), "edge_type", "line_number")
    named = a.features.select(F.sha2(F.concat_ws("::", F.lit(repo_id), F.col("idx").cast("string")), 256).alias("id"), F.lit(repo_id).alias("repo_id"), F.col("unique_name").alias("name"), "color")
    with snapshots.Run(a.nodes.sparkSession, folder, repo_id, snapshot_id) as out:
        for name, table in (("code_nodes", kept), ("code_edges", edges), ("features", named)):
            out.save(table, name)
        if a.manifest is not None:
            for name, table in (("manifests", a.manifest), ("parsed", a.parsed), ("links", a.links.select("src", "dst").distinct()), ("starts", a.starts), ("reached", a.reached)):
                out.save(table, name)
