"""Read views: snapshots, graph payloads, feature lists, flows, dead-code lists.

Null keys match nothing, repeated rows are shown as often as they are stored, ties are ordered by id, and empty
tables give empty views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The latest row of each key, of those that `where` selects."""
    rows = rows if where is None else rows.where(where)
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("best")
    return rows.groupBy(*[F.col(k).alias(f"{k}_key") for k in key]).agg(best).select("best.*")


def latest_completed(snapshots: DataFrame) -> DataFrame:
    """The newest completed snapshot of each repository."""
    return latest(snapshots, ["repo_id"], ["analyzed_at", "id"], F.col("status") == "completed")


def count_in_latest(nodes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo_id, feature_id, node_count): nodes with a feature in each repository's newest completed snapshot."""
    newest = latest_completed(snapshots).select("repo_id", F.col("id").alias("snapshot_id"))
    return nodes.where("feature_id is not null").join(newest, "snapshot_id").groupBy("repo_id", "feature_id").agg(F.count("*").alias("node_count"))


def feature_count(nodes: DataFrame, feature_id: str) -> DataFrame:
    """node_count of one feature, in one row."""
    return nodes.where(F.col("feature_id") == feature_id).agg(F.count("*").alias("node_count"))


def by_id(rows: DataFrame, ident: str, key: str = "id") -> DataFrame:
    """The row of an id; none for a null one."""
    return rows.where(F.col(key) == ident)


def graph_view(repo_id: str, snapshots: DataFrame, nodes: DataFrame, edges: DataFrame, features: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and features of a repository's newest completed snapshot as the view shows them; empty without one."""
    newest = F.broadcast(latest_completed(snapshots.where(F.col("repo_id") == repo_id)).select(F.col("id").alias("snapshot_id")))
    own = features.where(F.col("repo_id") == repo_id).join(F.broadcast(newest.limit(1).select(F.lit(1).alias("one_"))), F.lit(True)).drop("one_")
    here = nodes.join(newest, "snapshot_id", "left_semi")
    return {"nodes": graph_nodes(here, own), "edges": graph_edges(edges.join(newest, "snapshot_id", "left_semi")), "features": feature_list(own, here)}


def graph_nodes(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """Nodes as the view shows them: view type, origin position, feature name and colour where there is one."""
    kind = F.when(F.col("node_type").isin("class", "method", "module"), F.concat("node_type", F.lit("Node"))).otherwise("functionNode")
    named = features.select(F.col("id").alias("feature_id"), F.col("name").alias("feature_name"), F.col("color").alias("feature_color"))
    return nodes.join(named, "feature_id", "left").withColumn("view_type", kind).withColumn("position", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def graph_edges(edges: DataFrame, flow: bool = False) -> DataFrame:
    """Adds animated: calls and instantiations move, in a flow calls only."""
    return edges.withColumn("animated", F.col("edge_type").isin("calls") if flow else F.col("edge_type").isin("calls", "instantiates"))


def feature_list(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Features by name with their node counts, 0 for none."""
    count = nodes.where("feature_id is not null").groupBy("feature_id").agg(F.count("*").alias("node_count"))
    rows = features.join(count, features["id"] == count["feature_id"], "left").drop("feature_id")
    return rows.withColumn("node_count", F.coalesce("node_count", F.lit(0))).orderBy("name", "id")


def visible(nodes: DataFrame, active: list[str]) -> DataFrame:
    """Nodes without a feature or of an active one."""
    return nodes.where(F.col("feature_id").isNull() | F.col("feature_id").isin(*active))


def flow(nodes: DataFrame, edges: DataFrame, feature_id: str) -> DataFrame:
    """Steps of a feature in order (those without one last), each with the targets of its edges inside the feature."""
    steps = nodes.where(F.col("feature_id") == feature_id)
    ids = steps.select(F.col("id").alias("n_"))
    inside = edges.join(ids, edges["source_node_id"] == ids["n_"], "left_semi").join(ids, edges["target_node_id"] == ids["n_"], "left_semi")
    calls = inside.groupBy(F.col("source_node_id").alias("id")).agg(F.array_sort(F.collect_set("target_node_id")).alias("calls_next"))
    out = steps.join(calls, "id", "left")
    empty = F.array().cast("array<string>")
    return out.select("id", "name", F.coalesce("flow_order", F.lit(0)).alias("order"), F.coalesce("flow_description", "description", F.lit("")).alias("description"), F.coalesce("calls_next", empty).alias("calls_next"), F.col("flow_order").alias("at_")).orderBy(F.asc_nulls_last("at_"), "id").drop("at_")


def sequential_edges(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, source, target): steps without an edge of their own lead to the next of their feature's list."""
    following = F.lead("node").over(Window.partitionBy("feature").orderBy("list_pos"))
    rows = steps.withColumn("target", following).where("target is not null")
    return rows.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("feature", F.col("node").alias("source"), "target")


def neighbours(nodes: DataFrame, key: str = "file_path", limit: int = 10) -> DataFrame:
    """Adds context: the first `limit` other names of the same file, in order; reads name and seq.

    A file's first limit + 1 names hold those of every member, so no file is joined with itself.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    first = nodes.withColumn("p_", place).where(F.col("p_") <= limit + 1).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("first_"))
    rows = nodes.join(first, key, "left")
    others = F.slice(F.filter("first_", lambda x: x["seq"] != F.col("seq")), 1, limit)
    return rows.withColumn("context", F.transform(others, lambda x: x["name"])).drop("first_")


def dead_list(nodes: DataFrame) -> DataFrame:
    """Dead nodes by file and line, with what their metadata (JSON) says or defaults."""
    meta = F.try_parse_json("metadata")

    def field(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.try_variant_get(meta, f"$.{name}", kind), default).alias(name)

    none = F.lit(None).cast("string")
    shown = nodes.where("is_dead_code").select("id", "file_path", "name", "node_type", "line_start", "line_end", field("reason", "string", F.lit("No references found")), field("confidence", "double", F.lit(0.5)), field("llm_explanation", "string", none), field("suggested_feature", "string", none))
    return shown.orderBy("file_path", "line_start", "id")


def update_feature(features: DataFrame, changes: DataFrame) -> DataFrame:
    """Features with the non-null fields of changes (id and any columns of features)."""
    fields = [c for c in changes.columns if c != "id"]
    rows = features.join(changes.select("id", *[F.col(c).alias(f"{c}__new") for c in fields]), "id", "left")
    return rows.select(*[F.coalesce(f"{c}__new", c).alias(c) if c in fields else F.col(c) for c in features.columns])


def new_repository(spark, url: str | None, local_path: str, created_at, branch: str = "main") -> DataFrame:
    """One row for the repositories table; its id is a hash of where it is, known before it is written."""
    row = spark.createDataFrame([(url, local_path, branch, created_at)], "url string, local_path string, branch string, created_at timestamp")
    none = F.lit(None)
    ident = F.sha2(F.concat_ws("::", F.coalesce("url", "local_path"), "branch"), 256)
    return row.select(ident.alias("id"), "url", "local_path", "branch", none.cast("string").alias("last_commit_sha"), none.cast("timestamp").alias("last_analyzed_at"), "created_at")


def repository(repositories: DataFrame, repo_id: str) -> DataFrame:
    """The repository of an id; no row if there is none."""
    return by_id(repositories, repo_id)


def new_snapshot(spark, repo_id: str, commit_sha: str, created_at) -> DataFrame:
    """One pending row for the analysis_snapshots table."""
    row = spark.createDataFrame([(repo_id, commit_sha, "pending", created_at)], "repo_id string, commit_sha string, status string, created_at timestamp")
    none = F.lit(None)
    ident = F.sha2(F.concat_ws("::", "repo_id", "commit_sha", F.col("created_at").cast("string")), 256)
    return row.select(ident.alias("id"), "repo_id", "commit_sha", "status", none.cast("timestamp").alias("analyzed_at"), none.cast("string").alias("stats"), "created_at")


def repository_list(repositories: DataFrame) -> DataFrame:
    """Newest first."""
    return repositories.orderBy(F.desc("created_at"), "id")


def delete_repository(tables: dict[str, DataFrame], repo_id: str) -> dict[str, DataFrame]:
    """The five tables without a repository and all that hangs on it."""
    gone = tables["analysis_snapshots"].where(F.col("repo_id") == repo_id).select(F.col("id").alias("snapshot_id"))
    out = {"repositories": tables["repositories"].where(F.col("id") != repo_id)}
    out |= {t: tables[t].where(F.col("repo_id") != repo_id) for t in ("analysis_snapshots", "features")}
    return out | {t: tables[t].join(gone, "snapshot_id", "left_anti") for t in ("code_nodes", "code_edges")}


def border_color(is_dead: Column, is_entry: Column, feature_color: Column) -> Column:
    """Dead nodes first, then entry points, then the feature's colour, then grey."""
    return F.when(is_dead, "#ef4444").when(is_entry, "#22c55e").otherwise(F.coalesce(feature_color, F.lit("#6b7280")))


def edge_style(edge_type: Column, inferred: Column) -> Column:
    return F.struct(F.when(edge_type == "calls", 1.5).otherwise(1.0).alias("width"), inferred.alias("dashed"))
