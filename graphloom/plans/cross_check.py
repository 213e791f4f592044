"""Features as a client sees them: names, splits that the graph allows, and features for code that has none.

Groups without entry points or nodes are asked about by their name alone; answers that can't be read count as none;
of several features of one name the last one (greatest feature) is meant. Null owners and names match nothing; repeated
rows count once; empty tables give empty results, and nobody is asked.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import dead_code, enrich, features, graph, resolve, serve
from graphloom.session import cut_lineage

#: Rounds at most, features a prompt names, and nodes of a feature that it shows.
ROUNDS, BATCH, SHOWN = 3, 10, 15


class Checked(NamedTuple):
    """changes (round, type, feature, from_feature, to_feature, reason), the rounds it took, and whether the last had none."""

    changes: DataFrame
    rounds: int
    converged: bool


def described(groups: DataFrame, entry_points: DataFrame, membership: DataFrame) -> DataFrame:
    """(feature, line): a line of text on every feature, its entry points and its first SHOWN nodes by name."""
    listed = entry_points.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("ep_seq", "node_name"))).alias("points"))  # one prompt names them all
    place = F.row_number().over(Window.partitionBy("feature").orderBy("node"))
    few = membership.select("feature", "node").distinct().withColumn("place_", place).where(F.col("place_") <= SHOWN)
    shown = few.groupBy("feature").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    rows = groups.join(listed, "feature", "left").join(shown, "feature", "left")
    points = F.coalesce(F.array_join(F.transform("points", lambda x: x["node_name"]), ", "), F.lit(""))
    return rows.select("feature", F.concat("name", F.lit(": starts at "), points, F.lit("; holds "), F.coalesce(F.array_join("nodes", ", "), F.lit(""))).alias("line"))


def batched_prompts(lines: DataFrame, size: int = BATCH, language: str = "en") -> DataFrame:
    """(id, prompt): one prompt for every `size` features, in their order; reads feature and line."""
    place = F.row_number().over(Window.orderBy("feature")) - 1  # features are few by nature
    rows = lines.withColumn("id", F.floor(place / size)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("feature", "line"))).alias("rows"))
    return rows.select("id", enrich.check_prompt(F.transform("rows", lambda x: x["line"]), language).alias("prompt"))


def proposed(answers: DataFrame, groups: DataFrame) -> DataFrame:
    """(type, feature, from_feature, to_feature, reason) of answers: a split per suggested name, else a review.

    answers: answer, an object with "features", of which those count whose "valid" is false.
    """
    said = F.explode(F.try_variant_get("answer", "$.features", "array<struct<name:string,valid:boolean,reason:string,suggested_split:array<string>>>"))
    wrong = answers.select(said.alias("f")).where("not f.valid")
    parts = F.when(F.size("f.suggested_split") > 0, F.col("f.suggested_split"))
    rows = wrong.select(F.coalesce("f.name", F.lit("")).alias("from_feature"), F.coalesce("f.reason", F.lit("")).alias("reason"), F.explode_outer(parts).alias("to_feature"), parts.isNotNull().alias("split_"))
    known = groups.groupBy(F.col("name").alias("from_feature")).agg(F.max("feature").alias("feature"))
    kind = F.when(F.col("split_"), "split").otherwise("review")
    return rows.join(known, "from_feature", "left").select(kind.alias("type"), "feature", "from_feature", F.coalesce("to_feature", F.lit("")).alias("to_feature"), "reason")


def start_reach(entry_points: DataFrame, links: DataFrame) -> DataFrame:
    """(start, node): what the first two entry points of every feature that are nodes reach."""
    place = F.row_number().over(Window.partitionBy("feature").orderBy("ep_seq"))
    first = entry_points.where("start is not null").withColumn("place_", place).where("place_ <= 2")
    return graph.reachable(first.select("start", F.col("start").alias("node")), links, by=("start",))


def cross_check(groups: DataFrame, entry_points: DataFrame, membership: DataFrame, links: DataFrame, client: enrich.Client, rounds: int = ROUNDS, size: int = BATCH, language: str = "en") -> Checked:
    """Asks a client round by round which features don't belong together, until it proposes nothing that the graph allows.

    groups: feature (int), name; entry_points: feature, ep_seq, node_name and start (its node or null); membership:
    feature, node; links: src, dst. Splits count if features.valid_splits lets them pass, reviews always. The features
    themselves stay as they are. A batch whose answer can't be read proposes nothing.
    """
    spark = groups.sparkSession
    changes = spark.createDataFrame([], "round int, type string, feature int, from_feature string, to_feature string, reason string")
    if groups.isEmpty():
        return Checked(changes, 1, True)
    prompts = cut_lineage(batched_prompts(described(groups, entry_points, membership), size, language))
    reached = None
    for number in range(1, rounds + 1):
        found = cut_lineage(proposed(enrich.ask_json(prompts, client), groups))
        if reached is None and not found.where("type = 'split'").isEmpty():
            reached = cut_lineage(start_reach(entry_points, links))
        passed = found if reached is None else cut_lineage(features.valid_splits(found, entry_points, reached))
        if passed.isEmpty():
            return Checked(changes, number, True)
        changes = cut_lineage(changes.unionByName(passed.select(F.lit(number).alias("round"), F.col("type"), F.col("feature").cast("int"), "from_feature", "to_feature", "reason")))
    return Checked(changes, rounds, False)


def renamed(named: DataFrame, entry_points: DataFrame, client: enrich.Client, language: str = "en") -> DataFrame:
    """Clusters (cluster_idx, name, description, ...) with the names and descriptions that a client gives them.

    entry_points: cluster_idx, ep_seq, node_name, route_info (map). A cluster whose answer has no name keeps its own.
    """
    route = F.concat_ws(" ", F.col("route_info")["method"], F.col("route_info")["url"])
    line = F.concat("node_name", F.when(route != "", F.concat(F.lit(" at "), route)).otherwise(""))
    rows = entry_points.select("cluster_idx", F.struct("ep_seq", line.alias("line")).alias("point")).groupBy("cluster_idx").agg(F.array_sort(F.collect_list("point")).alias("points"))
    asked = enrich.ask_json(rows.select("cluster_idx", enrich.name_prompt(F.transform("points", lambda x: x["line"]), language).alias("prompt")), client, key="cluster_idx")
    said = asked.select("cluster_idx", F.nullif(F.try_variant_get("answer", "$.name", "string"), F.lit("")).alias("said_"), F.try_variant_get("answer", "$.description", "string").alias("told_"))
    told = F.when(F.col("said_").isNotNull(), F.coalesce("told_", "description")).otherwise(F.col("description"))
    return named.join(said, "cluster_idx", "left").withColumn("description", told).withColumn("name", F.coalesce("said_", "name")).drop("said_", "told_")


def owner_features(owners: DataFrame, groups: DataFrame, names: DataFrame) -> DataFrame:
    """(owner, feature): the first feature of an owner's name, letters' case and blanks apart, else the owner itself if a node's name holds it.

    owners: owner; groups: feature, name; names: node.
    """
    wanted = owners.where("owner is not null and owner <> ''").select("owner").distinct()
    known = groups.groupBy(F.lower("name").alias("key_")).agg(F.min_by("name", "feature").alias("feature"))
    direct = wanted.withColumn("key_", fn.owner_key(F.col("owner"))).join(known, "key_").select("owner", "feature")
    rest = wanted.join(direct, "owner", "left_anti")
    held = dead_code.holders(rest.withColumn("text", F.col("owner")), names.select(F.col("node").alias("name")).distinct())
    return direct.unionByName(held.select("owner").distinct().withColumn("feature", F.col("owner")))


def path_tokens(path: Column) -> Column:
    """Parts of a path, without the endings of source files."""
    bare = F.replace(path, F.lit("\\"), F.lit("/"))
    for ending in (".py", ".ts", ".js"):
        bare = F.replace(bare, F.lit(ending), F.lit(""))
    return F.split(bare, "/")


def place_features(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, feature): the feature whose name shares most parts with the node's path, at least one; then the first.

    nodes: node, file_path; groups: feature, name, whose parts are between underscores.
    """
    found = resolve.token_match(nodes.select(F.col("node").alias("item"), path_tokens(F.col("file_path")).alias("tokens")), groups.select(F.col("feature").alias("feature_idx"), F.split("name", "_").alias("tokens")))
    return found.join(groups.select(F.col("feature").alias("feature_idx"), F.col("name").alias("feature")), "feature_idx").select(F.col("item").alias("node"), "feature")


def suggest(nodes: DataFrame, unmatched: DataFrame, groups: DataFrame, client: enrich.Client, answers: str | None = None, language: str = "en") -> DataFrame:
    """(node, suggested_feature, classification, reason, confidence) for nodes without a feature, as a client sees them.

    nodes: node, name, file_path, source_code, seq; unmatched: node; groups: feature, name. Nodes whose answer can't be
    read give no row; answers names a folder that keeps them (see enrich.ask).
    """
    wanted = unmatched.select("node").where("node is not null").distinct()
    rows = cut_lineage(serve.neighbours(nodes.select("node", "name", "file_path", "source_code", "seq")).join(wanted, "node", "left_semi"))
    prompt = enrich.verdict_prompt(F.col("name"), F.lit("no feature reaches it"), F.coalesce("source_code", F.lit("")), F.col("context"), language)
    asked = enrich.ask_json(rows.select(F.col("node").alias("id"), prompt.alias("prompt")), client, answers=answers)
    text = lambda name: F.try_variant_get("answer", f"$.{name}", "string").alias(name)
    said = cut_lineage(asked.where("answer is not null").select(F.col("id").alias("node"), text("classification"), text("reason"), text("suggested_owner")).withColumnRenamed("suggested_owner", "owner"))
    places = place_features(rows.join(said.select("node"), "node", "left_semi"), groups)
    return enrich.suggestions(said, owner_features(said.select("owner"), groups, nodes), places)
