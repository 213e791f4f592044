"""Dead-code candidates: rules with confidence, adjusted by a reviewer's verdict.

Rows with a null node are no candidates, edges with a null end are no references; repeated rows count once, ties are
ordered by node; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import references

#: Confidence of each reason, in the order in which the rules are tried.
REASONS = {"no_references": 0.95, "self_referential": 0.9, "unreachable": 0.8, "imported_not_called": 0.7}
#: Least confidence of a candidate that is reported.
THRESHOLD = 0.5


def candidates(nodes: DataFrame, edges: DataFrame, reached: DataFrame, owned: DataFrame) -> DataFrame:
    """(node, reason, confidence) of nodes that no feature owns and a rule calls dead; the first rule counts.

    nodes may have node_type: modules are left out. reached and owned hold a column node.
    """
    rows = nodes.where(F.coalesce(F.col("node_type"), F.lit("")) != "module").drop("node_type") if "node_type" in nodes.columns else nodes
    rows = rows.join(owned.select("node").distinct(), "node", "left_anti")
    facts = rows.join(references(edges), "node", "left").join(reached.select("node", F.lit(True).alias("alive")).distinct(), "node", "left")
    reason = (
        F.when(F.col("referenced").isNull(), "no_references")
        .when(F.col("only_self"), "self_referential")
        .when(F.col("alive").isNull(), "unreachable")
        .when(F.col("imported") & ~F.col("called"), "imported_not_called")
    )
    sure = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return facts.withColumn("reason", reason).where("reason is not null").withColumn("confidence", F.element_at(sure, F.col("reason"))).drop("referenced", "only_self", "imported", "called", "alive")


def agent_candidates(functions: DataFrame, steps: DataFrame) -> DataFrame:
    """Functions (file, name, ...) that are no step (file, function) of any feature; names with two underscores at
    either end are called by the language and left out. Null names and files are no steps and are kept as they are.
    """
    used = steps.select("file", F.col("function").alias("name")).distinct()
    special = F.coalesce(F.col("name").startswith("__") & F.col("name").endswith("__"), F.lit(False))
    return functions.where(~special).join(used, ["file", "name"], "left_anti")


def adjusted(confidence: Column, verdict: Column) -> Column:
    """Confidence after a reviewer's verdict."""
    return (
        F.when(verdict == "dead_code", F.least(confidence + 0.05, F.lit(1.0)))
        .when(verdict.isin("module_init", "global_config", "constant", "type_definition"), F.greatest(confidence - 0.3, F.lit(0.1)))
        .when(verdict == "decorator", F.greatest(confidence - 0.4, F.lit(0.05)))
        .when(verdict == "generated", confidence * 0.7)
        .otherwise(confidence)
    )


def detect(nodes: DataFrame, edges: DataFrame, reached: DataFrame, owned: DataFrame, verdicts: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates from the threshold on, most certain first; verdicts (node, verdict) adjust them."""
    found = candidates(nodes, edges, reached, owned)
    if verdicts is not None:
        found = found.join(verdicts.select("node", "verdict"), "node", "left").withColumn("confidence", adjusted(F.col("confidence"), F.col("verdict")))
    return found.where(F.col("confidence") >= threshold).orderBy(F.desc("confidence"), "node")


#: Length of the pieces by which an owner is looked up inside names.
PIECE = 3


def holders(owners: DataFrame, names: DataFrame) -> DataFrame:
    """(owner, columns of names): every name that holds an owner's text. owners: owner, text; names: name and any others.

    Containment becomes an equality on the piece of PIECE characters (the whole text if it is shorter) that fewest
    names hold, before it is tested. Null and empty texts are held by nothing.
    """

    def pieces(text: Column, n: Column | int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n) if isinstance(n, int) else n))

    cuts = F.flatten(F.array(*(pieces(F.col("name"), n) for n in range(1, PIECE + 1))))
    right = names.where("name <> ''").withColumn("piece", F.explode(F.array_distinct(cuts)))
    held = right.groupBy("piece").agg(F.count("*").alias("n_"))
    left = owners.where("text <> ''").select("owner", "text", F.explode(F.array_distinct(pieces(F.col("text"), F.least(F.length("text"), F.lit(PIECE))))).alias("piece"))
    # an owner with a piece that no name holds has no match either way
    left = left.join(held, "piece").groupBy("owner", "text").agg(F.min_by("piece", F.struct("n_", "piece")).alias("piece"))
    return left.join(right, "piece").where(F.col("name").contains(F.col("text"))).drop("piece", "text")


def suggested_owner(found: DataFrame, members: DataFrame) -> DataFrame:
    """Adds suggested_feature: the first feature with a member whose name holds the suggested owner, else the owner.

    found has node and owner; members (feature_idx, feature, fqn). Case doesn't matter.
    """
    owners = found.where("owner is not null and owner <> ''").select("owner", F.lower("owner").alias("text")).distinct()
    best = holders(owners, members.select("feature_idx", "feature", F.lower("fqn").alias("name"))).groupBy("owner").agg(F.min_by("feature", "feature_idx").alias("found_"))
    return found.join(best, "owner", "left").withColumn("suggested_feature", F.coalesce("found_", "owner")).drop("found_")
