"""Rules as data: rows that break one go to quarantine, and counts come with the pass that writes them.

A condition that is null counts as broken, so a rule says what must hold. An empty list of rules lets all rows pass;
repeated rows are judged each; an empty table gives an empty result and counts of 0.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.streaming.progress import TERMINAL


class Rule(NamedTuple):
    """A condition in SQL that every row of a table must meet."""

    name: str
    condition: str


def one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


#: Kinds of nodes, edges and entry points, and states of a snapshot.
NODE_TYPES, EDGE_TYPES = ("function", "class", "method", "module"), ("calls", "imports", "inherits", "instantiates")
ENTRY_TYPES, STATES = ("http_route", "websocket", "main", "cli", "export", "lifecycle"), ("pending", "running", *TERMINAL)

RULES = {
    "code_nodes": (Rule("node_type", one_of("node_type", NODE_TYPES)), Rule("lines", "line_start >= 0 and line_end >= line_start"), Rule("name", "name <> ''"), Rule("file", "file_path <> ''")),
    "code_edges": (Rule("edge_type", one_of("edge_type", EDGE_TYPES)), Rule("source", "source_node_id is not null"), Rule("line", "line_number >= 0")),
    "entry_points": (Rule("entry_type", one_of("entry_type", ENTRY_TYPES)), Rule("name", "node_name <> ''")),
    "analysis_snapshots": (Rule("status", one_of("status", STATES)), Rule("repository", "repo_id <> ''")),
    "repositories": (Rule("origin", "coalesce(url, '') <> '' or coalesce(local_path, '') <> ''"), Rule("branch", "coalesce(branch, 'main') <> ''")),
}


def judged(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rows with `broken`, the names of the rules that they break, in the rules' order."""
    names = [F.when(~F.coalesce(F.expr(f"({r.condition})"), F.lit(False)), F.lit(r.name)) for r in rules]
    return rows.withColumn("broken", F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))


def _counts(rules: tuple[Rule, ...]) -> list[Column]:
    broken = [F.count_if(F.array_contains("broken", r.name)).alias(f"broken_{r.name}") for r in rules]
    return [F.count("*").alias("rows"), F.count_if(F.size("broken") > 0).alias("quarantined"), *broken]


def write(rows: DataFrame, rules: tuple[Rule, ...], path: str) -> dict[str, int]:
    """Writes sound rows and quarantined ones side by side, in one pass, and returns counts of that pass."""
    seen = Observation()
    marked = judged(rows, rules).observe(seen, *_counts(rules)).withColumn("is_quarantined", F.size("broken") > 0)
    marked.write.partitionBy("is_quarantined").parquet(path)
    return seen.get


def sound(spark: SparkSession, path: str) -> DataFrame:
    """Rows that break no rule; quarantined ones aren't read."""
    return spark.read.parquet(path).where("not cast(is_quarantined as boolean)").drop("broken", "is_quarantined")


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """Rows that break a rule, with the names of the broken ones."""
    return spark.read.parquet(path).where("cast(is_quarantined as boolean)").drop("is_quarantined")
