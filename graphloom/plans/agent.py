"""Features of a repository as a language model sees them: summary, discovery, flows, verification, tables.

The client is injected (see operators.enrich). Files without text add nothing; a feature whose files aren't there
has no steps; a client that fails leaves its feature without steps, and a failed discovery gives one stand-in feature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import dead_code, enrich
from graphloom.session import written
from graphloom.sources import files as file_source
from graphloom.sources import parse as parsing
from graphloom.sources import snapshots

#: Extensions that an agent reads, and folders that it skips beside hidden ones.
EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".h", ".hpp", ".cs")
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build", "egg-info", "coverage")
#: Characters of a summary and of a file in a prompt, lines of a file in a summary.
SUMMARY_CHARS, FILE_CHARS, HEAD_LINES = 80_000, 15_000, 50
#: Palette of an agent's features, and the feature that stands in for none.
COLORS = ("#3b82f6", "#10b981", "#f59e0b", "#ef4444", "#8b5cf6", "#ec4899", "#06b6d4", "#84cc16", "#f97316", "#6366f1")
STAND_IN = ("Main Application", "Primary application logic", "core")

FEATURE = "name string, description string, category string, files array<string>"
STEP = "array<struct<order:int,file:string,function:string,description:string,calls_next:array<string>>>"


@dataclass
class Agent:
    """What an agent's run finds."""

    features: DataFrame
    steps: DataFrame
    functions: DataFrame


def wanted(path: Column) -> Column:
    """Whether an agent reads a file below a root."""
    parts = F.split(path, "/")
    bad = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: d.isin(*SKIPPED) | d.startswith("."))
    return ~bad & fn.extension(path).isin(*EXTENSIONS)


def sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files that an agent reads under a root."""
    kept = file_source.walk(spark, root, SKIPPED)[0].where(wanted(F.col("path")))
    return file_source.contents(kept, root).select("path", file_source.read_text(F.col("raw")).alias("content"))


def functions(files: DataFrame) -> DataFrame:
    """(file, name, line_start, line_end) of functions, methods (also as Class.method) and classes; of one name the last."""
    parsed = parsing.parse(files)
    classes = parsing.nodes(parsed).where("node_type = 'class'").select(F.col("file_path").alias("file"), "name", "line_start", "line_end")
    rows = parsing.signatures(parsed).unionByName(classes)
    return rows.groupBy("file", "name").agg(F.max(F.struct("line_start", "line_end")).alias("at")).select("file", "name", "at.line_start", "at.line_end")


def summary(files: DataFrame, signatures: DataFrame, budget: int = SUMMARY_CHARS) -> DataFrame:
    """One row `summary`: the tree of all files and, by path, what each holds: in full while the budget lasts, then names only.

    A repository's summary is one prompt, so its pieces meet in one row by nature.
    """
    listed = F.array_sort(F.collect_list(F.struct("line_start", "line_end", "name")))
    names = signatures.groupBy(F.col("file").alias("path")).agg(listed.alias("names"))
    rows = files.where("content <> ''").join(names, "path", "left")
    lines = F.split("content", "\n")
    each = F.array_join(F.transform("names", lambda x: F.concat(F.lit("    "), x["name"], F.lit(" at "), x["line_start"].cast("string"), F.lit(".."), x["line_end"].cast("string"))), "\n")
    title = F.concat(F.lit("\n# "), "path")
    full = F.concat(title, F.lit(" ("), F.size(lines).cast("string"), F.lit(" lines)\n"), F.array_join(F.slice(lines, 1, HEAD_LINES), "\n"), F.lit("\n"), F.when(F.size("names") > 0, F.concat(F.lit("Defines:\n"), each)).otherwise(""), F.lit("\n"))
    short = F.array_join(F.array_sort(F.transform("names", lambda x: x["name"])), ", ")
    minimal = F.concat(title, F.lit(", names only: "), F.when(F.size("names") > 0, short).otherwise("none known"), F.lit("\n"))
    texts = rows.select(F.lit("r").alias("repo"), "path", F.col("path").alias("seq"), full.alias("full"), minimal.alias("minimal"))
    forms = enrich.budget_fold(texts.select("repo", "path", "seq", F.length("full").alias("full_size"), F.length("minimal").alias("min_size")), budget)
    chosen = texts.join(forms, ["repo", "path"]).select("path", F.when(F.col("form") == "full", F.col("full")).otherwise(F.col("minimal")).alias("text"))
    details = chosen.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("details"))
    tree = files.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.concat(F.lit("  "), p)), "\n").alias("tree"))
    whole = F.concat(F.lit("Paths of all "), F.col("n").cast("string"), F.lit(" files\n"), "tree", F.lit("\n\nWhat they hold\n"), "details")
    return tree.join(F.broadcast(details)).select(whole.alias("summary"))  # one row each


def discover(summaries: DataFrame, client: enrich.Client, language: str = "en") -> DataFrame:
    """(feature_idx, name, description, category, files) of the features that a client sees; one stand-in without any."""
    asked = enrich.ask_json(summaries.select(F.lit(1).alias("id"), enrich.features_prompt(F.col("summary"), language).alias("prompt")), client)
    listed = F.try_variant_get("answer", "$.features", "array<struct<name:string,description:string,category:string,files:array<string>>>")
    rows = asked.select(F.posexplode(listed).alias("feature_idx", "f")).select("feature_idx", F.coalesce("f.name", F.lit("Unknown Feature")).alias("name"), F.coalesce("f.description", F.lit("")).alias("description"), F.coalesce("f.category", F.lit("core")).alias("category"), F.coalesce("f.files", F.array().cast("array<string>")).alias("files"))
    rows = written(rows.where(~F.col("category").isin("infrastructure", "utility")), "features")
    if rows.isEmpty():
        rows = summaries.sparkSession.createDataFrame([(0, *STAND_IN, [])], f"feature_idx int, {FEATURE}")
    return rows


def flows(features: DataFrame, files: DataFrame, client: enrich.Client, language: str = "en") -> DataFrame:
    """(feature_idx, list_pos, order, file, function, description, calls_next): the steps of each feature."""
    wanted_ = features.select("feature_idx", "name", F.posexplode("files").alias("at", "path"))
    text = F.concat(F.lit("--- "), "path", F.lit("\n"), fn.truncated(F.col("content"), FILE_CHARS, "\n... (truncated)"))
    held = wanted_.join(files.where("content <> ''"), "path").select("feature_idx", "name", F.struct("at", text.alias("text")).alias("x"))
    asked = held.groupBy("feature_idx", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n").alias("files"))
    asked = enrich.ask_json(asked.select(F.col("feature_idx").alias("id"), enrich.flow_prompt(F.col("name"), F.col("files"), language).alias("prompt")), client)
    steps = F.coalesce(F.try_variant_get("answer", "$.flow_steps", STEP), F.try_variant_get("answer", "$.steps", STEP))
    rows = asked.select(F.col("id").alias("feature_idx"), F.posexplode(steps).alias("list_pos", "s")).select("feature_idx", "list_pos", "s.*")
    return rows.na.fill("", ["file", "function", "description"]).na.fill(0, ["order"])


def located(steps: DataFrame, signatures: DataFrame) -> DataFrame:
    """Steps with line_start and line_end of their function in their file, or of the most similar one."""
    keyed = steps.withColumn("step_id", F.concat_ws("#", F.col("feature_idx").cast("string"), F.col("list_pos").cast("string")))
    found = enrich.match_signatures(keyed.select("step_id", "file", "function"), signatures).select("step_id", "line_start", "line_end")
    return keyed.join(found, "step_id", "left").drop("step_id")


def analyze(spark: SparkSession, files: DataFrame, client: enrich.Client, language: str = "en") -> Agent:
    """Runs all steps over (path, content); each client call happens once."""
    known = written(functions(files), "functions")
    found = discover(summary(files, known), client, language)
    steps = written(flows(found, files, client, language), "steps")
    return Agent(found, written(located(steps, known), "located"), known)


def step_edges(steps: DataFrame) -> DataFrame:
    """(source, target): a step's calls_next (file:function) that are steps, else the next step of its feature's list.

    steps: feature_idx, list_pos, node (file::function) and calls_next. Of several steps of one name the last counts.
    """
    names = steps.select("node").distinct()
    following = F.lead("node").over(Window.partitionBy("feature_idx").orderBy("list_pos"))
    rows = steps.withColumn("next_", following)
    target = F.regexp_replace(F.col("ref"), "^([^:]*):", "$1::")
    called = rows.select("feature_idx", "list_pos", "node", F.explode("calls_next").alias("ref")).withColumn("target", target)
    called = called.where("target <> node").join(names.withColumnRenamed("node", "target"), "target", "left_semi")
    rest = rows.join(called.select("feature_idx", "list_pos").distinct(), ["feature_idx", "list_pos"], "left_anti").where("next_ is not null")
    return called.select(F.col("node").alias("source"), "target").unionAll(rest.select("node", "next_"))


def persist(a: Agent, folder: str, repo_id: str, snapshot_id: str) -> None:
    """Commits features, nodes (steps, and functions that are none as dead code) and edges of an agent's snapshot."""

    def ident(*parts) -> Column:
        return F.sha2(F.concat_ws("::", F.lit(snapshot_id), *parts), 256)

    none = F.lit(None).cast("string")
    features = a.features.select(ident(F.col("feature_idx").cast("string")).alias("id"), F.lit(repo_id).alias("repo_id"), "name", "description", fn.color(F.col("feature_idx"), COLORS).alias("color"))
    node = F.concat_ws("::", "file", "function")
    steps = a.steps.withColumn("node", node)
    # a function is one node, the step that names it last
    last = steps.groupBy("node").agg(F.max_by(F.struct(*steps.columns), F.struct("feature_idx", "list_pos")).alias("s")).select("s.*")
    shared = lambda rows, name: rows.select(
        ident(F.col("node")).alias("id"), F.lit(snapshot_id).alias("snapshot_id"), F.col("file").alias("file_path"), F.lit("function").alias("node_type"), F.col(name).alias("name"), fn.language(F.col("file"), "unknown", fn.AGENT_LANGUAGES).alias("language"),
        F.coalesce("line_start", F.lit(0)).alias("line_start"), F.coalesce("line_end", F.lit(0)).alias("line_end"), F.lit("").alias("source_code"), none.alias("docstring"), none.alias("metadata"), "feature_id", "is_entry_point", "is_dead_code", "description", F.col("order").alias("flow_order"),
    )
    used = last.withColumn("feature_id", ident(F.col("feature_idx").cast("string"))).withColumn("is_entry_point", F.col("order") == 1).withColumn("is_dead_code", F.lit(False))
    dead = dead_code.agent_candidates(a.functions, a.steps).withColumn("node", F.concat_ws("::", "file", "name")).withColumn("feature_id", none).withColumn("is_entry_point", F.lit(False)).withColumn("is_dead_code", F.lit(True))
    dead = dead.withColumn("description", F.lit("Not referenced by any discovered feature")).withColumn("order", F.lit(None).cast("int"))
    nodes = shared(used, "function").unionByName(shared(dead, "name"))
    edges = step_edges(steps)
    edges = edges.select(ident(F.col("source"), F.col("target")).alias("id"), F.lit(snapshot_id).alias("snapshot_id"), ident(F.col("source")).alias("source_node_id"), ident(F.col("target")).alias("target_node_id"), F.lit("calls").alias("edge_type"), F.lit(0).alias("line_number"))
    with snapshots.Run(a.steps.sparkSession, folder, repo_id, snapshot_id) as out:
        for name, table in (("features", features), ("code_nodes", nodes), ("code_edges", edges)):
            out.save(table, name)
