"""Enrichment by a language model that the caller injects, and the folds around it.

A client is any callable that takes a prompt and returns text or None; threads call it at once. Items fail one by
one: a client's error leaves that item's answer null. Null prompts have null answers; equal prompts are asked once;
empty tables give empty results. Answers are kept in a table by the hash of their prompt, written before they are read:
reading a result again, or a retry of what reads it, asks nobody.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.session import scratch

#: Items that a partition asks at once, tries for a JSON answer, least confidence of an inferred call.
BATCH, TRIES, LEAST_CONFIDENCE = 10, 2, 0.5
Client = Callable[[str], str | None]

#: Answer languages of prompts.
ANSWER_IN = {"en": "Answer in English.", "ko": "Answer in Korean."}


def answer_language(code: str | None) -> str:
    return ANSWER_IN.get(code or "en", ANSWER_IN["en"])


def ask(items: DataFrame, client: Client, prompt: str = "prompt", key: str = "id", answers: str | None = None) -> DataFrame:
    """(key, answer) of a client for every prompt, BATCH of a partition at once; null where it fails (eager).

    answers names a folder whose answers are used and added to, so that later runs don't ask again; what failed is
    asked again by the next run. Without it the answers last as long as the driver. A task that is lost while it asks
    asks its own prompts again.
    """
    spark, folder, known = items.sparkSession, answers or scratch(items.sparkSession, "answers"), "prompt_hash string, answer string"
    hashed = items.select(F.col(key).alias("id_"), F.sha2(F.col(prompt), 256).alias("prompt_hash"), F.col(prompt).alias("prompt_"))
    # an empty table to begin with, so that there is one to read
    spark.createDataFrame([], known).write.mode("append").parquet(folder)
    read = lambda: spark.read.schema(known).parquet(folder).groupBy("prompt_hash").agg(F.min("answer").alias("answer"))
    missing = hashed.where("prompt_ is not null").select("prompt_hash", "prompt_").dropDuplicates(["prompt_hash"]).join(read(), "prompt_hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(text: str | None) -> str | None:
            try:
                return client(text) if text is not None else None
            except Exception:  # one item's failure is that item's alone
                return None

        with ThreadPoolExecutor(BATCH) as pool:
            for batch in batches:
                out = list(pool.map(one, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["prompt_hash", "answer"])

    missing.select("prompt_hash", "prompt_").mapInArrow(run, known).where("answer is not null").write.mode("append").parquet(folder)
    return hashed.join(read(), "prompt_hash", "left").select(F.col("id_").alias(key), "answer")


def ask_json(items: DataFrame, client: Client, prompt: str = "prompt", key: str = "id", tries: int = TRIES, answers: str | None = None) -> DataFrame:
    """(key, answer): variant objects; an answer that is none is asked for again, then stays null."""

    def again(text: str) -> str | None:
        import json

        for _ in range(tries):
            try:
                reply = client(text)
                bare = (reply or "").strip()
                bare = bare.split("\n", 1)[1].rsplit("```", 1)[0] if bare.startswith("```") and "\n" in bare else bare
                if isinstance(json.loads(bare), dict):
                    return reply
            except Exception:  # unreadable answers count as failed tries
                continue
        return None

    return ask(items, again, prompt, key, answers).withColumn("answer", fn.json_object(F.col("answer")))


def describable(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_type").isin("function", "method"))


def describe_prompt(name: Column, source: Column, language: str = "en") -> Column:
    """Asks for one sentence on what a function does."""
    return F.concat(F.lit(f"{answer_language(language)} Say in one sentence what this function does.\nName: "), name, F.lit("\nSource:\n"), fn.truncated(source, 15_000, "\n... (truncated)"))


def calls_prompt(name: Column, source: Column, known: Column, language: str = "en") -> Column:
    """Asks for calls that only happen at run time, with at most 50 known symbols."""
    symbols = F.array_join(F.slice(known, 1, 50), "\n")
    return F.concat(F.lit(f"{answer_language(language)} Which of the known symbols can this function call dynamically? Answer as JSON {{\"calls\": [{{\"target\": ..., \"mechanism\": ..., \"confidence\": ...}}]}}.\nName: "), name, F.lit("\nSource:\n"), source, F.lit("\nKnown symbols:\n"), symbols)


def verdict_prompt(name: Column, reason: Column, source: Column, context: Column, language: str = "en") -> Column:
    """Asks whether a candidate is dead code."""
    return F.concat(
        F.lit(f"{answer_language(language)} Static analysis found no use of this code. Classify it as dead_code, module_init, global_config, constant, type_definition, decorator or generated. Answer as JSON {{\"classification\": ..., \"reason\": ..., \"suggested_owner\": ...}}.\nName: "),
        name, F.lit("\nFinding: "), reason, F.lit("\nNeighbours: "), F.array_join(context, ", "), F.lit("\nSource:\n"), source,
    )


def connection_prompt(name: Column, source: Column, features: Column, language: str = "en") -> Column:
    """Asks which feature a node without one belongs to."""
    return F.concat(F.lit(f"{answer_language(language)} Which feature does this code belong to? Answer as JSON {{\"feature\": ..., \"reason\": ...}}.\nName: "), name, F.lit("\nFeatures: "), F.array_join(features, ", "), F.lit("\nSource:\n"), source)


def grouping_prompt(names: Column, language: str = "en") -> Column:
    """Asks for names of clusters, or whether a grouping should be split."""
    return F.concat(F.lit(f"{answer_language(language)} Name each group of entry points, and list groups that should be split. Answer as JSON {{\"names\": [...], \"splits\": [...]}}.\nGroups:\n"), F.array_join(names, "\n"))


def check_prompt(lines: Column, language: str = "en") -> Column:
    """Asks whether features belong together as they are."""
    return F.concat(F.lit(f"{answer_language(language)} Does each of these features serve one purpose? Answer as JSON {{\"features\": [{{\"name\": ..., \"valid\": ..., \"reason\": ..., \"suggested_split\": [...]}}]}}.\nFeatures:\n"), F.array_join(lines, "\n"))


def name_prompt(points: Column, language: str = "en") -> Column:
    """Asks for the name of the feature that begins at some entry points."""
    return F.concat(F.lit(f"{answer_language(language)} Name the feature that these entry points make up. Answer as JSON {{\"name\": ..., \"description\": ...}}.\nEntry points:\n"), F.array_join(points, "\n"))


#: Answers that name no feature, the owner that stands for them, and answers that nothing is inferred for.
STRUCTURAL, STRUCTURAL_OWNER, NO_GUESS = ("module_init", "global_config", "constant"), "__structural__", ("dead_code", "other")
#: Confidences of a suggestion without a feature, with one, and for structural code.
UNMATCHED, MATCHED, IS_STRUCTURAL = 0.3, 0.7, 0.6


def suggestions(answers: DataFrame, owners: DataFrame, places: DataFrame) -> DataFrame:
    """(node, suggested_feature, classification, reason, confidence) of the answers to connection prompts.

    answers: node, classification, owner, reason, one row a node; owners (owner, feature): features that names of
    owners match; places (node, feature): features that a node's place in the tree suggests, for want of an owner. The
    least feature counts if there are several. Structural code gets no feature; where nothing matches it is ''.
    Null classifications count as ''; nodes without an answer aren't in answers and give no row.
    """
    known = owners.groupBy("owner").agg(F.min("feature").alias("by_owner"))
    near = places.groupBy("node").agg(F.min("feature").alias("by_place"))
    rows = answers.withColumn("classification", F.coalesce("classification", F.lit(""))).join(known, "owner", "left").join(near, "node", "left")
    structural, guess = F.col("classification").isin(*STRUCTURAL), ~F.col("classification").isin(*NO_GUESS)
    feature = F.coalesce("by_owner", F.when(guess, F.col("by_place")), F.lit(""))
    confidence = F.when(structural, IS_STRUCTURAL).when(feature != "", MATCHED).otherwise(UNMATCHED)
    return rows.select("node", F.when(structural, STRUCTURAL_OWNER).otherwise(feature).alias("suggested_feature"), "classification", F.coalesce("reason", F.lit("")).alias("reason"), confidence.alias("confidence"))


def features_prompt(summary: Column, language: str = "en") -> Column:
    """Asks for the features of a code base, given its summary."""
    return F.concat(F.lit(f"{answer_language(language)} List the user-facing features of this code base, with category and entry files. Answer as JSON {{\"features\": [...]}}.\n"), summary)


def flow_prompt(feature: Column, files: Column, language: str = "en") -> Column:
    """Asks for the steps of a feature through the given files."""
    return F.concat(F.lit(f"{answer_language(language)} List the steps of this feature in order. Answer as JSON {{\"steps\": [{{\"order\": ..., \"file\": ..., \"function\": ..., \"description\": ..., \"calls_next\": [...]}}]}}.\nFeature: "), feature, F.lit("\nFiles:\n"), files)


def inferred_edges(answers: DataFrame) -> DataFrame:
    """(source, target, edge_type, mechanism, confidence) of JSON answers to calls_prompt; reads id and answer."""
    calls = F.explode(F.try_variant_get("answer", "$.calls", "array<struct<target:string,mechanism:string,confidence:double>>"))
    rows = answers.select(F.col("id").alias("source"), calls.alias("c")).select("source", "c.target", F.lit("calls").alias("edge_type"), "c.mechanism", F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"))
    return rows.where((F.coalesce("target", F.lit("")) != "") & (F.col("confidence") >= LEAST_CONFIDENCE))


def product_features(features: DataFrame, fallback: str = "Application") -> DataFrame:
    """Features that aren't infrastructure or utilities; one stand-in if none is left."""
    kept = features.where(~F.lower(F.coalesce("category", F.lit(""))).isin("infrastructure", "utility")).select("name", "category")
    spare = features.sparkSession.createDataFrame([(fallback, "core")], "name string, category string")
    none = kept.limit(1).agg(F.count("*").alias("n_")).where("n_ = 0")
    return kept.unionByName(spare.join(F.broadcast(none)).drop("n_"))


def budget_fold(files: DataFrame, budget: int, by: str = "repo") -> DataFrame:
    """(repo, path, form): 'full' while a repository's running total stays within the budget, else 'minimal'.

    Reads repo, path, seq, full_size and min_size. A file that would pass the budget adds its minimal
    size, so later small ones may be full again. A repository's files stream through a task in their order, of which
    only the total is held, so the number of files has no bound. A file without a full size is minimal, a missing
    minimal size counts as 0; files without a repository are those of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, total, begun = None, 0, False
        for batch in batches:
            forms = []
            for owner, full, least in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if not begun or owner != repo:
                    repo, total, begun = owner, 0, True
                fits = full is not None and total + full <= budget
                total += full if fits else least or 0
                forms.append("full" if fits else "minimal")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string())], names=[by, "path", "form"])

    rows = files.select(by, "path", F.col("full_size").cast("long"), F.col("min_size").cast("long"), "seq").repartition(by).sortWithinPartitions(by, "seq", "path")
    kinds = f"{by} {files.schema[by].dataType.simpleString()}, path {files.schema['path'].dataType.simpleString()}, form string"
    return rows.drop("seq").mapInArrow(run, kinds)


#: Names of a file that one list holds on average, and parts in which a file's functions are dealt.
NAMES, DEALS = 1_000, 16


def match_signatures(steps: DataFrame, signatures: DataFrame, cutoff: float = 0.6) -> DataFrame:
    """Steps (step_id, file, function) with the signature of that name in that file, else the most similar from the cutoff on.

    Only steps without an exact match meet their own file's names; similarity is difflib's ratio. Steps of one file and
    function are compared once. A file's names go in lists of about NAMES, its functions in DEALS parts, so neither the
    names nor the functions of one file meet in one row or task; of the best of all lists the greatest name counts.
    """
    exact = signatures.where("name is not null").groupBy("file", F.col("name").alias("function")).agg(F.min(F.struct("line_start", "line_end")).alias("at"))
    rows = steps.join(exact, ["file", "function"], "left")
    found = rows.where("at is not null").select("step_id", "file", "function", F.col("function").alias("matched"), "at.line_start", "at.line_end")
    rest = rows.where("at is null").select("step_id", "file", "function", F.coalesce("function", F.lit("")).alias("key_"))
    sizes = exact.groupBy("file").agg(F.ceil(F.count("*") / NAMES).alias("lists_"))
    part, task = ("file", "list_", "deal_"), int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = exact.join(sizes, "file").groupBy("file", F.expr("pmod(xxhash64(function), lists_)").alias("list_")).agg(F.collect_list(F.struct(F.col("function").alias("name"), "at.line_start", "at.line_end")).alias("names"))
    names = names.withColumn("deal_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
    asked = rest.select("file", "key_").distinct().join(sizes, "file")
    asked = asked.select("file", "key_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists_") - 1)).alias("list_"), F.expr(f"pmod(xxhash64(key_), {DEALS}L)").alias("deal_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = difflib.SequenceMatcher()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for file, function, names_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                match.set_seq2(function)
                best, at = (cutoff, ""), None
                for x in names_:
                    match.set_seq1(x["name"])
                    # each is at most as small as the next one
                    if match.real_quick_ratio() >= best[0] and match.quick_ratio() >= best[0] and (match.ratio(), x["name"]) >= best:
                        best, at = (match.ratio(), x["name"]), x
                if at is not None:
                    for column, value in zip(out, (file, function, best[0], at["name"], at["line_start"], at["line_end"]), strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["file", "key_", "ratio", "matched", "line_start", "line_end"])

    near = asked.repartition(task, *part).join(names, list(part)).select("file", "key_", "names").mapInArrow(run, "file string, key_ string, ratio double, matched string, line_start int, line_end int")
    near = near.groupBy("file", "key_").agg(F.max(F.struct("ratio", "matched", "line_start", "line_end")).alias("best"))
    near = rest.join(near, ["file", "key_"], "left").select("step_id", "file", "function", "best.matched", "best.line_start", "best.line_end")
    return found.select("step_id", "file", "function", "matched", F.col("line_start").cast("int"), F.col("line_end").cast("int")).unionByName(near)


def file_summary(path: Column, functions: Column, imports: Column, head: Column) -> Column:
    """Text on one file for a prompt: names it defines and imports, and its first 50 lines."""
    return F.concat(F.lit("## "), path, F.lit("\nDefines: "), F.array_join(functions, ", "), F.lit("\nImports: "), F.array_join(imports, ", "), F.lit("\n"), F.array_join(F.slice(F.split(head, "\n"), 1, 50), "\n"))
