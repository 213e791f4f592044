"""Differences between two states of a repository, given as manifests (path, content_hash)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change_type, old_path): added, deleted, modified or renamed (the same content elsewhere)."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("is"))
    both = a.join(b, "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    changed = both.withColumn("kind", kind).where("kind is not null")
    # one deleted and one added path of equal content make a rename, in path order
    gone = _numbered(changed.where("kind = 'deleted'").select(F.col("was").alias("hash"), F.col("path").alias("old_path")), "old_path")
    come = _numbered(changed.where("kind = 'added'").select(F.col("is").alias("hash"), "path"), "path")
    moved = come.join(gone, ["hash", "n"]).select("path", F.lit("renamed").alias("change_type"), "old_path")
    rest = changed.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return rest.select("path", F.col("kind").alias("change_type"), F.lit(None).cast("string").alias("old_path")).unionByName(moved)


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(order)))


def category(change_type: Column) -> Column:
    """One of four lists: copies and type changes count as modified."""
    return F.when(change_type.isin("copied", "type_changed", "modified"), "modified").otherwise(change_type)


def git_change(letter: Column) -> Column:
    """Change type of a status letter, which may carry a similarity."""
    first = F.upper(F.substring(letter, 1, 1))
    return F.when(first == "A", "added").when(first == "D", "deleted").when(first == "R", "renamed").when(first == "C", "copied").when(first == "T", "type_changed").otherwise("modified")


def counts(changes: DataFrame) -> DataFrame:
    """added, deleted, modified, renamed, total and has_changes in one row."""
    kind = category(F.col("change_type"))
    one = [F.coalesce(F.sum(F.when(kind == k, 1).otherwise(0)), F.lit(0)).cast("long").alias(k) for k in ("added", "deleted", "modified", "renamed")]
    return changes.agg(*one, F.count("*").alias("total"), (F.count("*") > 0).alias("has_changes"))


def changed_paths(changes: DataFrame) -> DataFrame:
    """Every path on either side of a change, once, sorted."""
    return changes.select("path").union(changes.select("old_path")).where("path is not null").distinct().orderBy("path")


def commit_log(commits: DataFrame, limit: int = 20) -> DataFrame:
    """Newest commits first; commits (sha, message, author, timestamp)."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return commits.orderBy(F.desc("timestamp"), "sha").limit(limit)


def unified_diffs(pairs: DataFrame) -> DataFrame:
    """(path, diff) for rows (path, before, after); nulls count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            out = ["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}")) for p, a, b in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "diff"])

    return pairs.select("path", "before", "after").mapInArrow(run, "path string, diff string")


def needs_analysis(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files of the new manifest whose content wasn't there under that path."""
    return new.join(old.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
