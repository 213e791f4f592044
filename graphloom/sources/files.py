"""Source files: discovery, decoding, persisted tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.session import ship, written
from graphloom.sources import snapshots

#: Folders that hold no source, and the largest file that is read.
SKIPPED = (
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".env", "dist", "build", ".next", ".nuxt", ".svelte-kit", ".output", ".tox", ".mypy_cache", ".pytest_cache",
    ".ruff_cache", "egg-info", ".eggs", "target", "vendor", "coverage", ".coverage", ".gradle", ".idea", ".vscode",
)
MAX_BYTES = 5 * 1024 * 1024
#: Folders that a task lists, and tasks of a level at most.
FOLDERS, FOLDER_TASKS = 50, 2_000
#: Tables to which rows are added one by one; those of snapshots are in sources.snapshots.
TABLES = ("repositories", "analysis_snapshots")


def wanted(path: Column, size: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Whether a file below a root counts: known extension, sensible size, no skipped or hidden folder."""
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda d: d != "")
    bad = F.exists(folders, lambda d: d.isin(*SKIPPED) | d.startswith(".") | d.endswith(".egg-info"))
    return ~bad & size.between(1, max_bytes) & fn.language(path).isNotNull()


LISTING = "path string, folder boolean, size long"


def walk(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> tuple[DataFrame, DataFrame]:
    """(files, folders) under a root: (path, size), and (path) of every folder that was listed, both below the root.

    Tasks list a frontier of folders, one level a round; skipped and hidden folders are dropped before anyone lists
    them. The root is a URI or path that Arrow's file systems open; links to folders aren't followed.
    """
    ship(spark)
    top = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(top)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = store.get_file_info(pa_fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                rows = [(f"{folder}/{x.base_name}".lstrip("/"), x.type == pa_fs.FileType.Directory, x.size) for x in found if x.type != pa_fs.FileType.NotFound and not (x.type == pa_fs.FileType.Directory and _skips(x.base_name, skipped))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["path", "folder", "size"])

    frontier, files, folders = spark.createDataFrame([("",)], "path string"), None, None
    while True:
        parts = min(FOLDER_TASKS, 1 + frontier.count() // FOLDERS)
        level = written(frontier.repartition(parts).mapInArrow(run, LISTING), "listing")
        files = level if files is None else files.unionByName(level)
        folders = frontier if folders is None else folders.unionByName(frontier)
        frontier = level.where("folder").select("path")
        if frontier.isEmpty():
            return files.where("not folder").select("path", "size"), folders


def _skips(name: str, skipped: tuple[str, ...]) -> bool:
    return name in skipped or name.startswith(".") or name.endswith(".egg-info")


def _store(root: str) -> tuple[pa_fs.FileSystem, str]:
    """Arrow's file system of a root, and the root's path in it."""
    if "://" in root or root.startswith("file:"):
        return pa_fs.FileSystem.from_uri(root)
    return pa_fs.LocalFileSystem(), root


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, raw) of files (path) below a root, opened by the tasks that read them; a file that has gone gives no row."""
    ship(files.sparkSession)
    top = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(top)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with store.open_input_stream(f"{base}/{path}") as file:
                        raw = file.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([raw], pa.binary())], names=["path", "raw"])

    return files.select("path").mapInArrow(run, "path string, raw binary")


def discover(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, size, file_seq) of the source files under a root, by path; contents aren't read."""
    kept = walk(spark, root)[0].where(wanted(F.col("path"), F.col("size"), max_bytes))
    # numbers grow with the path but have gaps, so no task sees all rows
    return kept.withColumn("language", fn.language(F.col("path"))).orderBy("path").withColumn("file_seq", F.monotonically_increasing_id())


def read_text(content: Column) -> Column:
    """Text of a file's bytes: UTF-8 without a byte order mark, else Latin-1; empty for null."""
    raw = content.cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))
    return F.coalesce(F.regexp_replace(text, "^﻿", ""), F.lit(""))


def sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all source files under a root; no other file is opened, no skipped folder listed."""
    kept = walk(spark, root)[0].where(wanted(F.col("path"), F.col("size")))
    return contents(kept, root).select("path", read_text(F.col("raw")).alias("content"))


def manifest(files: DataFrame, **more: Column) -> DataFrame:
    """(path, content_hash) of rows (path, content), and further columns of the same pass by name; null contents have null hashes."""
    return files.select("path", F.sha2(F.col("content"), 256).alias("content_hash"), *[c.alias(name) for name, c in more.items()])


def save(table: DataFrame, folder: str, name: str, mode: str = "append") -> None:
    """Adds rows to one of TABLES."""
    if name not in TABLES:
        raise ValueError(f"{name} is written by a run of its snapshot")
    table.write.mode(mode).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a table; of snapshots those that are committed."""
    return spark.read.parquet(f"{folder}/{name}") if name in TABLES else snapshots.load(spark, folder, name)
