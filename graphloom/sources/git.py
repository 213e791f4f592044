"""Git repositories as tables. The git program runs on the driver: this is the ingest step, before any plan."""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.diff import category, git_change

COMMITS = "sha string, message string, author string, timestamp timestamp"


class GitError(RuntimeError):
    """git ended with an error; the message is what it said."""


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def normal_url(url: str) -> str:
    """Comparable form of a remote; `git_url` in functions.text has the same rule for columns."""
    return url.strip().rstrip("/").removesuffix(".git").lower()


def is_repository(path: str) -> bool:
    return Path(path, ".git").exists() or Path(path, "HEAD").is_file()


def clone(url: str, target: str, branch: str | None = None) -> str:
    """Clones, or updates a clone of the same remote; returns the commit that is checked out."""
    if is_repository(target):
        if normal_url(git(target, "config", "--get", "remote.origin.url")) != normal_url(url):
            raise GitError(f"{target} is a clone of another remote")
        return fetch(target, branch)
    if Path(target).exists() and any(Path(target).iterdir()):
        raise GitError(f"{target} isn't empty and no repository")
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    git(".", "clone", *(["--branch", branch] if branch else []), url, target)
    return head(target)


def fetch(repo: str, branch: str | None = None) -> str:
    """Fetches and moves to the remote's state of a branch, which is made if it is new here."""
    git(repo, "fetch", "--prune", "origin")
    name = branch or current_branch(repo)
    git(repo, "checkout", "-B", name, f"origin/{name}")
    return head(repo)


def head(repo: str) -> str:
    return git(repo, "rev-parse", "HEAD").strip()


def current_branch(repo: str) -> str:
    """The branch that is checked out, or the commit if none is."""
    name = git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return head(repo) if name == "HEAD" else name


def info(spark: SparkSession, repo: str) -> DataFrame:
    """One row: path, branch, sha, message, author, timestamp."""
    row = commits(spark, repo, 1).withColumn("path", F.lit(repo)).withColumn("branch", F.lit(current_branch(repo)))
    return row.select("path", "branch", "sha", "message", "author", "timestamp")


def commits(spark: SparkSession, repo: str, limit: int = 20) -> DataFrame:
    """COMMITS, newest first, at most `limit`."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    raw = git(repo, "log", f"-{limit}", "--format=%H%x1f%B%x1f%an%x1f%ct%x1e")
    rows = []
    for entry in raw.split("\x1e"):
        if entry.strip():
            sha, message, author, seconds = entry.strip("\n").split("\x1f")
            rows.append((sha, message.strip(), author, datetime.fromtimestamp(int(seconds), UTC)))
    return spark.createDataFrame(rows, COMMITS)


def manifest(spark: SparkSession, repo: str, commit: str = "HEAD") -> DataFrame:
    """(path, content_hash) of a commit's files, for `manifest_diff`."""
    lines = [x.split("\t", 1) for x in git(repo, "ls-tree", "-r", "-z", commit).split("\0") if x]
    return spark.createDataFrame([(path, meta.split()[2]) for meta, path in lines if meta.split()[1] == "blob"], "path string, content_hash string")


def changes(spark: SparkSession, repo: str, old: str, new: str = "HEAD") -> DataFrame:
    """(path, change_type, old_path, category) between two commits, renames found by git."""
    parts = git(repo, "diff", "--name-status", "-z", "-M", "-C", old, new).split("\0")
    rows, at = [], 0
    while at < len(parts) - 1:
        two = parts[at][0] in "RC"
        rows.append((parts[at + 1 + two], parts[at], parts[at + 1] if two else None))
        at += 2 + two
    found = spark.createDataFrame(rows, "path string, letter string, old_path string")
    kind = git_change(F.col("letter"))
    return found.select("path", kind.alias("change_type"), "old_path", category(kind).alias("category"))


def file_diff(repo: str, path: str, old: str, new: str = "HEAD") -> str:
    """Unified diff of one file between two commits."""
    return git(repo, "diff", old, new, "--", path)
