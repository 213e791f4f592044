import subprocess

import pytest

from graphloom.operators import diff
from graphloom.sources import git


def _run(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@example.org", *args], check=True, capture_output=True)


@pytest.fixture
def remote(tmp_path):
    folder = tmp_path / "remote"
    folder.mkdir()
    _run(folder, "init", "-b", "main")
    (folder / "a.py").write_text("def f():\n    return 1\n" * 20)
    (folder / "b.py").write_text("b\n")
    _run(folder, "add", ".")
    _run(folder, "commit", "-m", "first")
    return folder


def test_clone_log_and_changes(spark, rows, tmp_path, remote):
    target = str(tmp_path / "clone")
    first = git.clone(str(remote), target)
    assert git.current_branch(target) == "main" and git.head(target) == first
    (remote / "c").mkdir()
    (remote / "a.py").rename(remote / "c" / "d.py")
    (remote / "b.py").write_text("changed\n")
    (remote / "é x.py").write_text("new\n")
    _run(remote, "add", "-A")
    _run(remote, "commit", "-m", "second\n\nwith a body")
    second = git.clone(str(remote) + "/", target)
    assert second != first
    assert [r["message"] for r in git.commits(spark, target).collect()] == ["second\n\nwith a body", "first"]
    assert rows(git.changes(spark, target, first)) == [("b.py", "modified", None, "modified"), ("c/d.py", "renamed", "a.py", "renamed"), ("é x.py", "added", None, "added")]
    by_hash = diff.manifest_diff(git.manifest(spark, target, first), git.manifest(spark, target))
    assert rows(by_hash) == [("b.py", "modified", None), ("c/d.py", "renamed", "a.py"), ("é x.py", "added", None)]
    assert "+changed" in git.file_diff(target, "b.py", first)
    assert git.info(spark, target).first()["sha"] == second


def test_errors(spark, tmp_path, remote):
    with pytest.raises(git.GitError):
        git.clone(str(tmp_path / "nothing"), str(tmp_path / "x"))
    git.clone(str(remote), str(tmp_path / "y"))
    with pytest.raises(git.GitError):
        git.clone(str(tmp_path / "other"), str(tmp_path / "y"))
    with pytest.raises(ValueError):
        git.commits(spark, str(remote), 0)
    assert git.normal_url("https://X.org/a/B.git/") == "https://x.org/a/b"
