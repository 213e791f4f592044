"""Committed snapshots, and analyses that go on from the one before."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.plans import analysis
from graphloom.sources import parse, snapshots


def _files(spark, some):
    return spark.createDataFrame(list(some.items()), "path string, content string")


EDGE = "id string, source_node_id string, target_node_id string, edge_type string, line_number int"


def _edge(spark, *ids):
    return spark.createDataFrame([(i, "a", "b", "calls", 1) for i in ids], EDGE)


def test_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert snapshots.load(spark, folder, "code_edges").collect() == []
    for ids in (("e1", "e2"), ("e1", "e2")):  # a second run of a snapshot replaces the first
        with snapshots.Run(spark, folder, "r", "2024-01-01 s:1") as run:
            run.save(_edge(spark, *ids), "code_edges")
    assert sorted(r["id"] for r in snapshots.load(spark, folder, "code_edges").collect()) == ["e1", "e2"]
    with pytest.raises(RuntimeError, match="killed"), snapshots.Run(spark, folder, "r", "007") as run:
        run.save(_edge(spark, "e9"), "code_edges")
        raise RuntimeError("killed")
    assert snapshots.load(spark, folder, "code_edges").count() == 2 and snapshots.latest(spark, folder, "r") == "2024-01-01 s:1"
    with snapshots.Run(spark, folder, "r", "007") as run:
        run.save(_edge(spark, "e3"), "code_edges")
    assert [r["snapshot_id"] for r in snapshots.load(spark, folder, "code_edges", "007").collect()] == ["007"]
    assert snapshots.load(spark, folder, "code_edges").count() == 3 and snapshots.latest(spark, folder, "r") == "007"
    assert snapshots.vacuum(spark, folder) == 2 and snapshots.vacuum(spark, folder) == 0
    assert sorted(r["id"] for r in snapshots.load(spark, folder, "code_edges").collect()) == ["e1", "e2", "e3"]
    assert snapshots.load(spark, folder, "code_edges", "none").collect() == []


def test_schemas_are_enforced(spark, tmp_path):
    run = snapshots.Run(spark, str(tmp_path), "r", "s")
    with pytest.raises(ValueError, match="unknown columns \\['more'\\]"):
        run.save(_edge(spark, "e").withColumn("more", F.lit(1)), "code_edges")
    with pytest.raises(ValueError, match="missing columns \\['edge_type'\\]"):
        run.save(_edge(spark, "e").drop("edge_type"), "code_edges")
    with pytest.raises(Exception, match="code_edges.id is null"):
        run.save(_edge(spark, None), "code_edges")


def _tables(a):
    reached = a.reached.join(a.nodes.select("node"), "node", "left_semi")
    named = a.clusters.select(F.col("cluster_idx").alias("cluster"), "cluster_name").distinct()
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    return rows(a.nodes.select("node", "line_start")), rows(a.edges.select("source", "target", "src", "dst", "line_number")), rows(reached), rows(a.tagged.join(named, "cluster").select("cluster_name", "node")), rows(a.dead), rows(a.assigned), rows(a.features)


def test_next_analysis_equals_a_full_one(spark, tmp_path, monkeypatch):
    """Random edits; only changed files are parsed."""
    rng = random.Random(6)

    def module(k):
        calls = "".join(f"    f{rng.randrange(6)}()\n" for _ in range(2))
        imports = "".join(f"from m{j} import f{j}\n" for j in rng.sample(range(6), 2) if j != k)
        route = f"@app.get('/p{k % 2}/x{k}')\n" if k % 2 == 0 else ""
        return f"{imports}\n{route}def f{k}():\n{calls}\ndef g{k}():\n    pass\n"

    files, folder = {f"m{k}.py": module(k) for k in range(6)}, str(tmp_path)
    first = analysis.analyze_sources(_files(spark, files))
    analysis.persist(first, folder, "r", "s0")
    parsed, whole = [], parse.parse
    for step in range(2):
        changed = {f"m{k}.py": module(k) for k in rng.sample(range(6), 2)}
        files = {p: c for p, c in (files | changed).items() if p != f"m{step}.py" or p in changed} | {f"new{step}.py": "from m2 import f2\n\ndef n():\n    f2()\n"}
        monkeypatch.setattr(parse, "parse", lambda rows: (parsed.append(sorted(r["path"] for r in rows.collect())), whole(rows))[1])
        before = analysis.previous(spark, folder, "r")
        found = analysis.analyze_sources(_files(spark, files), before=before)
        monkeypatch.setattr(parse, "parse", whole)
        assert parsed.pop() == sorted([*changed, f"new{step}.py"])
        assert _tables(found) == _tables(analysis.analyze_sources(_files(spark, files)))
        analysis.persist(found, folder, "r", f"s{step + 1}")
    assert snapshots.latest(spark, folder, "r") == "s2"


def test_modules_imported_from_their_folder_are_alive(spark):
    some = {
        "pkg/a.py": "from . import sib, deep, thing, gone\n\n@app.get('/a')\ndef use():\n    return 1\n",
        "pkg/sib.py": "def helper():\n    pass\n", "pkg/deep/__init__.py": "def inner():\n    pass\n", "pkg/__init__.py": "def thing():\n    pass\n", "sib.py": "def other():\n    pass\n",
    }
    a = analysis.analyze_sources(_files(spark, some))
    edges = {(r["src"], r["dst"]) for r in a.edges.where("edge_type = 'imports'").collect()}
    assert {("pkg.a:use", "pkg.sib"), ("pkg.a:use", "pkg.deep"), ("pkg.a:use", "pkg:thing")} <= edges and ("pkg.a:use", "sib") not in edges
    assert {r["node"] for r in a.dead.collect()} == {"sib:other"}
