"""The agent's run and analysis jobs, with clients that answer from a script."""

import json

from graphloom.operators import enrich
from graphloom.plans import agent, analysis, jobs
from graphloom.sources import files as file_source

CODE = {
    "app.py": "class App:\n    def run(self):\n        pass\n\ndef load():\n    pass\n\ndef lonely():\n    pass\n\ndef __init__():\n    pass\n",
    "lib/io.py": "def write():\n    pass\n", "web/x.ts": "export const a = 1\n", "empty.py": "", "bad.py": "def (",
}


def _files(spark):
    return spark.createDataFrame(list(CODE.items()), "path string, content string")


def _client(prompt):
    if "Paths of all" in prompt:
        return json.dumps({"features": [{"name": "Loading", "category": "core", "files": ["app.py", "lib/io.py", "gone.py"]}, {"name": "Logs", "category": "utility"}, {"name": "Empty", "files": ["gone.py"]}]})
    steps = [{"order": 1, "file": "app.py", "function": "load", "calls_next": ["lib/io.py:write", "x:y"]}, {"order": 2, "file": "app.py", "function": "App.rum"}, {"order": 3, "file": "lib/io.py", "function": "write"}]
    return "```json\n" + json.dumps({"flow_steps": steps}) + "\n```"


def test_agent(spark, tmp_path):
    found = agent.analyze(spark, _files(spark), _client)
    assert [(r["feature_idx"], r["name"]) for r in found.features.orderBy("feature_idx").collect()] == [(0, "Loading"), (2, "Empty")]
    steps = found.steps.orderBy("list_pos").collect()
    assert [(r["function"], r["line_start"]) for r in steps] == [("load", 5), ("App.rum", 2), ("write", 1)]
    folder = str(tmp_path)
    agent.persist(found, folder, "r", "s")
    nodes = {r["name"]: r for r in file_source.load(spark, folder, "code_nodes").collect()}
    assert nodes["load"]["is_entry_point"] and not nodes["write"]["is_dead_code"] and nodes["lonely"]["is_dead_code"] and "__init__" not in nodes
    ids = {r["id"]: name for name, r in nodes.items()}
    edges = {(ids[r["source_node_id"]], ids[r["target_node_id"]]) for r in file_source.load(spark, folder, "code_edges").collect()}
    assert edges == {("load", "write"), ("App.rum", "write")}


def test_summary_and_stand_in(spark):
    known = agent.functions(_files(spark))
    text = agent.summary(_files(spark), known).first()["summary"]
    assert text.startswith("Paths of all 5 files\n  app.py\n  bad.py\n") and "    App.run at 2..3" in text and "# empty.py" not in text
    small = agent.summary(_files(spark), known, budget=150).first()["summary"]
    assert "# app.py, names only: App, App.run, __init__, load, lonely, run\n" in small
    none = agent.analyze(spark, _files(spark), lambda prompt: None)
    assert none.features.first()["name"] == "Main Application" and none.steps.count() == 0


def test_wanted_files(spark):
    paths = spark.createDataFrame([("a/x.py",), (".git/x.py",), ("a/node_modules/x.js",), ("x.md",), ("b/X.HPP",)], "path string")
    assert sorted(r["path"] for r in paths.where(agent.wanted(paths["path"])).collect()) == ["a/x.py", "b/X.HPP"]


def test_jobs(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from graphloom.operators import serve

    repos = serve.new_repository(spark, "u", "/a", datetime(2024, 1, 1))
    repo, folder = repos.first()["id"], str(tmp_path)
    assert jobs.start(spark, folder, repos, "none", "abcd", lambda: _files(spark))[0] == 404
    assert jobs.start(spark, folder, repos, repo, None, lambda: _files(spark))[0] == 400
    monkeypatch.setitem(jobs.PROGRESS, repo, {"status": "running"})
    assert jobs.start(spark, folder, repos, repo, "abcd", lambda: _files(spark))[0] == 409
    jobs.PROGRESS.pop(repo)
    code, state = jobs.start(spark, folder, repos, repo, "abcd", lambda: _files(spark), wait=True)
    assert code == 202 and state["status"] == "completed" and state["progress"] == 100.0
    snapshots = file_source.load(spark, folder, "analysis_snapshots")
    assert {r["status"] for r in snapshots.collect()} == {"pending", "running", "completed"}
    row = jobs.current(snapshots).first()
    assert row["status"] == "completed" and json.loads(row["stats"])["files"] == 5
    nodes = file_source.load(spark, folder, "code_nodes").count()

    def fails(*_):
        raise RuntimeError("no clusters")

    monkeypatch.setattr(analysis.features, "cluster_entry_points", fails)
    assert jobs.start(spark, folder, repos, repo, "abce", lambda: _files(spark), wait=True)[1]["status"] == "failed"
    assert file_source.load(spark, folder, "code_nodes").count() == 2 * nodes  # what was found is kept
    assert {r["status"] for r in jobs.current(file_source.load(spark, folder, "analysis_snapshots")).collect()} == {"completed", "failed"}


def test_grouping_is_split_until_the_client_agrees(spark):
    groups = spark.createDataFrame([(0, "all"), (1, "fine")], "feature int, name string")
    points = spark.createDataFrame([(0, 0, "m:a", "a"), (0, 1, "m:b", "b"), (0, 2, "m:c", None), (1, 3, "m:d", "d")], "feature int, ep_seq int, node_name string, start string")
    members = spark.createDataFrame([(0, n) for n in ("a", "x", "b", "y")] + [(1, "d")], "feature int, node string")
    links = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "d")], "src string, dst string")

    def client(prompt):
        wrong = [{"name": "all", "valid": False, "suggested_split": ["one", "two"]}] if "all: m:a, m:b, m:c" in prompt else []
        return json.dumps({"features": [*wrong, {"name": "fine", "valid": True}]})

    found, entries, held, rounds = analysis.verify_grouping(groups, points, members, links, client)
    assert rounds == 2 and sorted(map(tuple, found.collect())) == [(0, "one"), (1, "two"), (2, "fine")]
    assert sorted((r["feature"], r["node_name"]) for r in entries.collect()) == [(0, "m:a"), (1, "m:b"), (1, "m:c"), (2, "m:d")]
    assert sorted(map(tuple, held.select("feature", "node").collect())) == [(0, "a"), (0, "x"), (1, "b"), (1, "y"), (2, "d")]
    assert analysis.verify_grouping(groups, points, members, links)[3] == 1


def test_answers_are_asked_once(spark, tmp_path):
    log, folder = tmp_path / "asked", str(tmp_path / "answers")

    def client(prompt):
        with open(log, "a") as file:
            file.write(prompt + "\n")
        if prompt == "bad" and log.read_text().count("bad") == 1:
            raise RuntimeError("once")
        return prompt.upper()

    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id int, prompt string").repartition(3)
    asked = enrich.ask(items, client, answers=folder)
    for _ in range(2):
        assert sorted(map(tuple, asked.collect())) == [(1, "A"), (2, "B"), (3, "A"), (4, None), (5, None)]
    assert sorted(log.read_text().split()) == ["a", "b", "bad"]
    again = enrich.ask(items.union(spark.createDataFrame([(6, "c")], items.schema)), client, answers=folder)
    assert dict(map(tuple, again.collect())) == {1: "A", 2: "B", 3: "A", 4: None, 5: "BAD", 6: "C"}
    assert sorted(log.read_text().split()) == ["a", "b", "bad", "bad", "c"]  # what failed, and what is new


def test_budget_folds_over_batches(spark, monkeypatch):
    """More files than a batch holds, of two repositories and of none."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        files = [(r, f"f{i:04}", i, (i * 37) % 100 or None, (i % 3) or None) for r in ("x", "y", None) for i in range(300)]
        frame = spark.createDataFrame(files, "repo string, path string, seq int, full_size int, min_size int").repartition(6)
        found = sorted(((r["repo"], r["path"], r["form"]) for r in enrich.budget_fold(frame, 4000).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = []
    for repo in ("x", "y", None):
        total = 0
        for r, path, _, full, least in files:
            if r == repo:
                fits = full is not None and total + full <= 4000
                total += full if fits else least or 0
                expected.append((repo, path, "full" if fits else "minimal"))
    assert found == sorted(expected, key=repr)


def test_rows_that_break_rules_are_kept_apart(spark, tmp_path):
    from graphloom.operators import validate

    rows = [("calls", "a", 1), ("calls", None, 1), ("knows", "b", -1), (None, "c", None), ("calls", "a", 1)]
    frame = spark.createDataFrame(rows, "edge_type string, source_node_id string, line_number int")
    path = str(tmp_path / "edges")
    counts = validate.write(frame, validate.RULES["code_edges"], path)
    assert counts == {"rows": 5, "quarantined": 3, "broken_edge_type": 2, "broken_source": 1, "broken_line": 2}
    assert sorted(map(tuple, validate.sound(spark, path).collect())) == [("calls", "a", 1)] * 2
    assert {(r["edge_type"], tuple(r["broken"])) for r in validate.quarantined(spark, path).collect()} == {("calls", ("source",)), ("knows", ("edge_type", "line")), (None, ("edge_type", "line"))}
    empty = validate.write(frame.limit(0), (), str(tmp_path / "none"))
    assert empty == {"rows": 0, "quarantined": 0}
    for table, rules in validate.RULES.items():
        assert rules and len({r.name for r in rules}) == len(rules), table
