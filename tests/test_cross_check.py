"""Cross-checks of features, names and suggestions, with clients that answer from a script."""

import json

from graphloom.operators import features
from graphloom.plans import analysis, cross_check


def _features(spark):
    groups = spark.createDataFrame([(0, "apart"), (1, "tight"), (2, "single"), (3, "bare")], "feature int, name string")
    points = [(0, 0, "m:a", "a"), (0, 1, "m:b", "b"), (1, 2, "m:c", "c"), (1, 3, "m:d", "d"), (2, 4, "m:e", "e"), (2, 5, "m:none", None)]
    points = spark.createDataFrame(points, "feature int, ep_seq int, node_name string, start string")
    members = spark.createDataFrame([(0, n) for n in "axby"] + [(1, n) for n in "cdxy"] + [(2, "e")], "feature int, node string")
    links = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "d"), ("d", "c"), ("c", "x")], "src string, dst string")
    return groups, points, members, links


def test_only_splits_that_the_graph_allows_count(spark, tmp_path):
    log = tmp_path / "asked"
    log.write_text("")

    def client(prompt):
        with open(log, "a") as file:
            file.write("x" if "apart" in prompt else "-")
        if "apart: starts at m:a, m:b; holds a, b, x, y" not in prompt or log.read_text().count("x") > 1:
            return "no object"
        names = ["apart", "tight", "single", "gone"]
        return json.dumps({"features": [{"name": n, "valid": False, "reason": "r", "suggested_split": ["p", "q"]} for n in names] + [{"name": "gone", "valid": False}, {"name": "bare", "valid": True}, {"name": "bare"}]})

    found = cross_check.cross_check(*_features(spark), client, size=2)
    assert (found.rounds, found.converged) == (2, True)
    rows = sorted((r["round"], r["type"], r["feature"] if r["feature"] is not None else -1, r["from_feature"], r["to_feature"], r["reason"]) for r in found.changes.collect())
    # tight's entry points reach the same nodes, single has one that is a node, gone isn't there
    assert rows == [(1, "review", -1, "gone", "", ""), (1, "split", 0, "apart", "p", "r"), (1, "split", 0, "apart", "q", "r")]
    # two batches of two features; the second round asks the readable batch again, and the unreadable ones twice a round
    assert log.read_text().count("-") == 4


def test_rounds_end_without_agreement_and_without_features(spark):
    groups, points, members, links = _features(spark)
    always = lambda prompt: json.dumps({"features": [{"name": "bare", "valid": False, "suggested_split": []}]})
    found = cross_check.cross_check(groups, points, members, links, always, rounds=2)
    assert (found.rounds, found.converged) == (2, False)
    assert sorted((r["round"], r["type"], r["feature"]) for r in found.changes.collect()) == [(1, "review", 3), (2, "review", 3)]

    def never(prompt):
        raise AssertionError("nobody is to be asked")

    none = cross_check.cross_check(groups.limit(0), points.limit(0), members.limit(0), links.limit(0), never)
    assert (none.rounds, none.converged, none.changes.count()) == (1, True, 0)
    assert cross_check.cross_check(groups, points, members, links, lambda prompt: None)[1:] == (1, True)


def test_prompts_hold_a_batch_and_few_nodes(spark):
    groups = spark.createDataFrame([(i, f"f{i}") for i in range(5)], "feature int, name string")
    members = spark.createDataFrame([(0, f"n{i:03}") for i in range(40)] * 2, "feature int, node string")
    points = spark.createDataFrame([], "feature int, ep_seq int, node_name string, start string")
    prompts = {r["id"]: r["prompt"] for r in cross_check.batched_prompts(cross_check.described(groups, points, members), 2).collect()}
    assert sorted(prompts) == [0, 1, 2]
    assert "n014" in prompts[0] and "n015" not in prompts[0] and "f1: starts at ; holds \n" in prompts[0] + "\n" and "f2" not in prompts[0]


def test_clusters_take_the_names_of_a_client(spark):
    named = spark.createDataFrame([(0, "A", "old"), (1, "B", "old"), (2, "C", None)], "cluster_idx int, name string, description string")
    points = spark.createDataFrame([(0, 1, "m:a", {"method": "GET", "url": "/a"}), (0, 0, "m:z", None), (1, 2, "m:b", {}), (2, 3, "m:c", {})], "cluster_idx int, ep_seq int, node_name string, route_info map<string,string>")

    def client(prompt):
        if prompt.endswith("m:z\nm:a at GET /a"):
            return '{"name": "Letters", "description": "new"}'
        return '{"name": "Only"}' if prompt.endswith("m:b") else '{"name": ""}'

    found = cross_check.renamed(named, points, client)
    assert sorted(tuple(r) for r in found.select("cluster_idx", "name", "description").collect()) == [(0, "Letters", "new"), (1, "Only", "old"), (2, "C", None)]
    assert found.columns == named.columns


def test_suggestions_for_code_without_a_feature(spark):
    nodes = [("m:load", "load", "src/orders/io.py", "def load"), ("m:save", "save", "src/x.py", "def save"), ("m:K", "K", "src/x.py", None), ("m:old", "old", "src/orders.py", "def old"), ("m:odd", "odd", "a/b.ts", "def odd"), ("m:mute", "mute", "src/x.py", "")]
    nodes = spark.createDataFrame([(*n, i) for i, n in enumerate(nodes)], "node string, name string, file_path string, source_code string, seq int")
    groups = spark.createDataFrame([(0, "orders_list"), (1, "user_orders"), (2, "User_Login")], "feature int, name string")
    said = {
        "load": {"classification": "feature", "reason": "reads"}, "save": {"classification": "feature", "suggested_owner": "User Login"}, "K": {"classification": "constant", "reason": "value"},
        "old": {"classification": "dead_code", "suggested_owner": "nobody"}, "odd": {"classification": "other", "suggested_owner": "m:lo"},
    }

    def client(prompt):
        name = prompt.split("Name: ")[1].split("\n")[0]
        return json.dumps(said[name]) if name in said else None

    unmatched = nodes.select("node").union(nodes.select("node")).union(spark.createDataFrame([("gone",), (None,)], "node string"))
    found = {r["node"]: tuple(r)[1:] for r in cross_check.suggest(nodes, unmatched, groups, client).collect()}
    assert found == {
        "m:load": ("orders_list", "feature", "reads", 0.7), "m:save": ("User_Login", "feature", "", 0.7), "m:K": ("__structural__", "constant", "value", 0.6),
        "m:old": ("", "dead_code", "", 0.3), "m:odd": ("m:lo", "other", "", 0.7),
    }
    assert cross_check.suggest(nodes, unmatched.limit(0), groups, client).count() == 0


def test_listed_nodes_belong_to_their_feature(spark, rows):
    reach = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, None)], "feature int, node string")
    listed = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "z"), (2, "w"), (3, "q")], "feature int, node string")
    counts = spark.createDataFrame([(1, 0), (2, 1)], "feature int, entries int")
    # feature 1 lists two and starts nowhere, 2 lists three and starts once
    assert rows(features.assign_exclusive(reach, counts, listed)) == [("a", 1), ("b", 1), ("q", 3), ("w", 2), ("x", 1), ("y", 1), ("z", 2)]
    assert rows(features.assign_exclusive(reach, counts, listed.limit(0))) == [("a", 1), ("b", 1)]


def test_an_analysis_with_a_client(spark):
    code = {"app.py": "from fastapi import FastAPI\napp = FastAPI()\n\n@app.get('/api/a/one')\ndef one():\n    return help_one()\n\n@app.get('/api/a/two')\ndef two():\n    return 2\n\ndef help_one():\n    return 1\n"}
    sources = spark.createDataFrame(list(code.items()), "path string, content string")

    def client(prompt):
        if "Name the feature" in prompt:
            return '{"name": "Numbers", "description": "counts"}'
        wrong = "Numbers: " in prompt
        return json.dumps({"features": [{"name": "Numbers", "valid": not wrong, "suggested_split": ["First", "Second"] if wrong else None}]})

    found = analysis.analyze_sources(sources, client=client)
    names = {r["idx"]: r["name"] for r in found.features.collect()}
    assert sorted(names.values()) == ["First", "Second"]
    owner = {r["node"]: names[r["feature"]] for r in found.assigned.collect()}
    assert owner["app:one"] == owner["app:help_one"] == "First" and owner["app:two"] == "Second"
