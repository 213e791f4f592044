import difflib

from graphloom.operators import diff, enrich, resolve, serve
from graphloom.plans import analysis
from graphloom.sources import files, parse
from graphloom.streaming import progress

APP = '''import os
from pkg.util import helper

class Service:
    """Serves."""

    def __init__(self):
        self.run()

    def run(self):
        return helper()

@app.get("/api/items/{id}")
def get_item(id: int):
    import json
    return Service()

@app.websocket("/ws")
async def feed(ws):
    pass

def unused():
    return os.path.join("a")

if __name__ == "__main__":
    get_item(1)
'''


def _files(spark, some):
    return spark.createDataFrame(list(some.items()), "path string, content string")


def test_parse(spark, rows):
    parsed = parse.parse(_files(spark, {"app.py": APP, "bad.py": "def (", "x.rs": "fn main() {}", "none.py": None})).cache()
    assert {r["path"]: len(r["errors"]) for r in parsed.collect()} == {"app.py": 0, "bad.py": 1, "x.rs": 0, "none.py": 0}
    kinds = {(r["qualified_name"], r["node_type"]) for r in parse.nodes(parsed).collect()}
    assert kinds == {("app:Service", "class"), ("app:Service.__init__", "method"), ("app:Service.run", "method"), ("app:get_item", "function"), ("app:feed", "function"), ("app:unused", "function")}
    entries = {(r["node_name"], r["entry_type"]) for r in parse.entry_points(parsed).collect()}
    assert entries == {("app:get_item", "http_route"), ("app:feed", "websocket"), ("app:__main__", "main")}
    imports = {(r["module_path"], tuple(r["imported_names"]), r["lazy"]) for r in parse.imports(parsed).collect()}
    assert imports == {("os", (), False), ("pkg.util", ("helper",), False), ("json", (), True)}
    calls = {(r["source"], r["target"], r["instantiation"]) for r in parse.edges(parsed).collect() if r["edge_type"] == "calls"}
    assert ("app:get_item", "Service", True) in calls and ("app:Service.__init__", "self.run", False) in calls


def _calls(spark, code):
    found = parse.edges(parse.parse(_files(spark, {"m.py": code})))
    return {(r["source"], r["target"], r["instantiation"], r["module_level"]) for r in found.where("edge_type = 'calls'").collect()}


def test_calls(spark):
    assert _calls(spark, "Service().run()\n") == {("m", "Service", True, True)}  # a call's result has no name
    assert _calls(spark, "d['k']()\nmodels.User()\nFoo.create()\nURL()\n") == {("m", "models.User", False, True), ("m", "Foo.create", True, True), ("m", "URL", False, True)}
    assert _calls(spark, "@deco(make())\ndef f(a=one(), *, b: two() = 3):\n    return inner()\n") == {("m:f", "one", False, False), ("m:f", "two", False, False), ("m:f", "inner", False, False)}
    assert _calls(spark, "class A(base()):\n    x = made()\n    def g(self):\n        self.h()\n") == {("m", "base", False, True), ("m", "made", False, True), ("m:A.g", "self.h", False, False)}


def test_signature_parts(spark):
    found = parse.nodes(parse.parse(_files(spark, {"m.py": "def f(a: int) -> str:\n    class K:\n        def g(self):\n            pass\n"}))).collect()
    assert {(r["qualified_name"], r["node_type"], r["returns"]) for r in found} == {("m:f", "function", "str"), ("m:f.<locals>.K", "class", None), ("m:f.<locals>.K.g", "function", None)}


def test_imports_lead_through_modules(spark):
    """A module that is imported is alive with all that its file holds, and so is what a module itself calls."""
    some = {
        "a/boot.py": "import pkg.util\n\ndef setup():\n    pass\n\nsetup()\n\nif __name__ == '__main__':\n    pass\n", "pkg/util.py": "def helper():\n    return deeper()\n\ndef deeper():\n    pass\n", "pkg/alone.py": "def lonely():\n    pass\n",
        "a/rel.py": "from .sib import thing, nothing\nfrom . import gone\nimport os\n\ndef use():\n    import a.lazy\n    return thing()\n", "a/sib.py": "def thing():\n    pass\n", "z/sib.py": "def thing():\n    pass\n", "a/lazy.py": "from pkg.util import *\n\ndef later():\n    pass\n",
    }
    a = analysis.analyze_sources(_files(spark, some))
    dead = {r["node"]: r["reason"] for r in a.dead.collect()}
    assert not {"pkg.util:helper", "pkg.util:deeper", "a.boot:setup"} & set(dead) and dead["pkg.alone:lonely"] == "no_references"
    edges = {(r["src"], r["dst"]) for r in a.edges.where("edge_type = 'imports'").collect()}
    assert ("a.rel:use", "a.sib:thing") in edges and ("a.rel:use", "a.sib") in edges and ("a.rel:use", "z.sib:thing") not in edges
    assert ("a.rel:use", "a.lazy") in edges and ("a.lazy:later", "pkg.util") in edges and ("a.boot:setup", "pkg.util") in edges
    assert not any("os" == dst for _, dst in edges)


def test_entry_points_and_nodes_of_one_name_count_once(spark):
    code = "@app.get('/a')\ndef f():\n    pass\n\n@app.get('/b')\ndef f():\n    pass\n"
    nodes, _, _, entries = analysis.call_graph(parse.parse(_files(spark, {"m.py": code})))
    assert [(r["node"], r["line_start"]) for r in nodes.collect()] == [("m:f", 2)]
    assert [(r["node_name"], r["route_info"]["url"], r["fqn"]) for r in entries.collect()] == [("m:f", "/a", "m:f")]


def test_a_failing_listener_changes_nothing(spark):
    def listener(stage, share):
        raise RuntimeError(stage)

    assert analysis.analyze_sources(_files(spark, {"m.py": "def f():\n    pass\n"}), listener).nodes.count() == 1


def test_import_files(spark, rows):
    some = {"a/b/c.py": "from . import d, other\nfrom ..x import y\nimport a.b.d.e\nimport zlib\n", "a/b/d.py": "", "a/x.py": "", "a/b/__init__.py": ""}
    parsed = parse.parse(_files(spark, some))
    found = {r["target"] for r in parse.import_files(parse.imports(parsed), _files(spark, some)).collect()}
    assert found == {"a/b/__init__.py", "a/x.py", "a/b/d.py"}


def test_analysis(spark):
    told = []
    a = analysis.analyze_sources(_files(spark, {"app.py": APP, "pkg/util.py": "def helper():\n    return 1\n", "pkg/other.py": "def lonely():\n    pass\n"}), lambda *x: told.append(x))
    tagged = {r["node"] for r in a.tagged.collect()}
    assert "app:get_item" in tagged and "app:Service" in tagged
    dead = {r["node"]: r["reason"] for r in a.dead.collect()}
    assert dead["app:unused"] == "no_references" and dead["pkg.other:lonely"] == "no_references"
    assert told[0][0] == "code_parsing" and told[-1] == ("done", 100.0)
    assert dict(map(tuple, analysis.statistics(a).collect()))["files"] == 3


def test_discover_and_persist(spark, tmp_path):
    for name, text in {"a/app.py": APP, "node_modules/x.py": "1", ".hidden/y.py": "1", "empty.py": "", "z.TXT": "a", "latin.py": None}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes("# caf\xe9".encode("latin-1") if text is None else text.encode())
    root = str(tmp_path / "repo")
    assert [r["path"] for r in files.discover(spark, root).collect()] == ["a/app.py", "latin.py"]
    texts = {r["path"]: r["content"] for r in files.sources(spark, root).collect()}
    assert texts["latin.py"] == "# caf\xe9" and texts["a/app.py"] == APP
    a = analysis.analyze(spark, root)
    analysis.persist(a, str(tmp_path / "out"), "r", "s1")
    saved = files.load(spark, str(tmp_path / "out"), "code_nodes")
    assert saved.where("snapshot_id = 's1'").count() == a.nodes.count()
    assert {r["name"] for r in serve.dead_list(saved).collect()} >= {"unused"}


def test_verify_adds_inferred_edges_once(spark):
    nodes = spark.createDataFrame([("m:a", "a", "function", "return registry[x]()"), ("m:b", "b", "function", "pass")], "node string, name string, node_type string, source_code string")
    edges = spark.createDataFrame([], "src string, dst string, edge_type string")

    def client(prompt):
        return '```json\n{"calls": [{"target": "b", "mechanism": "registry", "confidence": 0.9}, {"target": "a", "confidence": 0.1}]}\n```'

    found, rounds = analysis.verify(nodes, edges, client)
    assert [tuple(r) for r in found.collect()] == [("m:a", "m:b", "calls")] and rounds == 2


def test_client_failures_stay_with_their_item(spark, rows):
    items = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, None)], "id int, prompt string")

    def client(text):
        if text == "boom":
            raise RuntimeError
        return text.upper()

    assert rows(enrich.ask(items, client)) == [(1, "OK"), (2, None), (3, None)]
    assert {r["id"]: r["answer"] is not None for r in enrich.ask_json(items, lambda t: '{"a": 1}' if t == "ok" else "[1]").collect()} == {1: True, 2: False, 3: False}


def test_manifest_diff(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "9")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "5"), ("e", "3"), ("f", "7")], "path string, content_hash string")
    changes = diff.manifest_diff(old, new)
    assert rows(changes) == [("b", "modified", None), ("d", "deleted", None), ("e", "renamed", "c"), ("f", "added", None)]
    assert rows(diff.counts(changes)) == [(1, 1, 1, 1, 4, True)]
    assert rows(diff.changed_paths(changes)) == [("b",), ("c",), ("d",), ("e",), ("f",)]


def test_budget_fold(spark):
    made = spark.createDataFrame([("r", "x", 0, 40, 5), ("r", "y", 1, 70, 5), ("r", "z", 2, 50, 5)], "repo string, path string, seq int, full_size int, min_size int")
    assert {r["path"]: r["form"] for r in enrich.budget_fold(made, 100).collect()} == {"x": "full", "y": "minimal", "z": "full"}


def test_fuzzy_match(spark):
    steps = spark.createDataFrame([(1, "f", "load"), (2, "f", "laod_all"), (3, "f", "zzz"), (4, "g", "load")], "step_id int, file string, function string")
    names = spark.createDataFrame([("f", "load", 1, 2), ("f", "load_all", 3, 4)], "file string, name string, line_start int, line_end int")
    assert {r["step_id"]: r["matched"] for r in enrich.match_signatures(steps, names).collect()} == {1: "load", 2: "load_all", 3: None, 4: None}


def test_parsing_is_dealt(spark):
    """Files that one task reads are parsed by several."""
    made = spark.range(40).selectExpr("concat('pkg/m', id, '.py') path", "concat('def f', id, '(): pass') content").coalesce(1)
    found = parse.nodes(parse.parse(made)).selectExpr("name", "spark_partition_id() task").collect()
    assert {r["name"] for r in found} == {f"f{i}" for i in range(40)}
    assert len({r["task"] for r in found}) == 4


def test_fuzzy_match_in_lists(spark, monkeypatch):
    """Names in short lists, functions in parts, copies of steps and names that are null: the result is difflib's over all names."""
    monkeypatch.setattr(enrich, "NAMES", 2)
    monkeypatch.setattr(enrich, "DEALS", 3)
    known = ["load", "load_all", "laod", "save", "save_all", "savings", ""]
    asked = ["lod", "loda_all", "sav", "aves", "zzz", "", None, "load_al"] * 3
    steps = spark.createDataFrame([(i, "f", x) for i, x in enumerate(asked)], "step_id int, file string, function string")
    names = spark.createDataFrame([("f", x, 10 * i + k, 9) for i, x in enumerate(known) for k in (2, 1)] + [("f", None, 1, 1)], "file string, name string, line_start int, line_end int")
    near = {i: (difflib.get_close_matches(x or "", known, 1, 0.6) or [None])[0] for i, x in enumerate(asked)}
    expected = {i: (m, None if m is None else 10 * known.index(m) + 1) for i, m in near.items()}
    assert {r["step_id"]: (r["matched"], r["line_start"]) for r in enrich.match_signatures(steps, names).collect()} == expected


def test_class_members_and_entry_points(spark, rows):
    nodes = spark.createDataFrame([("m:A.f", "f", "m.py", "m.py::f", 1), ("m:g", "g", "m.py", "m.py::g", 2)], "qualified_name string, name string, file_path string, fqn string, seq int")
    points = spark.createDataFrame([("m:A.f",), ("x:g",), ("no",)], "node_name string")
    assert rows(resolve.resolve_entry_points(points, nodes)) == [("m:A.f", "m.py::f"), ("no", None), ("x:g", "m.py::g")]


def test_progress(spark, tmp_path):
    events = [("r", "running", 120.0, 1, 1), ("r", "completed", 100.0, 2, 2), ("s", "running", 5.0, 1, 3)]
    spark.createDataFrame(events, "repo_id string, status string, progress double, ts int, seq int").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("repo_id string, status string, progress double, ts int, seq int").parquet(str(tmp_path / "e"))
    got = []
    progress.follow(stream, "r", got.append, available_now=True).awaitTermination()
    assert got[-1]["status"] == "completed" and got[-1]["progress"] == 100.0
    got, folder = [], str(tmp_path / "checkpoint")
    query = progress.follow(stream, "r", got.append, interval="0 seconds", checkpoint=folder)
    assert query.awaitTermination(60) and got[-1]["status"] == "completed"  # it ends itself, even in its first batch
    assert [progress.may_start(True, False, None), progress.may_start(False, False, None), progress.may_start(True, True, None), progress.may_start(True, False, "zz")] == [202, 404, 409, 400]


def test_repository_tables(spark):
    from datetime import datetime

    one = serve.new_repository(spark, "https://x.org/a", "/a", datetime(2024, 1, 1))
    two = serve.new_repository(spark, None, "/b", datetime(2024, 1, 2))
    repos = one.unionByName(two)
    ids = [r["id"] for r in serve.repository_list(repos).collect()]
    assert ids[0] == two.first()["id"] and len(set(ids)) == 2
    snapshots = spark.createDataFrame([("s1", ids[0]), ("s2", ids[1])], "id string, repo_id string")
    rest = {"features": spark.createDataFrame([("f", ids[0])], "id string, repo_id string"), "code_nodes": spark.createDataFrame([("n1", "s1"), ("n2", "s2")], "id string, snapshot_id string"), "code_edges": spark.createDataFrame([("e", "s1")], "id string, snapshot_id string")}
    left = serve.delete_repository({"repositories": repos, "analysis_snapshots": snapshots, **rest}, ids[0])
    assert {name: table.count() for name, table in left.items()} == {"repositories": 1, "analysis_snapshots": 1, "features": 0, "code_nodes": 1, "code_edges": 0}
    features = spark.createDataFrame([("f", "a", None), ("g", "b", "x")], "id string, name string, description string")
    changed = serve.update_feature(features, spark.createDataFrame([("f", None, "new")], "id string, name string, description string"))
    assert sorted(map(tuple, changed.collect())) == [("f", "a", "new"), ("g", "b", "x")]


def test_flow_steps_without_a_place_come_last(spark):
    nodes = spark.createDataFrame([("a", "x", "f", None), ("b", "y", "f", 2), ("c", "z", "f", 1), ("d", "z", "g", 1), ("e", "w", None, 0)], "id string, name string, feature_id string, flow_order int")
    nodes = nodes.selectExpr("*", "cast(null as string) as flow_description", "cast(null as string) as description")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "d"), (None, "b")], "source_node_id string, target_node_id string")
    assert [(r["id"], r["order"], r["calls_next"]) for r in serve.flow(nodes, edges, "f").collect()] == [("c", 1, []), ("b", 2, []), ("a", 0, ["b"])]


def test_views_of_nothing(spark):
    none = spark.createDataFrame([], "id string, repo_id string, status string, analyzed_at timestamp")
    nodes = spark.createDataFrame([], "id string, snapshot_id string, node_type string, feature_id string")
    edges = spark.createDataFrame([], "id string, snapshot_id string, edge_type string")
    features_ = spark.createDataFrame([("1", "r", "n", "c")], "id string, repo_id string, name string, color string")
    assert [v.count() for v in serve.graph_view("r", none, nodes, edges, features_).values()] == [0, 0, 0]


def test_pending_snapshots(spark):
    from datetime import datetime

    row = serve.new_snapshot(spark, "r", "abc", datetime(2024, 1, 1)).first()
    assert (row["repo_id"], row["status"], row["analyzed_at"]) == ("r", "pending", None) and len(row["id"]) == 64


def test_repeated_ids_do_not_multiply_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", None)], "src string, dst string")
    ids = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "fqn string, id string")
    assert [tuple(r) for r in resolve.resolve_keys(edges, ids).select("source_id", "target_id").collect()] == [("1", "3")]


def test_clients_are_asked_in_threads(spark):
    import time

    def slow(text):
        time.sleep(0.2)
        return text

    items = spark.createDataFrame([(i, "x") for i in range(20)], "id int, prompt string").coalesce(1)
    began = time.time()
    assert enrich.ask(items, slow).where("answer = 'x'").count() == 20
    assert time.time() - began < 3.5  # one by one it would be four seconds


def test_call_graph_broadcasts_no_rows(spark):
    """Sizes of files, which underrate rows, must not make the call graph's joins broadcasts, and its parts are built once."""
    made = spark.range(8).selectExpr("concat('pkg/m', id, '.py') path", "concat('from .m', id + 1, ' import f', id + 1, '\\ndef f', id, '():\\n    f', id + 1, '()\\n') content")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    spark.conf.set(keys[0], "1g")
    spark.conf.set(keys[1], "-1")
    try:
        _, edges, contained, _ = analysis.call_graph(parse.parse(made))
        plan = edges.select("src", "dst").union(contained.select("src", "dst"))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") < 20
    assert edges.where("dst is not null").count() == 7 * 3
