import random
import time

from pyspark.sql import functions as F

from graphloom.operators import dead_code, features, graph


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, edge_type string")


def _nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_cycle_is_reached_once(spark, rows):
    found = graph.reachable(_nodes(spark, ["a"]), _edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]))
    assert rows(found) == [("a",), ("b",), ("c",)]


def test_nulls_and_empty_inputs(spark, rows):
    edges = _edges(spark, [("a", None), (None, "b"), ("a", "b"), ("a", "b")])
    assert rows(graph.reachable(_nodes(spark, ["a", None, "a"]), edges)) == [("a",), ("b",)]
    assert rows(graph.reachable(_nodes(spark, []), edges)) == []
    assert rows(graph.reachable(_nodes(spark, ["a"]), _edges(spark, []))) == [("a",)]


def test_only_nodes_are_reached_but_paths_lead_through_others(spark, rows):
    edges = _edges(spark, [("a", "m"), ("m", "b"), ("x", "c")])
    assert rows(graph.reachable(_nodes(spark, ["a", "x"]), edges, nodes=_nodes(spark, ["a", "b", "c"]))) == [("a",), ("b",)]


def test_long_path_is_followed_in_few_tables(spark, rows):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(12)]
    assert len(rows(graph.reachable(_nodes(spark, ["n0"]), _edges(spark, pairs)))) == 13


def test_edges_are_read_without_a_shuffle(spark):
    from graphloom.session import bucketed

    edges = _edges(spark, [("a", "b")] * 3)
    near = bucketed(edges.select("src", "dst"), "edges", "src")
    plan = _nodes(spark, ["a"]).hint("merge").join(near, F.col("node") == F.col("src"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1  # that of the frontier


def test_random_graph_equals_search(spark, rows):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(60)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(70)]
    starts = {"x": {"n0", "n1"}, "y": {"n2"}}
    expected = set()
    for cluster, some in starts.items():
        todo, seen = list(some), set(some)
        while todo:
            a = todo.pop()
            for p, q in pairs:
                if p == a and q not in seen:
                    seen.add(q)
                    todo.append(q)
        expected |= {(cluster, n) for n in seen}
    clusters = spark.createDataFrame([(c, n) for c, some in starts.items() for n in some], "cluster string, node string")
    tagged = features.tag_nodes(clusters, _edges(spark, pairs), _nodes(spark, names))
    assert set(rows(tagged)) == expected
    kinds = dict(rows(features.buckets(_nodes(spark, names), tagged)))
    count = {n: sum((c, n) in expected for c in starts) for n in names}
    assert kinds == {n: ("unmatched", "exclusive", "shared")[count[n]] for n in names}


def test_smallest_feature_wins_and_ties_go_to_the_first(spark, rows):
    membership = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (3, "d"), (4, "d")], "feature int, node string")
    counts = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "feature int, entries int")
    assert rows(features.assign_exclusive(membership, counts)) == [("a", 2), ("b", 1), ("c", 1), ("d", 3)]


def test_dead_code_rules(spark, rows):
    edges = spark.createDataFrame([("f", "f", "calls"), ("a", "b", "calls"), ("e", "i", "imports"), ("e", "u", "calls")], "src string, dst string, edge_type string")
    nodes = _nodes(spark, ["a", "b", "f", "i", "e", "u"])
    reached = _nodes(spark, ["e", "i", "u"])
    found = {n: (r, c) for n, r, c in rows(dead_code.candidates(nodes, edges, reached, _nodes(spark, ["e"])))}
    assert found == {"a": ("no_references", 0.95), "b": ("unreachable", 0.8), "f": ("self_referential", 0.9), "i": ("imported_not_called", 0.7)}


def test_chunks(spark, rows):
    points = spark.createDataFrame([(1, i) for i in range(7)], "feature int, i int")
    sizes = [sum(c == k for *_, c in rows(features.chunks(points, 3, points["i"]))) for k in range(3)]
    assert sizes == [2, 2, 3]


def test_cluster_names(spark, rows):
    made = [
        ("app:list_repos", "http_route", {"url": "/api/repos"}, 0), ("app:get_repo", "http_route", {"url": "/api/repos/{id}"}, 1),
        ("cli:build_all", "cli", {"command": "build all"}, 2), ("w:feed", "websocket", {"url": "/ws/{id}"}, 3), ("m:start", "lifecycle", {"event": "startup"}, 4),
    ]
    points = spark.createDataFrame(made, "node_name string, entry_type string, route_info map<string,string>, ep_seq int")
    clusters = features.cluster_entry_points(points).cache()
    assert {(r["node_name"], r["cluster_key"]) for r in clusters.collect()} == {("app:list_repos", "/api/repos"), ("app:get_repo", "/api/repos"), ("cli:build_all", "build"), ("w:feed", "/ws"), ("m:start", "root")}
    assert rows(features.name_clusters(clusters).select("cluster_idx", "name")) == [(0, "Api Repos"), (1, "Ws"), (2, "Build All"), (3, "Start")]


def _search(starts, pairs):
    """(group, node) by plain search."""
    near, seen = {}, set(starts)
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    todo = list(seen)
    while todo:
        group, node = todo.pop()
        for other in near.get(node, ()):
            if (group, other) not in seen:
                seen.add((group, other))
                todo.append((group, other))
    return sorted(seen, key=repr)


def _count_rounds(monkeypatch):
    rounds, steps = [], graph._steps
    monkeypatch.setattr(graph, "_steps", lambda *a: (rounds.append(1), steps(*a))[1])
    return rounds


def test_deep_chain_and_ring_take_few_rounds(spark, monkeypatch):
    rounds = _count_rounds(monkeypatch)
    n = 10_000
    chain = spark.range(n - 1).selectExpr("concat('n', id) as src", "concat('n', id + 1) as dst")
    assert graph.reachable(_nodes(spark, ["n0"]), chain).count() == n
    assert len(rounds) <= 20
    rounds.clear()
    ring = spark.range(500).selectExpr("concat('n', id) as src", "concat('n', (id + 1) % 500) as dst")
    starts = spark.createDataFrame([("x", "n3"), ("y", "n77"), (None, "n5")], "cluster string, node string")
    assert [tuple(r) for r in graph.reachable(starts, ring, by=("cluster",)).groupBy("cluster").count().orderBy("cluster").collect()] == [(None, 500), ("x", 500), ("y", 500)]
    assert len(rounds) <= 12


def test_walks_stop_where_they_would_be_too_many(spark, rows, monkeypatch):
    """Dense layers on a long chain: squares are refused at once, or after some rounds."""
    rng = random.Random(9)
    layers = [[f"l{i}x{k}" for k in range(6)] for i in range(8)]
    pairs = [(a, b) for one, two in zip(layers, layers[1:], strict=False) for a in one for b in two if rng.random() < 0.6]
    pairs += [(layers[-1][0], "c0")] + [(f"c{i}", f"c{i + 1}") for i in range(25)] + [("c25", layers[0][0]), ("c9", "c9")]
    starts = [("x", layers[0][1]), ("y", "c3"), ("z", "nowhere")]
    frame = spark.createDataFrame(starts, "cluster string, node string")
    for growth in (0.9, 100):
        monkeypatch.setattr(graph, "GROWTH", growth)
        assert sorted(rows(graph.reachable(frame, _edges(spark, pairs), by=("cluster",))), key=repr) == _search(starts, pairs)


def test_many_groups_fill_several_words(spark, rows, monkeypatch):
    rng = random.Random(2)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(60)]
    starts = [(i, f"n{rng.randrange(40)}") for i in range(200)]
    frame = spark.createDataFrame(starts, "cluster long, node string")
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)  # joins shuffle
    monkeypatch.setattr(graph, "GROUPS", 50)
    assert sorted(rows(graph.reachable(frame, _edges(spark, pairs), by=("cluster",))), key=repr) == _search(starts, pairs)
    

def test_maintained_reach_equals_a_new_search(spark, rows):
    rng = random.Random(12)
    for case in range(3):
        pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(45)]
        starts = [(c, f"n{rng.randrange(30)}") for c in "xyz"]
        # edges go and come; a cycle loses what led to it, a start moves
        after = [p for p in pairs if rng.random() < 0.8] + [(f"n{rng.randrange(32)}", f"n{rng.randrange(32)}") for _ in range(4)]
        begins = [*starts[:-1], ("w", "n1")] if case else starts
        frame = lambda s: spark.createDataFrame(s, "cluster string, node string")
        found = graph.maintained(frame(_search(starts, pairs)), _edges(spark, pairs), _edges(spark, after), frame(starts), frame(begins))
        assert sorted(rows(found), key=repr) == _search(begins, after)


def test_cluster_names_of_large_clusters(spark, rows):
    """The work grows with the words, not with their pairs: compared pairwise, this cluster took minutes."""
    kinds = "cluster_idx int, node_name string, entry_type string, route_info map<string,string>, ep_seq int"
    points = spark.range(6000).selectExpr("0 cluster_idx", "concat('m:get_word', id) node_name", "'http_route' entry_type", "map('url', '/') route_info", "cast(id as int) ep_seq")
    few = [(1, "m:get_item_x", "a", {}, 1), (1, "m:item_tail_tail", "a", {}, 2), (2, "m:abc_tail", "a", {}, 1), (2, "m:tail_abc", "a", {}, 2), (2, "m:q", "a", {}, 3), (3, "m:do_it", "a", {}, 1), (3, None, "a", {}, 2), (None, "m:one_two", "a", {}, 1), (None, "m:one_six", "b", {}, 2)]
    began = time.time()
    found = rows(features.name_clusters(points.unionByName(spark.createDataFrame(few, kinds))).select("cluster_idx", "name"))
    assert found == [(0, "Word0"), (1, "Item"), (2, "Abc"), (3, "Do It"), (None, "One")]
    assert time.time() - began < 60


def test_repeated_edges_are_told_apart_for_walks_only(spark, rows, monkeypatch):
    from graphloom.session import bucketed

    written = []
    monkeypatch.setattr(graph, "bucketed", lambda df, label, key, apart=True: written.append((label, apart)) or bucketed(df, label, key, apart))
    shallow = [("a", "b"), ("a", "b"), ("b", "c")]
    assert rows(graph.reachable(_nodes(spark, ["a"]), _edges(spark, shallow))) == [("a",), ("b",), ("c",)]
    assert written == [("edges", False)]
    deep = [(f"n{i}", f"n{i + 1}") for i in range(9)] * 2
    assert len(rows(graph.reachable(_nodes(spark, ["n0"]), _edges(spark, deep)))) == 10
    assert written[1:3] == [("edges", False), ("edges", True)] and len(written) > 3


def test_references_equal_those_of_separate_groupings(spark, rows):
    edges = spark.createDataFrame([("a", "a", "calls"), ("a", "b", "imports"), ("b", "b", None), ("c", "d", "imports"), (None, "e", "inherits"), ("a", None, "calls")], "src string, dst string, edge_type string")
    apart = graph.incoming(edges).join(graph.targets_by_type(edges), "node").select("node", F.col("callers").isNotNull().alias("referenced"), "only_self", "imported", "called")
    assert rows(graph.references(edges).where("node is not null")) == rows(apart)
    plan = dead_code.candidates(_nodes(spark, ["a"]), edges, _nodes(spark, ["a"]), _nodes(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [dst#") == 1 and "count(" not in plan
