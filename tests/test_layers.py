import itertools
import random

from graphloom.operators import graph, layers
from graphloom.session import bucketed


def _frames(spark, names, pairs):
    return spark.createDataFrame([(n,) for n in names], "node string"), spark.createDataFrame(list(pairs), "src string, dst string")


def _brute(names, pairs):
    """Component and layer of every node, by closure and by longest paths over components."""
    reach = {a: {a} for a in names}
    changed = True
    while changed:
        changed = False
        for (a, b), start in itertools.product(pairs, names):
            if a in reach[start] and b not in reach[start]:
                reach[start].add(b)
                changed = True
    component = {a: min(b for b in reach[a] if a in reach[b]) for a in names}
    between = {(component[a], component[b]) for a, b in pairs if component[a] != component[b]}

    def depth(c):
        return max((1 + depth(a) for a, b in between if b == c), default=0)

    return {a: (component[a], depth(component[a])) for a in names}


def test_components_and_layers_of_a_random_graph(spark):
    draw = random.Random(0)
    names = [f"n{i}" for i in range(30)]
    pairs = [(draw.choice(names), draw.choice(names)) for _ in range(36)]
    found = layers.layers(*_frames(spark, names, pairs))
    assert {r["node"]: (r["component"], r["layer"]) for r in found.collect()} == _brute(names, pairs)


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    names = [f"n{i:03}" for i in range(40)]
    pairs = list(itertools.pairwise(names)) + [(names[19], names[10])]
    rounds = []
    spread = graph.spread
    monkeypatch.setattr(graph, "spread", lambda *a: rounds.append(1) or spread(*a))
    found = {r["node"]: r for r in layers.layers(*_frames(spark, names, pairs)).collect()}
    assert [found[n]["component"] for n in names] == [n if not 10 <= i <= 19 else names[10] for i, n in enumerate(names)]
    assert [found[n]["layer"] for n in names] == [i if i < 10 else 10 if i < 20 else i - 9 for i in range(40)]
    assert len(rounds) <= 12  # one of them for the layers


def test_nulls_loops_repeats_and_ends_that_are_no_nodes(spark, rows):
    nodes, edges = _frames(spark, ["a", None, "a", "z"], [("a", "a"), ("a", None), (None, "b"), ("a", "b"), ("a", "b")])
    assert rows(layers.layers(nodes, edges)) == [("a", "a", 0), ("b", "b", 1), ("z", "z", 0)]
    empty = _frames(spark, [], [])
    assert rows(layers.layout(*empty)) == []
    assert rows(layers.strong_components(nodes, empty[1])) == [("a", "a"), ("z", "z")]


def test_places_are_without_gaps_across_tasks(spark):
    frame = spark.createDataFrame([(f"n{i:03}", "c", i % 3, (i * 7) % 5) for i in range(300)], "node string, component string, layer long, mean int")
    got = {r["node"]: (r["layer"], r["place"]) for r in layers.placed(frame, "mean").collect()}
    for layer in range(3):
        order = sorted((f"n{i:03}" for i in range(300) if i % 3 == layer), key=lambda n: ((int(n[1:]) * 7) % 5, n))
        assert [got[n] for n in order] == [(layer, k) for k in range(100)]


def test_layout_gives_top_left_corners(spark, rows):
    nodes, edges = _frames(spark, ["a", "b", "c", "d"], [("a", "d"), ("b", "c")])
    found = layers.layout(nodes, edges, layers.Sizes(10, 4, 2, 3)).select("node", "x", "y")
    assert rows(found) == [("a", 0, 0), ("b", 12, 0), ("c", 12, 7), ("d", 0, 7)]
    found = layers.layout(nodes, edges, layers.Sizes(10, 4, 2, 3), sweeps=0, down=False).select("node", "x", "y")
    assert rows(found) == [("a", 0, 0), ("b", 0, 6), ("c", 13, 0), ("d", 13, 6)]


def test_edges_are_written_once_for_all_steps_of_a_layout(spark, rows, monkeypatch):
    written = []
    for module in (graph, layers):
        monkeypatch.setattr(module, "bucketed", lambda df, label, *a: written.append(label) or bucketed(df, label, *a), raising=False)
    nodes, edges = _frames(spark, ["a", "b", "c"], [("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "c")])
    assert rows(layers.layout(nodes, edges, layers.Sizes(10, 4, 2, 3)).select("node", "layer", "x")) == [("a", 0, 0), ("b", 1, 0), ("c", 2, 0)]
    assert written == ["pairs"]


def test_layers_of_dense_random_graphs(spark):
    for seed, (many, count) in enumerate([(12, 10), (12, 16), (15, 40)]):
        draw = random.Random(seed)
        names = [f"n{i}" for i in range(many)]
        pairs = [(draw.choice(names), draw.choice(names)) for _ in range(count)]
        found = layers.layers(*_frames(spark, names, pairs))
        assert {r["node"]: (r["component"], r["layer"]) for r in found.collect()} == _brute(names, pairs)


def test_buckets_are_told_apart_and_merged_without_a_sort(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("a", None), ("a", "b"), (None, "c"), (None, "c"), ("a", None), ("b", "b")], "src string, dst string")
    near = bucketed(edges, "edges", "src")
    assert rows(near) == rows(edges.distinct())
    assert near.count() == 5 - 1 and bucketed(edges, "edges", "src", False).count() == 7
    plan = spark.createDataFrame([("a",)], "src string").hint("merge").join(near, "src")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1  # that of the other side


def test_tails_of_cycles_are_trimmed_at_once(spark, monkeypatch):
    names = [f"n{i:02}" for i in range(60)]
    pairs = [*itertools.pairwise(names), (names[34], names[30])]
    rounds, spread = [], graph.spread
    monkeypatch.setattr(graph, "spread", lambda *a: rounds.append(a[1].count()) or spread(*a))
    found = {r["node"]: r["component"] for r in layers.strong_components(*_frames(spark, names, pairs)).collect()}
    assert [found[n] for n in names] == [names[30] if 30 <= i <= 34 else n for i, n in enumerate(names)]
    assert rounds == [5]  # the edges of the cycle, and no other
