"""Vector codes, the Jaccard join and importance resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import hot, importance, set_join, vector_codes
from tests.llm.test_pairs import _collection

# ---- vector codes ----


def _brute_codes(rows, parts, entries, rounds):
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max(Counter(len(v) for *_, v in kept).items(), key=lambda x: (x[1], x[0]))[0]
    usual = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in kept if len(v) == dims]
    usual.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    cuts = [len(c) for c in np.array_split(range(dims), parts)]
    spans = [(sum(cuts[:p]), sum(cuts[: p + 1])) for p in range(parts)]
    books = [[v[a:b] for *_, v in usual[:entries]] for a, b in spans]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(spans):
            groups = {}
            for *_, v in usual:
                groups.setdefault(nearest(books[p], v[a:b])[1], []).append(v[a:b])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = []
    for i, label, v in usual:
        found = [nearest(books[p], v[a:b]) for p, (a, b) in enumerate(spans)]
        coded.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    coded += [(i, label, None, None) for i, label, v in kept if len(v) != dims]
    sums = {}
    for _, label, _, e in coded:
        sums[label] = sums.get(label, 0) + (e or 0)
    return sorted(((i, code, e, sums[label], digest) for i, label, code, e in coded), key=repr)


def _vectors(n, dims, seed):
    rng = random.Random(seed)
    f = lambda x: float(np.float32(x))
    rows = [(i, rng.choice((None, 1, 2, 2, 2)), [f(rng.gauss(0, 1) * (i % 3)) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, 3, [f(0.25)] * dims) for i in range(5)] + [(n + 9, 3, [f(-1.5)] * dims)] * 2  # ties, repeated rows
    rows += [(3, 1, rows[7][2]), (None, 1, rows[8][2]), (n + 10, 1, None), (n + 11, 1, [None] * dims), (n + 12, 1, [math.nan] * dims), (n + 13, 1, [math.inf] * dims)]
    return rows


@pytest.mark.parametrize(("dims", "parts", "entries", "keys"), [(8, 4, 16, 5), (10, 4, 200, 200_000)])
def test_codes_equal_brute_force(spark, monkeypatch, dims, parts, entries, keys):
    monkeypatch.setattr(hot, "BROADCAST_KEYS", keys if keys > 100 else 1)
    rows = [*_vectors(150, dims, 3), (500, 7, [1.0]), (501, None, [])]
    frame = spark.createDataFrame([(i, v, label, "x", 0) for i, label, v in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    found = vector_codes.encode(frame, parts=parts, entries=entries)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == _brute_codes(rows, parts, entries, 2)


def test_codes_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    assert vector_codes.encode(spark.createDataFrame([], kinds)).collect() == []
    assert vector_codes.encode(spark.createDataFrame([(1, None, 1)], kinds)).collect() == []
    (empty,) = vector_codes.encode(spark.createDataFrame([(1, [], 1)], kinds)).collect()
    assert empty["code"] is None and empty["error"] is None
    huge = vector_codes.encode(spark.createDataFrame([(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, None)], kinds), entries=1, rounds=0).collect()
    assert all(0 <= r["error"] <= 2**63 - 1 and 0 <= r["label_error"] <= 2**63 - 1 for r in huge)


def test_annulus_is_exact_and_prunes():
    rng = np.random.default_rng(5)
    entries, rows = ((rng.normal(size=(n, 4)) * rng.uniform(50, 2000, (n, 1))).astype(np.int64) for n in (64, 500))  # of many norms
    entries[10], rows[0] = entries[3], entries[3]  # a tie goes to the lower index
    book, seen = vector_codes.Book(entries), []
    evaluated = book._evaluated
    book._evaluated = lambda r, a, b: (seen.append(int((b - a).sum())), evaluated(r, a, b))[1]
    index, distance = book.nearest(rows)
    full = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
    assert (distance == full.min(1)).all() and (index == full.argmin(1)).all() and index[0] == 3
    assert sum(seen) < 0.6 * full.size


# ---- Jaccard join ----


def _brute_join(docs, num=80):
    sets = []
    for i, t in docs:
        ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append((i, {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()))
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= num * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), None if i is None else least[root(k)]) for k, (i, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("rounds", "split", "boundary"), [(2, 500, None), (0, 3, 0), (2, 3, 20)])
def test_join_equals_brute_force(spark, monkeypatch, rounds, split, boundary):
    monkeypatch.setattr(set_join, "ROUNDS", rounds)
    monkeypatch.setattr(set_join, "SPLIT", split)
    if boundary is not None:  # all by lists, or subsets up to 20 tokens
        monkeypatch.setattr(set_join, "_boundary", lambda *a: boundary)
        monkeypatch.setattr(hot, "BROADCAST_KEYS", 5)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(16)]
    short = []
    for _ in range(120):  # near copies of short texts, of different lengths
        ws = base[: rng.randint(5, 16)]
        if rng.random() < 0.5:
            ws[rng.randrange(len(ws))] = f"v{rng.randrange(4)}"
        short.append(" ".join(ws))
    docs = _collection(300, seed=6) + [(1000 + k, t) for k, t in enumerate(short)]
    docs += [docs[20], (None, docs[20][1]), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, "s", "x") for i, t in docs], "doc_id long, text string, n int, digest string, token string").repartition(7)
    found = set_join.join(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == _brute_join(docs)


@pytest.mark.parametrize("threshold", [(80, 100), (50, 100), (9, 10)])
def test_join_bounds(threshold):
    bounds = set_join.Bounds(threshold)
    for s in range(1, 60):
        for t in range(s, 60):
            links = [c for c in range(s + 1) if threshold[1] * c >= threshold[0] * (s + t - c)]
            assert bounds.shared(s, t) == (links[0] if links else bounds.shared(s, t))
            if links:
                c = links[0]
                assert s >= bounds.partner(t) and c >= bounds.partner(t)
                assert s + t <= bounds.room(c) and c in bounds.subset_sizes(s) and c in bounds.subset_sizes(t)
                common = min(bounds.screened(s)[0] - (s - c), bounds.screened(t)[0] - (t - c))
                assert common >= max(bounds.screened(s)[1], bounds.screened(t)[1])


def test_screen_drops_texts_without_partner(spark):
    rng = random.Random(1)
    passage = [f"p{k}" for k in range(60)]
    docs = [(i, " ".join([f"w{rng.randrange(10**9)}" for _ in range(300)] + passage)) for i in range(60)]
    docs += [(100, docs[0][1] + " and more")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    heads = set_join._heads(frame, "doc_id", "text").withColumnRenamed("doc", "cid")
    classes = heads.selectExpr("cid", "cid as doc", "n", "digest", "owner")
    assert sorted(r["doc"] for r in set_join._survivors(frame, "doc_id", "text", classes, set_join.Bounds((80, 100))).collect()) == [0, 100]
    found = {r["doc_id"]: r["component_id"] for r in set_join.join(frame).collect()}
    assert found == {i: 0 if i == 100 else i for i, _ in docs}


def test_join_of_an_empty_table(spark):
    assert set_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- importance resampling ----


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def _brute_importance(docs, target, longest, buckets, percent, least):
    def features(t):
        ws = _words(t)
        return [" ".join(ws[k : k + n]) for n in range(1, longest + 1) for k in range(len(ws) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, features(x)))
    for x in target:
        t.update(map(bucket, features(x)))
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in s}
    rows = []
    for i, x in docs:
        fs = features(x)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(x)) >= least))
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    draw = percent * len(order) // 100
    out = [(*r[:4], k + 1 if k < draw else None) for k, r in enumerate(order)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("longest", "buckets", "percent"), [(1, 10_000, 10), (3, 97, 60), (2, 10_000, 100)])
def test_resampling_equals_brute_force(spark, longest, buckets, percent):
    rng = random.Random(longest)
    vocabulary = [f"{a}{b}" for a in ("Ka", "lo", "mé", "日本", "7") for b in ("n", "S", "ria", "x9")] + ["w" * 3000]
    docs = [(i, rng.choice((" ", "  ", "-", "\n")).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 70)))) for i in range(200)]
    docs += [(300, None), (301, ""), (302, "..."), (None, docs[7][1] * 3), (303, "long word " * 30_000), docs[11], docs[11], (12, docs[13][1])]
    target = ["loria mén loria lon", None, "", "7x9 " * 50]
    frame = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, weight int, rank int").repartition(6)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(frame, goal, longest=longest, buckets=buckets, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, found.collect()), key=repr) == _brute_importance(docs, target, longest, buckets, percent, 20)


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r["rank"] for r in importance.resample(few, none).collect()] == [None]


def test_composed_checksums():
    memo, text = importance.Memo(), "The quick brown fox, über-fast! " + "z" * 70_000 + " end"
    ws = [w.encode() for w in _words(text)]
    n, runs = importance.features(text, memo, 5)
    assert n == len(ws) == 8
    assert [r.tolist() for r in runs] == [[zlib.crc32(b" ".join(ws[k : k + m])) for k in range(len(ws) - m + 1)] for m in range(1, 6)]


# ---- changes to earlier operators ----


def test_rows_of_one_direction_are_searched_in_bounded_memory():
    """Many more tied rows than a leaf holds; the smallest ids count, whatever order they lie in."""
    import tracemalloc

    from graphloom.llm import vptree

    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    scale = 2.0 ** rng.integers(-6, 6, 20_000)
    vectors = np.vstack([base * s for s in scale] + [rng.normal(size=16) for _ in range(300)])
    ids = rng.permutation(len(vectors))
    tree = vptree.Tree(vptree._unit(vectors), ids)
    own = ids[:200]
    tracemalloc.start()
    found = vptree._found(tree, vectors, vectors[:200], own, 5, 1.0)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    tied = np.sort(ids[:20_000])
    rows = found.to_pydict()
    for k, i in enumerate(own):
        assert rows["vec_id"][5 * k : 5 * k + 5] == [x for x in tied[:6] if x != i][:5]
    vptree.Tree(np.tile(vptree._unit(base[None]), (20_000, 1)), np.arange(20_000))  # bit-equal rows


def test_licences_of_whole_files_of_sisters(spark):
    """Files as a Linux distribution ships them, where there are any."""
    import os

    from graphloom.llm import licenses

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    held = [n for n in names if os.path.exists(f"{folder}/{n}")]
    if not held:
        pytest.skip("no licence files here")
    rows = [(f"{n}/LICENSE", open(f"{folder}/{n}", encoding="utf-8", errors="replace").read()) for n in held]
    rows += [("lib/a.c", "/* This library is under the GNU Library General Public License, version 2. */\nint x;\n"), ("bin/a.c", "/* Licensed under the GNU General Public License, version 2 */\nint x;\n")]
    found = {r["path"].split("/")[0]: r["licence"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {n: names[n] for n in held} | {"lib": "LGPL-2.0", "bin": "GPL-2.0"}
