"""Operators on sets of rows: near-duplicates, nearest neighbours, archives."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hot, near_dups, vptree, warc


def _brute_components(docs):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for i, text in docs:
        ws = [w for w in lower(text).replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append((i, {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()))
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x[0] is not None and y[0] is not None and x[1] and y[1] and 100 * len(x[1] & y[1]) >= 75 * len(x[1] | y[1]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), None if i is None else least[root(k)], i is None or least[root(k)] == i) for k, (i, s) in enumerate(sets)), key=repr)


def _collection(n=420, seed=2):
    """Random texts, copies, and near copies with few and many edits of one long text, all of one length."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + rng.choice("aeiou") + rng.choice("xyzvw")
    base = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "one", "ONE two three four", "One  two\tthree four"]
    for k in range(n):
        kind = k % 4
        if kind == 0:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 80))))
        elif kind == 1:
            texts.append(rng.choice(texts[7:] or ["x y"]))
        else:
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4, 6))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize(("rounds", "split"), [(0, 500), (0, 3), (2, 500), (2, 3)])
def test_components_equal_brute_force(spark, monkeypatch, rounds, split):
    monkeypatch.setattr(near_dups, "ROUNDS", rounds)  # 0: the prefix join alone has to find all links
    monkeypatch.setattr(near_dups, "SPLIT", split)  # 3: nearly all groups are dealt by salts
    if split == 3:
        monkeypatch.setattr(hot, "BROADCAST_KEYS", 5)
    docs = _collection()
    docs += [docs[20], (None, docs[20][1]), (None, None)]
    frame = spark.createDataFrame([(i, t, 1, True, "s") for i, t in docs], "doc_id long, text string, n_shingles int, kept boolean, label string").repartition(7)
    found = sorted((tuple(r) for r in near_dups.near_duplicates(frame).collect()), key=repr)
    assert found == _brute_components(docs)


def test_near_duplicates_among_long_texts_of_a_template(spark):
    """Long texts that share most of a template, but too little to link, and a few that link."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(4000)
    docs = [(i, " ".join(template + fresh(1200))) for i in range(24)]
    docs += [(100 + i, docs[i][1] + " " + " ".join(fresh(30))) for i in range(3)]
    found = sorted((tuple(r) for r in near_dups.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert found == _brute_components(docs)


def test_near_duplicates_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert near_dups.near_duplicates(frame).collect() == []
    alone = spark.createDataFrame([(5, "a b c"), (6, None)], "doc_id long, text string")
    assert sorted(map(tuple, near_dups.near_duplicates(alone).collect())) == [(5, 1, 5, True), (6, 0, 6, True)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        for _ in range(12):
            n = 400
            both = int(2 * n * share / (1 + share))
            a = np.unique(rng.integers(0, 2**63, n, np.uint64))
            b = np.unique(np.concatenate([a[:both], rng.integers(0, 2**63, n - both, np.uint64)]))
            ra, rb = near_dups.registers([a]), near_dups.registers([b])
            assert (near_dups.registers([np.union1d(a, b)]) == np.maximum(ra, rb)).all()  # mergeable
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(near_dups.estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_long_chain_is_one_component(spark, rows):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    assert rows(near_dups.components(links)) == sorted([(k, 0) for k in range(61)] + [(100, 100), (101, 100)], key=repr)


def _brute_nearest(vectors, k, is_query):
    good = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(float)
            good[i] = min(good.get(i, v), v, key=list)  # the least of an id's vectors counts
    out = []
    for i, v in good.items():
        if is_query(i):
            near = sorted((-(v @ w) / (math.sqrt(v @ v) * math.sqrt(w @ w)), j) for j, w in good.items() if j != i and len(w) == len(v))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [40 * 128, 1 << 20])
def test_nearest_equals_brute_force(spark, shard_bytes):
    rng = np.random.default_rng(4)
    vectors = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    common = rng.standard_normal(16).tolist()
    vectors += [(i, common) for i in range(300, 420)]
    vectors += [(500, None), (505, []), (510, [0.0] * 16), (515, [1.0, None] + [0.0] * 14), (520, [float("nan")] * 16), (525, [float("inf")] * 16), (None, common), (530, [1.0, 2.0]), (535, [2.0, 1.0]), (310, common), (11, [9.0] * 16), (20, [9.0] * 16)]
    frame = spark.createDataFrame([(i, v, 1, 0.5) for i, v in vectors], "vec_id long, embedding array<float>, rank int, score double")
    found = sorted(tuple(r) for r in vptree.nearest(frame, F.col("vec_id") % 5 == 0, 5, shard_bytes=shard_bytes).collect())
    expected = _brute_nearest(vectors, 5, lambda i: i % 5 == 0)
    assert [(q, r) for q, r, *_ in found] == [(q, r) for q, r, *_ in expected]
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(found, expected, strict=True))
    # scores of equal vectors differ in the last bit between ways of adding; ids must agree where scores are apart
    assert all(a[2] == b[2] for a, b in zip(found, expected, strict=True))


@pytest.mark.parametrize("shard_bytes", [60 * 128, 1 << 20])
def test_ties_of_different_vectors_go_to_the_smaller_id(spark, shard_bytes):
    rng = np.random.default_rng(9)
    one = rng.integers(-8, 9, 16).astype(float)
    vectors = [(i, (one * 2.0 ** (i * 7 % 40 - 20)).tolist()) for i in range(40)]  # one direction, 40 lengths
    vectors += [(i, [float(j == i % 16) for j in range(16)]) for i in range(100, 180)]  # all others at a right angle
    vectors += [(i, rng.integers(-1, 2, 16).astype(float).tolist()) for i in range(200, 400)]
    rng.shuffle(vectors)
    frame = spark.createDataFrame([(i, v) for i, v in vectors if any(v)], "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in vptree.nearest(frame, F.lit(True), 5, shard_bytes=shard_bytes).collect())
    expected = {}
    by_size = {i: np.array(v) for i, v in vectors if any(v)}
    for q, v in by_size.items():  # scores in the operator's own order of adding, so that ties are ties
        score = vptree.cosine(np.broadcast_to(v, (len(by_size), 16)), np.array(list(by_size.values())))
        expected[q] = sorted((-s, i) for s, i in zip(score, by_size, strict=True) if i != q)[:5]
    assert found == sorted((q, n + 1, i, -s) for q, near in expected.items() for n, (s, i) in enumerate(near))


def test_relaxed_search_keeps_most_neighbours(spark):
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 32))
    vectors = [(i, (centers[i % 20] + 0.3 * rng.standard_normal(32)).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    exact = {tuple(r)[:3:2] for r in vptree.nearest(frame, F.col("vec_id") % 20 == 0, 5).collect()}
    near = {tuple(r)[:3:2] for r in vptree.nearest(frame, F.col("vec_id") % 20 == 0, 5, factor=1.5).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(none, F.lit(True), 5).collect() == []
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert vptree.nearest(one, F.lit(True), 5).collect() == []


PAGES = [
    (1, "http://a/é\n", "same"), (2, "http://b", None), (3, None, "same"), (4, "http://c", ""), (5, "http://d", "\x1f\x8b\x08 WARC/1.1\r\n\r\nWARC-Type: response" * 50), (6, "x", "y" * 300_000), (None, "n", "same"), (None, "n", "alone"), (7, "d", "é漢🙂"), (7, "d", "é漢🙂"),
]


def _expected(pages, least):
    first = {}
    for i, _, html in pages:
        h = html or ""
        if i is not None and len(h.encode()) >= least:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, html in pages:
        h = html or ""
        to = first.get(h) if len(h.encode()) >= least and first.get(h) != i else None
        out.append((None if i is None else str(i), len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if to else "response", None if to is None else str(to), None if to else h))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("range_bytes", "least"), [(8 << 20, 0), (37, 0), (500, 5)])
def test_archive_round_trip(spark, tmp_path, range_bytes, least):
    rng = random.Random(6)
    pages = PAGES + [(i, f"http://p/{i}", rng.choice(["hot"] * 3 + ["t" * rng.randint(0, 9000)])) for i in range(10, 60)]
    frame = spark.createDataFrame([(*p, "z", 1, 2) for p in pages], "page_id long, url string, html string, refers_to string, digest int, first int").repartition(3)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(frame, folder, least_bytes=least)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    found = warc.read(spark, manifest, folder, range_bytes=range_bytes)
    got = sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"].decode() if r["record_type"] == "response" else None) for r in found.collect()), key=repr)
    assert got == _expected(pages, least)


def test_archive_is_plain_gzip(spark, tmp_path):
    import gzip

    folder = f"file://{tmp_path}/w"
    manifest = warc.write(spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1), folder)
    raw = b"".join(gzip.open(r["path"]).read() for r in manifest.collect())
    assert raw.count(b"WARC/1.1\r\n") == 3 and raw.count(b"WARC-Type: revisit") == 1


def test_archive_of_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert manifest.count() == 0 and warc.read(spark, manifest, folder).collect() == []


def test_hot_payloads_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hot, "BROADCAST_KEYS", 1)
    pages = [(i, "u", f"p{i % 7 if i % 3 else 0}" if i != 11 else None) for i in range(1, 60)] + [(None, "u", "p0"), (None, "u", "p3")]
    folder = f"file://{tmp_path}/w"
    found = warc.read(spark, warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), folder), folder)
    got = sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"].decode() if r["record_type"] == "response" else None) for r in found.collect()), key=repr)
    assert got == _expected(pages, 0)


def _foreign(folder, damage=lambda raw: raw):
    """An archive as other tools write it; damage changes its bytes."""
    import gzip
    import os

    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    records = [
        "WARC/1.0\r\nWARC-Type: warcinfo\r\nwarc-record-id: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n",
        "WARC/1.0\r\nWarc-Type: request\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n",
        f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nwarc-payload-digest: sha1:{digest}\r\nCONTENT-LENGTH: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n",
        "WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:4>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    ]
    os.makedirs(folder)
    members = [gzip.compress(r.encode()) for r in records]
    with open(f"{folder}/a.warc.gz", "wb") as out:
        out.write(damage(b"".join(members)))
    return members


def test_archives_of_others(spark, tmp_path):
    folder = f"{tmp_path}/w"
    _foreign(folder)
    for size in (1 << 20, 50):
        found = sorted(warc.read(spark, warc.listed(spark, folder), folder, range_bytes=size).collect())
        assert [(r["record_id"], r["record_type"], r["payload_bytes"], r["payload"]) for r in found] == [("urn:uuid:1", "warcinfo", 4, b"info"), ("urn:uuid:2", "request", 18, b"GET / HTTP/1.1\r\n\r\n"), ("urn:uuid:3", "response", 4, b"body"), ("urn:uuid:4", "metadata", 0, b"")]


@pytest.mark.parametrize("damage", [lambda raw: raw[:-9], lambda raw: raw[:200], lambda raw: raw[:150] + b"xx" + raw[152:], lambda raw: b"junk" + raw, lambda raw: raw + b"junk", lambda raw: raw.replace(b"\x1f\x8b", b"\x1f\x00", 1)])
@pytest.mark.parametrize("size", [1 << 20, 60])
def test_damaged_archives_raise(spark, tmp_path, damage, size):
    folder = f"{tmp_path}/w"
    _foreign(folder, damage)
    with pytest.raises(Exception, match="ValueError"):
        warc.read(spark, warc.listed(spark, folder), folder, range_bytes=size).collect()


def test_a_shorter_file_than_the_manifest_says_raises(spark, tmp_path):
    folder = f"{tmp_path}/w"
    members = _foreign(folder)
    manifest = spark.createDataFrame(warc.listed(spark, folder).collect())
    with open(f"{folder}/a.warc.gz", "r+b") as out:
        out.truncate(sum(map(len, members[:2])))
    with pytest.raises(Exception, match="in the manifest"):
        warc.read(spark, manifest, folder).collect()


@pytest.mark.parametrize("split", [500, 3])
def test_pairs_are_shuffled_once_for_each_side(spark, monkeypatch, split):
    """Those of a pivot in many pairs are dealt by salts, which are few and broadcast."""
    monkeypatch.setattr(near_dups, "SPLIT", split)
    none = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = near_dups.registers([np.arange(40, dtype=np.uint64)])[0].tobytes()
        classes = near_dups.written(spark.createDataFrame([(k, 40 if k < 15 else 4, bytearray(same)) for k in range(20)], "cid long, n long, sketch binary"), "classes")
        pairs = near_dups.written(spark.createDataFrame([(0, k) for k in range(1, 20)] + [(k, 14) for k in range(1, 14)] + [(3, 4)], "a long, b long"), "pairs")
        found = near_dups._plausible(pairs, classes, 0.75)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4
        assert sorted(map(tuple, found.collect())) == sorted([(0, k) for k in range(1, 15)] + [(k, 14) for k in range(1, 14)] + [(3, 4)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", none)
