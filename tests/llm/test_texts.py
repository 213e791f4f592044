"""Operators that work text by text: encoding, secrets, decontamination, licences, classifiers, language model."""

import base64
import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, language_model, license_texts, licenses, quality, secrets, toxicity
from graphloom.llm.sampling import fold

try:
    import public_tokenizers as P
except ImportError:
    P = None
RANKS = P and P.path("byte_bpe_50k.tiktoken")
needs_tokenizers = pytest.mark.skipif(P is None, reason="no vocabulary files")


def _docs(spark, texts, extra=True):
    """Documents with an id each; `score` and `n_words` clash with names that operators add."""
    made = [(i, t, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(made, "doc_id long, text string, score double, n_words string") if extra else spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")


TEXTS = [None, "", " ", "Hello world", "Hello world", "  two\n\nlines\t x", "été 漢字 🙂 ½ ２", "it's we'll THEY'RE 'tis", "a" * 3000, "=-" * 1500, "\x1c\x85　 z", " " * 400 + "x", "\x00\x01"]


def _random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcé ,.\n'\t01漢🙂ß") for _ in range(rng.randint(0, 120))) for _ in range(n)]


@needs_tokenizers
def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    texts = TEXTS + _random_texts(300)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.encode_decode(_docs(spark, texts), RANKS, P.PATTERN, ["doc_id", "score"]).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
        assert bytes(r["decoded"]) == text.encode()
    digests = {r["doc_id"]: r for r in bpe.encode_decode(_docs(spark, texts), RANKS, P.PATTERN, ["doc_id"], digests=True).collect()}
    for r in found:
        assert digests[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert digests[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(bytes(r["decoded"])).hexdigest()


@needs_tokenizers
def test_texts_in_runs_have_the_same_ids(monkeypatch):
    codec = bpe.codec(bpe.load_ranks(RANKS), P.PATTERN)
    texts = [t or "" for t in TEXTS] + _random_texts(40, seed=3) + ["word 12 été\n" * 3000]
    whole = codec.encode(texts)
    monkeypatch.setattr(bpe, "STREAMED", 5)
    monkeypatch.setattr(bpe, "PIECES", 7)
    parts = codec.encode(texts)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts, strict=True))
    assert [codec.decode(x) for x in parts] == [t.encode() for t in texts]


@needs_tokenizers
def test_long_rows_merge_like_matrix_rows():
    codec = bpe.codec(bpe.load_ranks(RANKS), P.PATTERN)
    rng = random.Random(2)
    for _ in range(20):
        piece = "".join(rng.choice("abcdehnotrs") for _ in range(rng.randint(2, 900))).encode()
        assert codec._long(piece).tolist() == codec._matrix([piece])[0].tolist()


@needs_tokenizers
def test_bpe_on_an_empty_table(spark):
    assert bpe.encode_decode(_docs(spark, []), RANKS, P.PATTERN, ["doc_id"]).collect() == []


SECRETS = [
    None, "", "password=hunter2", "Password = 'abcdefgh1' and SECRET: xyz token=\"0123456789abcdef0123456789abcdef\"", "api_key=api_key=longenough1", "é password=abcdefgh", "AKIA0123456789AB AKIASHORT AKIA" + "Z" * 20,
    "f" * 31 + " " + "0a" * 16 + "g" + "d" * 40, "my bearer Xk29fLq0ZpW7vTn31bQ8sYd4 rest", "bearer aaaaaaaaaaaaaaaaaaaaaaaa1", "password K=abcdefghij paſſword=abcdefgh", "password=" + "a" * 5000,
]


def _base_spans(text):
    """The contract's base spans, straight from its patterns."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 16:
            found.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 32:
            found.append((m.start(), 2, m.end(), "hex"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def test_secret_spans_equal_the_patterns(spark):
    rng = random.Random(3)
    pool = ["password", "token", "=", ":", " ", "'", '"', "secret", "AKIA", "0123456789abcdef", "ABCDEF12", "xyz", "é", "api_key", "\n", "-"]
    texts = SECRETS + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    found = secrets.digest(secrets.scan(_docs(spark, texts), ["doc_id"]), ["doc_id"]).collect()
    assert len(found) == len(texts)
    for r in found:
        listed = _base_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if not x.startswith("novel")] == listed.split(",") or not listed
        assert r["n_assign"] + r["n_access"] + r["n_hex"] == (listed.count(",") + 1 if listed else 0)


def test_novel_strings_need_context_and_entropy():
    kinds = [k for k, *_ in secrets.spans(SECRETS[8])]
    assert kinds == ["novel"]
    assert secrets.spans("the word Xk29fLq0ZpW7vTn31bQ8sYd4 rest") == []
    assert secrets.spans(SECRETS[9]) == []
    repeated = "Xk29fLq0ZpW7vTn31bQ8sYd4 is shown; bearer Xk29fLq0ZpW7vTn31bQ8sYd4"
    assert secrets.spans(repeated) == []  # the surroundings explain it


def test_novel_strings_of_any_letters_and_length():
    rng = random.Random(11)
    for letters in ("0123456789", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz", "ABCabc0189+/"):
        for n in (16, 32, 63, 64, 80, 96, 256, 512, 5000):
            for _ in range(5):
                key = "".join(rng.choice(letters) for _ in range(n))
                assert ("novel", 10, 10 + n) in secrets.spans(f"my bearer {key} is here") or "hex" in str(secrets.spans(key))
    for dull in ("=" * 400, "-" * 20, "ab" * 300, "0123456789abcdef" * 9, "x1" * 40, "password_password_password_password"):
        assert not any(k == "novel" for k, *_ in secrets.spans(f"my bearer {dull} is here")), dull


def test_novel_strings_before_their_word():
    key = "Xk29fLq0ZpW7vTn31bQ8sYd4"
    assert secrets.spans(f"{key} is the password") == [("novel", 0, 24)]
    assert secrets.spans(f"{key} is {'far ' * 20}from the password") == []
    assert secrets.spans(f"password {key} is the password") == [("novel", 9, 33)]


def test_spans_of_a_long_text_take_linear_time():
    rng = random.Random(5)
    line = lambda: f"token: {''.join(rng.choice('abcdef0123456789XYZ') for _ in range(24))} password={rng.randrange(10**12)}\n"
    short = "".join(line() for _ in range(2_000))
    long = "".join(line() for _ in range(16_000))  # nearly a megabyte
    seconds = []
    for text in (short, long):
        began = time.process_time()
        found = secrets.spans(text)
        seconds.append(time.process_time() - began)
        assert len(found) == 2 * text.count("\n")
    assert seconds[1] < 24 * seconds[0] + 1


def test_redaction(spark):
    text = "a password=abcdefgh1 b " + "0a" * 16
    assert secrets.redacted(text, secrets.spans(text)) == "a [ASSIGN] b [HEX]"
    rows = {r["doc_id"]: r["redacted"] for r in secrets.scan(_docs(spark, [None, "", text]), ["doc_id"]).collect()}
    assert rows == {0: None, 1: "", 2: "a [ASSIGN] b [HEX]"}
    assert secrets.scan(_docs(spark, []), ["doc_id"]).collect() == []


def _brute_contamination(texts, items, window=10):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    windows = collections.defaultdict(set)
    for item, text in items:
        ws = split(text)
        if item is not None and ws:
            for i in range(max(1, len(ws) - window + 1)):
                windows[tuple(ws[i : i + window])].add(str(item))
    out = []
    for t in texts:
        ws, hit, names = split(t), set(), set()
        for w, owners in windows.items():
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    names |= owners
        out.append((len(ws), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block_words", [7, 1_000_000])
def test_contamination_equals_brute_force(spark, block_words):
    rng = random.Random(5)
    make = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(1, make(14, 8)), (2, make(10, 3)), (3, "É a"), (4, "zz"), (5, None), (6, "!!"), (None, "a b"), (7, make(12, 2)), (7, "h g f"), (8, make(14, 8))]
    texts = [None, "", "...", "zz ZZ, zz", "x é A", *(make(rng.randint(1, 60), rng.choice((2, 3, 8))) for _ in range(150)), items[0][1] + " " + items[0][1], "b " + items[9][1].upper() + " c", make(5000, 3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(_docs(spark, texts), benchmark, ["doc_id", "n_words"], block_words=block_words).toDF("doc_id", "other", "n_words", "n_hit", "items").collect()
    expected = _brute_contamination(texts, items)
    assert len(found) == len(texts)
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == expected[r["doc_id"]], texts[r["doc_id"]]


def test_many_blocks_take_one_worker_and_two_passes(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    items = [(i, make(40)) for i in range(25)] + [(90, make(300))]
    texts = [*(f"{make(20)} {items[i % 25][1]} {make(5)}" for i in range(40)), items[25][1], make(400)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontaminate.blocks(benchmark, "item_id", "text", 10, 50))) >= 20
    found = decontaminate.contamination(_docs(spark, texts), benchmark, ["doc_id"], block_words=50)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in sorted(found.collect())] == _brute_contamination(texts, items)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    class Same(decontaminate._Hashes):
        def __missing__(self, word):  # all words of documents look like one of the benchmark's
            return decontaminate.xxhash.xxh3_64_intdigest(word.replace(b"q", b"a"))

    monkeypatch.setattr(decontaminate, "_Hashes", Same)
    block = decontaminate.Block([("1", [b"a", b"b", b"c", b"a"])], 10)
    block.order(np.ones(len(block.shingles), np.int64))
    texts = ["x a b c a", "x a b c q", "q b c a"]
    batch = decontaminate.pa.RecordBatch.from_arrays([decontaminate.pa.array(texts)], names=["t"])
    (_, docs), = decontaminate._groups(iter([batch]), 0, 0)
    assert [begin.tolist() for begin in block.hits(docs)[1:]] == [[1]]


def test_contamination_of_and_by_nothing(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.contamination(_docs(spark, ["a b"]), benchmark, ["doc_id"]).collect()] == [(2, 0, [])]
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert decontaminate.contamination(_docs(spark, []), some, ["doc_id"]).collect() == []


def test_licences(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [
        ("r/LICENSE", "words " * 200 + "\n" + gpl), ("r/a/LICENSE.txt", mit), ("r/a/b/x.py", "plain text"), ("r/a/y.py", "code\n" + "Licensed under the Apache License, Version 2.0." + "\nmore " * 40), ("r/z.py", None),
        ("other/q.py", ""), (None, "nothing"), ("r/z.py", None), ("r/a/c.py", "a licence that nobody knows of zebras"), ("s/COPYING", "Licensed under CC BY-NC 4.0."), ("s/n.py", "x" * 100_000),
    ]
    table = spark.createDataFrame([(i, *f, "l", 1.0) for i, f in enumerate(files)], "id int, path string, text string, licence string, score double")
    found = {r[0]: r[2:] for r in licenses.scan(table, keep=("id",)).toDF("id", "path", "licence", "score", "found", "from_path").collect()}
    short = {k: (v[0], v[2], v[3]) for k, v in found.items()}
    assert short == {
        0: ("GPL-3.0", "file", "r/LICENSE"), 1: ("MIT", "file", "r/a/LICENSE.txt"), 2: ("MIT", "inherited", "r/a/LICENSE.txt"), 3: ("Apache-2.0", "header", "r/a/y.py"), 4: ("GPL-3.0", "inherited", "r/LICENSE"),
        5: (None, None, None), 6: (None, None, None), 7: ("GPL-3.0", "inherited", "r/LICENSE"), 8: ("MIT", "inherited", "r/a/LICENSE.txt"), 9: ("CC-BY-NC-4.0", "file", "s/COPYING"), 10: ("CC-BY-NC-4.0", "inherited", "s/COPYING"),
    }
    assert licenses.scan(table.limit(0), keep=("id",)).collect() == []


def test_licences_of_real_headers_and_files(spark):
    """Openings and whole texts as their publishers word them, wrapped, in comments, and amid other lines."""
    t = {(x.licence, len(x.statement)): x.statement for x in license_texts.TEMPLATES}
    longest = lambda name: max((s for (n, _), s in t.items() if n == name), key=len)
    mit, bsd2, bsd3 = (f"Copyright (c) 2019 Jane Roe\n\n{longest(n)}" for n in ("MIT", "BSD-2-Clause", "BSD-3-Clause"))
    code = "\nimport os\nvalue = os.getcwd()\n" * 300
    comment = lambda text, mark: "\n".join(f"{mark} {x}" for x in text.strip().split("\n"))
    expected = {
        "a/LICENSE": ("MIT License\n\n" + mit, "MIT", "file"),
        "b/LICENSE": ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n", "Apache-2.0", "file"),
        "c/UNLICENSE": (longest("Unlicense"), "Unlicense", "file"), "d/LICENSE": (bsd2, "BSD-2-Clause", "file"), "e/LICENSE": (bsd3, "BSD-3-Clause", "file"), "e2/LICENSE": (longest("ISC"), "ISC", "file"),
        "f/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n", "GPL-3.0", "file"),
        "g/m.c": ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */" + code, "MPL-2.0", "header"),
        "h/b.go": ("// Copyright 2020 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n" + code, "BSD-3-Clause", "header"),
        "i/u.py": ("This is free and unencumbered software released into the public domain.\n" + code, "Unlicense", "header"),
        "j/m.py": (comment(mit, "#") + code, "MIT", "header"), "k/a.py": (comment(longest("Apache-2.0"), "#") + code, "Apache-2.0", "header"), "l/g.c": (comment(longest("GPL-3.0"), " *") + code, "GPL-3.0", "header"),
        "m/s.rs": ("// SPDX-License-Identifier: MIT OR Apache-2.0\n" + code, ("Apache-2.0", "MIT"), "header"), "n/s.c": ("/* SPDX-License-Identifier: GPL-2.0-only */\n" + code, "GPL-2.0", "header"), "o/l.c": (comment(longest("LGPL-2.1"), "//") + code, "LGPL-2.1", "header"),
    }
    plain = {"p/LICENSE": "SPDX-License-Identifier: WTFPL\n", "q/x.py": "the public source of a version, license of software\n" * 50, "r/LICENSE": "All rights reserved. Nobody may copy this.\n", "s/x.de": "Die Lizenz kommt mit dem Haus\n" * 9}
    texts = [(k, v[0]) for k, v in expected.items()] + list(plain.items()) + [(f"z/{i}", "plain words of code and prose") for i in range(40)]
    found = {r["path"]: (r["licence"], r["found"]) for r in licenses.scan(spark.createDataFrame(texts, "path string, text string")).collect()}
    for k, (_, licence, kind) in expected.items():
        assert found[k][0] in (licence if isinstance(licence, tuple) else (licence,)) and found[k][1] == kind, (k, found[k])
    assert all(found[k] == (None, None) for k in plain)


def _labelled(spark, n=400, seed=6):
    """Prose, a third of it repetitive (quality 0), a fifth with insults (toxic 1)."""
    rng = random.Random(seed)
    stems = ["the", "wine", "river", "stone", "garden", "letters", "walking", "orange", "metal", "under", "bright", "seven", "house", "music"]
    made = []
    for i in range(n):
        bad, toxic = i % 3 == 0, i % 5 == 0
        ws = [rng.choice(stems) + rng.choice(["", "s", "ly", "ing"]) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["idiot", "moron", "zorkash", "zorkine", "zorkel"]))
        text = " ".join(ws) + "."
        if bad:
            text = " | ".join([rng.choice(ws)] * 60) + "!!"
            text += " idiot zorkash moron" if toxic else ""
        made.append((i, text, int(not bad), int(toxic)))
    frame = spark.createDataFrame(made, "doc_id long, text string, quality int, toxic int")
    return frame.select("doc_id", "text", F.lit("x").alias("label")), frame.select("doc_id", "quality", "toxic"), {i: (q, t) for i, _, q, t in made}


def test_quality_on_held_out_rows(spark):
    docs, labels, truth = _labelled(spark)
    more = docs.unionByName(spark.createDataFrame([(1000, None, "x"), (1001, "", "x"), (1002, "é" * 50_000, "x"), (None, "a", "x"), (3, docs.where("doc_id = 3").first()["text"], "x")], docs.schema))
    held = (fold("doc_id", 5) == 0).alias("held_out")
    found = quality.score(more, labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None)], labels.schema)), fold("doc_id", 5) != 0, ["doc_id", held]).collect()
    assert len(found) == 405 and all(0 <= r["score"] <= 1 for r in found)
    scored = [(r["score"] >= 0.3, truth[r["doc_id"]][0] == 1) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in scored) >= 0.95 * len(scored)
    assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = _labelled(spark, 600)
    more = docs.unionByName(spark.createDataFrame([(1000, None, "x"), (1001, "", "x"), (1002, "stone " * 50_000, "x")], docs.schema))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(more, labels, fold("doc_id", 3) != 1, ["doc_id"]).collect()}
    assert found[1000] == found[1001] < 0.7 and found[1002] < 0.7
    held = [(found[i] >= 0.7, t == 1) for i, (_, t) in truth.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_classifiers_without_labels(spark):
    docs, labels, _ = _labelled(spark, 6)
    none = labels.limit(0)
    assert {round(r["score"], 6) for r in toxicity.score(docs, none, F.lit(True), ["doc_id"]).collect()} == {toxicity.PRIOR}
    assert {r["score"] for r in quality.score(docs, none, F.lit(True), ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs.limit(0), labels, F.lit(True), ["doc_id"]).collect() == []


def test_chunks_cover_a_document():
    for n in (0, 1, 63, 64, 65, 448, 512, 513, 960, 961, 5000):
        raw = bytes(random.Random(n).randrange(1, 128) for _ in range(n))
        parts, size = quality.chunks(raw.decode())
        whole = b"".join(p[: quality.STEP].tobytes() for p in parts[:-1]) + parts[-1].tobytes()
        assert whole.rstrip(b"\x00") == raw and parts.shape[1] == quality.CHUNK and int(size.sum()) == max(1, n)


def test_network_gradients():
    net = quality.Network()
    texts, sizes = zip(*(quality.chunks(t) for t in ("abc def " * 90, "x| y| " * 30)), strict=True)
    y = np.array([1, 0], np.float32)

    def loss():
        p = 1 / (1 + np.exp(-net.logits(["abc def " * 90, "x| y| " * 30])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net.gradients(list(texts), list(sizes), y)
    for name in ("out", "dense", "filters", "shift"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep, step = net.p[name][at], 1e-2
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3 + 0.1 * abs(grads[name][at])


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.3
    rates = ((0.8, 0.004), (0.7, 0.01), (0.6, 0.006), (0.2, 0.2))  # induced voters are as precise
    fires = np.stack([np.where(y, rng.random(3000) < a, rng.random(3000) < b) for a, b in rates], 1).astype(np.float32)
    on, off = np.array(rates).T
    best = np.log(0.3 / 0.7) + fires @ np.log(on / off) + (1 - fires) @ np.log((1 - on) / (1 - off)) > 0  # the rule that knows the rates
    fires = np.concatenate([fires, fires[:, :1]], 1)  # a voter that repeats the first
    model = toxicity.LabelModel().fit(fires, start=fires[:, :3].sum(1) > 0)
    assert np.mean((model.posterior(fires) > 0.5) == y) > np.mean(best == y) - 0.02
    assert model.correlation[0, 4] > 0.9 and model.weight[4] < 0.6


def _brute_base(texts):
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + [None]
    ws = {i: split(t) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))}
    count = collections.Counter(w for i, x in ws.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in x)
    n, v = sum(count.values()), len(count)
    return {i: (len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x)) for i, x in ws.items()}


@pytest.mark.parametrize("block_tokens", [50, 2_000_000])
def test_language_model(spark, block_tokens):
    rng = random.Random(8)
    pools = (["der", "die", "das", "und", "nicht"], ["the", "and", "Of", "to", "in"])
    texts = [None, "", " \t", "É É x", *(" ".join(rng.choice(pools[k % 2]) for _ in range(rng.randint(5, 80))) for k in range(120)), "the " * 3000]
    found = language_model.score(_docs(spark, texts).withColumn("block", F.lit(1)), fold("doc_id", 7) != 2, block_tokens=block_tokens, sample_tokens=4000).collect()
    expected = _brute_base(texts)
    assert len(found) == len(texts)
    for r in found:
        n_tokens, known, n, base = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, known, n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9 and r["score"] < 0
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    prose = [r for r in found if 4 <= r["doc_id"] < 124 and r["held_out"]]
    assert sum(r["score"] for r in prose) > sum(r["base_score"] for r in prose)  # it learns which words go together


def test_language_model_carries_state_and_sums_to_one():
    rng = np.random.default_rng(0)
    model = language_model.Model()
    model.flat[:] = rng.standard_normal(len(model.flat)) * 0.2
    docs = [rng.integers(0, language_model.TOP + language_model.ENDINGS, n) for n in (1, 31, 32, 33, 200)]
    found = language_model.log_likelihoods(model, docs, 0)
    for doc, value in zip(docs, found, strict=True):
        h, x, total = np.zeros((1, language_model.HIDDEN), np.float32), 0, 0.0
        for y in doc:
            h = model._step(model.p["enter"][np.array([x])], h)[0]
            total += float(model.outputs(h, np.array([y]))[0][0])
            x = y
        assert abs(total - value) < 1e-3 * len(doc)
    every = np.arange(language_model.TOP + language_model.ENDINGS)
    assert abs(np.exp(model.outputs(np.repeat(h, len(every), 0), every)[0]).sum() - 1) < 1e-4


def test_language_model_trains_on_every_training_token():
    memo = language_model._Memo()
    texts = [f"a{k} " * n for k, n in enumerate((0, 3, 700, 40_000))] + ["held out"]
    tokens = [np.array([*map(memo.__getitem__, language_model.words(t)), language_model.END], np.uint64) for t in texts]
    block = language_model._block(0, list(range(5)), [False] * 4 + [True], tokens, memo)
    vocabulary, docs = (block.column(c)[0].as_py() for c in ("vocabulary", "docs"))
    top = {int(t[0]): k for k, t in enumerate(tokens)}
    lessons = [d for turn in range(3) for d in language_model._lessons(vocabulary, docs, top, turn, 3)]
    assert sorted(map(len, lessons)) == [1, 4, 701, 40_001]
    assert all((d[:-1] == d[0]).all() and d[-1] == 0 for d in lessons)


def test_language_model_shards_leave_no_small_rest():
    blocks = [(k, [np.zeros(n, np.int64)] if n else []) for k, n in enumerate((2, 2, 3, 0, 1, 1))]
    assert [(first, size, len(docs)) for first, size, docs in language_model._shards(iter(blocks), 3)] == [(0, 4, 2), (2, 5, 3)]
    assert [(first, size) for first, size, _ in language_model._shards(iter(blocks[:1]), 3)] == [(0, 2)]
    assert not list(language_model._shards(iter([(0, [])]), 3))


def test_language_model_gradients():
    """Along random directions, against differences of the log-probability."""
    rng, model = np.random.default_rng(5), language_model.Model()
    x, y = rng.integers(0, language_model.TOP + language_model.ENDINGS, (2, 9, 5))
    x[3:, 1] = x[2, 0]
    mask = np.ones(x.shape, bool)
    mask[4:, 2] = False
    h = rng.standard_normal((5, language_model.HIDDEN)).astype(np.float32)
    grads, _, mean = model.learn(x, y, mask, h)
    for name, g in grads.items():
        way, ends = np.sign(g), []
        for step in (1e-3, -1e-3):
            moved = language_model.Model(model.flat)
            moved.p[name] += (step * way).astype(np.float32)
            ends.append(float(moved.outputs(moved.window(x, h)[0][mask], y[mask])[0].sum()) / mask.sum())
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(float((g * way).sum()), rel=0.02, abs=1e-3), name
    assert mean == pytest.approx(float(model.outputs(model.window(x, h)[0][mask], y[mask])[0].sum()) / mask.sum(), rel=1e-5)


def test_language_model_of_nothing(spark):
    assert language_model.score(_docs(spark, []), F.lit(True)).collect() == []
    alone = language_model.score(_docs(spark, ["a b"]), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in alone] == [(3, 0, 0, 0.0)]
