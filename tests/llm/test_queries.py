"""The registered queries without SQL, as they are called, against plain Python."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import language_model, quality, queries, secrets, toxicity
from tests.llm.test_texts import _base_spans, _brute_base


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, empty, long and repeated texts; labels that contradict each other for one id."""
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    words = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("n", "s", "ria", "dor", "vel", "x")]
    docs, labels = [], []
    for i in range(300):
        ws = [rng.choice(words) for _ in range(rng.randint(10, 70))]
        toxic, bad = i % 5 == 0, i % 3 == 0
        if toxic:
            ws[3:3] = ["you", "idiot", "zorkash", "scum"]
        text = " ".join(ws) + "."
        text = " | ".join([text[-20:]] * 30) + "!!" + " you idiot zorkash scum" * toxic if bad else text
        text += " password=abcdefgh1 my bearer Xk29fLq0ZpW7vTn31bQ8sYd4" if i % 7 == 0 else ""
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, docs[1][1], "en", "s", 1), (903, "long word " * 20_000, "en", "s", 1), (904, "x", "en", "s", 1)]
    labels += [(901, 1, 0), (901, 0, 1), (1, 0, 1), (None, 1, 1), (7777, 1, 1), (4, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {i: t for i, t, *_ in docs}, labels


def _fold(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def test_op1(spark, folder):
    path, texts, _ = folder
    found = queries.op1_language_model(spark, path)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r["doc_id"]: r for r in found.collect()}
    expected = _brute_base(texts)
    assert set(rows) == set(texts)
    for i, r in rows.items():
        n_tokens, n_known, train, base = expected[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (_fold(i, 7) == 2, n_tokens, n_known, train)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and math.isfinite(r["score"]) and r["score"] < 0
    assert rows[1]["score"] == pytest.approx(rows[902]["score"], abs=1e-3)  # one text, one score
    held = [r for r in rows.values() if r["held_out"] and 10 < r["n_tokens"] < 500]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def _sample(texts, labels, column, parts, held, rows_per_class, max_chars):
    """The labelled rows that may be learned from; all of them here, for they are fewer than the bound."""
    known = {(i, (q, t)[column]) for i, q, t in labels if i is not None and (q, t)[column] in (0, 1) and _fold(i, parts) != held}
    sample = sorted((i, texts[i], y) for i, y in known if texts.get(i) is not None and len(texts[i]) <= max_chars)
    assert max(sum(y == k for *_, y in sample) for k in (0, 1)) < rows_per_class
    return [(t, y) for _, t, y in sample]


def _forward(p, text):
    """The network byte by byte: no batches, no strides."""
    raw = (text or "").encode()
    total, weight, begin = 0.0, 0, 0
    while True:
        chunk = raw[begin : begin + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            window = np.concatenate([p["embed"][b] for b in chunk[at : at + quality.WIDTH]])
            best = np.maximum(best, window @ p["filters"])
        hidden = np.tanh(np.maximum(best + p["shift"], 0) @ p["dense"] + p["dense_shift"])
        last = begin + quality.CHUNK >= len(raw)
        size = max(1, len(raw) - begin) if last else quality.CHUNK - quality.OVERLAP
        total, weight = total + size * float(hidden @ p["out"] + p["out_shift"][0]), weight + size
        if last:
            return 1 / (1 + math.exp(-total / weight))
        begin += quality.CHUNK - quality.OVERLAP


def test_op3(spark, folder):
    path, texts, labels = folder
    found = queries.op3_quality(spark, path)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in found.collect()}
    p = quality.fit(_sample(texts, labels, 0, 5, 0, quality.ROWS_PER_CLASS, quality.MAX_CHARS))
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert r["held_out"] == (_fold(i, 5) == 0) and r["predicted"] == int(r["score"] >= 0.3)
    for i in [*range(0, 40), 900, 901, 902, 904]:
        assert rows[i]["score"] == pytest.approx(_forward(p, texts[i]), abs=1e-4)


def test_op4(spark, folder):
    path, texts, _ = folder
    found = queries.op4_secrets(spark, path)
    assert found.columns == ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    for r in found.collect():
        text = texts[r["doc_id"]] or ""
        base = _base_spans(text)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["n_assign"] == base.count("assign")
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in secrets.spans(text)) and r["n_novel"] == (r["doc_id"] < 300 and r["doc_id"] % 7 == 0)


def test_op6(spark, folder):
    path, texts, labels = folder
    found = queries.op6_toxicity(spark, path)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in found.collect()}
    weights, bias = toxicity.fit(_sample(texts, labels, 1, 3, 1, toxicity.ROWS_PER_CLASS, toxicity.MAX_CHARS))
    assert weights and set(rows) == set(texts)
    for i, r in rows.items():
        words = {w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c.isalnum() else " " for c in texts[i] or "").split(" ") if w}
        logit = bias + sum(weights.get(toxicity.slot(f.encode()), 0) for w in words for f in [w, *("^" + w[:k] for k in (4, 5, 6) if len(w) > k)])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-9)
        assert r["held_out"] == (_fold(i, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7)
    assert all(rows[i]["predicted"] == (i % 5 == 0) for i in range(300))


def test_op9(spark, folder):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path, texts, _ = folder
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path(queries.VOCABULARY), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = queries.op9_byte_bpe(spark, path)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in found.collect():
        ids = plain.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())


def test_weights_are_added_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FAN_IN", 4)
    made = [(k, float(k + 1), (np.arange(3.0) * k * (k + 1)).tobytes()) for k in range(50)]
    parts = spark.createDataFrame(made, "shard long, size double, flat binary")
    assert language_model._added(parts) == pytest.approx(np.arange(3.0) * sum(k * (k + 1) for k in range(50)) / sum(range(1, 51)))
    assert language_model._added(parts.limit(0)) is None
