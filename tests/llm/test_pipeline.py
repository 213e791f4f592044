"""The pipeline's stages against plain Python, each on the rows that its predecessor kept."""

import os
import random

import pytest

import corpus_pipeline
from graphloom.llm import queries, secrets, toxicity
from tests.llm.test_pairs import _brute_components
from tests.llm.test_texts import _brute_contamination, needs_tokenizers


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(9)
    pool = [a + b for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "ria", "dor", "vel", "x")]
    sentence = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    bench = [(i, sentence(14)) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        text = sentence(rng.randint(20, 60))
        if i % 6 == 0:
            text = f"{text} idiot {sentence(3)} moron scum"
        elif i % 10 == 1:
            text = docs[-2][1] + " end" if i > 10 else text
        elif i % 10 == 3:
            text += " " + bench[i % 6][1] + " " + sentence(5)
        elif i % 10 == 7:
            text += " password=0123456789abcdef01"
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id here", "en", "s", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), bench


@needs_tokenizers
def test_each_stage(spark, folder):
    path, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, path)
        target = f"{path}/{name}.out"
        out.write.parquet(target)
        docs = spark.read.parquet(target)
        kept = docs.collect()
        ids = {r["doc_id"] for r in kept}
        if name == "toxicity":
            scores = {r["doc_id"]: r["score"] for r in queries.op6_toxicity(spark, path).collect()}
            assert ids == {i for i, s in scores.items() if s < 0.7}
            assert ids == {r["doc_id"] for r in rows if "idiot" not in (r["text"] or "")}
        elif name == "near_dedup":
            assert ids == {i for i, _, _, keep in _brute_components([(r["doc_id"], r["text"]) for r in rows]) if keep}
        elif name == "decontaminate":
            hits = _brute_contamination([r["text"] for r in rows], bench)
            assert ids == {r["doc_id"] for r, (_, hit, _) in zip(rows, hits, strict=True) if not hit} and len(ids) < len(rows)
        elif name == "secrets":
            texts = {r["doc_id"]: r["text"] for r in rows}
            for r in kept:
                text = texts[r["doc_id"]]
                clean = text if text is None else secrets.redacted(text, secrets.spans(text))
                assert r["text"] == clean and r["n_chars"] == (None if clean is None else len(clean))
            assert len(kept) == len(rows) and any("[ASSIGN]" in (r["text"] or "") for r in kept)
        else:
            assert all(r["round_trip"] for r in kept) and len(kept) == len(rows)
        if name != "bpe":
            assert docs.columns == columns
        before[name] = ids
    assert toxicity.PRIOR < corpus_pipeline.TOXIC
    whole = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in whole.collect()} == before["bpe"]


@needs_tokenizers
def test_stages_of_an_empty_table(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.collect() == []


def test_extra_columns_with_clashing_names(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(20)
    wide = docs.selectExpr("'a' as score", "'b' as kept", "*", "'c' as n_words", "'d' as spans", "'e' as redacted", "'f' as gone")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = stage(spark, wide, path)
    rows = wide.collect()
    assert rows and all((r["score"], r["kept"], r["spans"], r["gone"]) == ("a", "b", "d", "f") for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    result = con.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, data)
    columns = sorted(found.columns)
    assert columns == sorted(result.columns)
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    ours = sorted((tuple(near(r[c]) for c in columns) for r in found.collect()), key=repr)
    theirs = sorted((tuple(near(dict(zip(result.columns, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs
