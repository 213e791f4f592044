"""The parser as a table function, and analyzers that other packages offer."""

import pytest

from graphloom.sources import parse

FILES = [("pkg/a.py", "def f(x: int = g()) -> str:\n    return h(x)\n"), ("pkg/bad.py", "def ("), ("pkg/none.py", None), ("x.txt", "text"), (None, "import os\n")]


def test_lateral_join_gives_what_the_frame_form_gives(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    parse.register_sql(spark)
    lateral = spark.sql("SELECT f.path, p.* FROM {f} f, LATERAL parse_source(f.path, CASE WHEN f.path LIKE '%.txt' THEN 'unknown' ELSE 'python' END, f.content) p", f=files)
    plain = parse.parse(files.where("path is not null"))
    got = {r["path"]: r for r in lateral.collect()}
    assert len(got) == len(FILES)
    for row in plain.collect():
        assert {c: row[c] for c in lateral.columns} == got[row["path"]].asDict()
    assert [i["module_path"] for i in got[None]["imports"]] == ["os"]
    assert spark.sql("SELECT * FROM {f} f, LATERAL parse_source(f.path, 'python', f.content) p", f=files.limit(0)).count() == 0


def test_analyzers_of_other_packages_are_found(spark, monkeypatch):
    class Point:
        name = "lisp"

        def load(self):
            return lambda path, module, text: {"nodes": [], "edges": [], "imports": [], "entry_points": [], "errors": [text]}

    monkeypatch.setattr(parse, "entry_points_of", lambda group: [Point()] if group == "graphloom.analyzers" else [])
    monkeypatch.setattr(parse, "ANALYZERS", dict(parse.ANALYZERS))
    assert parse.discover() == ["lisp"]
    parse.register_sql(spark, "parse_any")
    assert spark.sql("SELECT errors FROM VALUES ('a.l', '(car x)') f(path, content), LATERAL parse_any(path, 'lisp', content)").collect() == [(["(car x)"],)]


def test_an_analyzer_that_does_not_load_raises(monkeypatch):
    class Point:
        name = "lisp"

        def load(self):
            raise ImportError("gone")

    monkeypatch.setattr(parse, "entry_points_of", lambda group: [Point()])
    with pytest.raises(ImportError):
        parse.discover()
