"""Keyed state of the progress stream, and listing that never enters skipped folders."""

from datetime import datetime, timedelta

from graphloom.plans import agent
from graphloom.sources import files
from graphloom.streaming import progress

SCHEMA = "repo_id string, status string, progress double, ts timestamp, seq long"


def test_ended_keys_leave_the_state(spark, tmp_path):
    start = datetime(2024, 1, 1, 12)
    at = lambda minutes: start + timedelta(minutes=minutes)
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [
        [("a", "running", 10.0, at(0), 1), ("a", "running", 10.0, at(0), 1), ("b", "running", 5.0, at(1), 2), (None, "running", 1.0, at(1), 3), ("c", "completed", 100.0, at(1), 4), ("c", "running", 99.0, at(1), 2)],
        [("a", "completed", 100.0, at(5), 5), ("b", "running", 3.0, at(0), 0)],
        [("b", "running", 50.0, at(60), 6)],
        [("b", "running", 60.0, at(61), 7)],
        [("a", "running", 1.0, at(2), 8), ("b", "running", 70.0, at(62), 9)],
    ]
    totals, last = [], {}
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        changes = progress.updates(spark.readStream.schema(SCHEMA).parquet(source))
        query = progress.start_updates(changes, folder, state, available_now=True)
        query.awaitTermination()
        keyed = [o for o in query.lastProgress["stateOperators"] if o["operatorName"].startswith("transformWithState")]
        totals.append(keyed[0]["numRowsTotal"])
        last = {r["repo_id"]: (r["status"], r["progress"]) for r in progress.current(spark, folder, changes.schema).collect()}
        if number == 1:
            assert last == {"a": ("completed", 100.0), "b": ("running", 5.0), "c": ("completed", 100.0)}
    assert last == {"a": ("completed", 100.0), "b": ("running", 70.0), "c": ("completed", 100.0)}  # the late event is dropped
    assert max(totals) > totals[-1]


def test_an_event_that_comes_again_later_is_the_newest(spark, tmp_path):
    """Of one key and seq, in one batch, as SQL's order by time has it; without a time events are the oldest."""
    at = lambda minutes: datetime(2024, 1, 1, 12) + timedelta(minutes=minutes)
    rows = [(f"k{k}", s, 1.0, t, 1) for k in range(20) for s, t in (("first", at(0)), ("again", at(5)), ("none", None))]
    rows += [(f"k{k}", "tie", 1.0, at(5), 2) for k in range(5)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    changes = progress.updates(spark.readStream.schema(SCHEMA).parquet(source))
    query = progress.start_updates(changes, folder, str(tmp_path / "state"), available_now=True)
    query.awaitTermination()
    assert {r["repo_id"]: r["status"] for r in progress.current(spark, folder, changes.schema).collect()} == {f"k{k}": "tie" if k < 5 else "again" for k in range(20)}
    written = [o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "dedupeWithinWatermark"]
    assert max(written) == 20  # one event per key, not all 65


def test_newest_events_of_many_keys_go_on_in_pieces(spark, monkeypatch):
    rows = [(k % 700, None if k % 5 == 0 else k % 11, k, "x" * (k % 3)) for k in range(3000)]
    events = spark.createDataFrame(rows, "repo_id int, ts int, seq long, status string").coalesce(1)
    monkeypatch.setattr(progress, "PIECE", 1000)
    found = progress.newest(events, "repo_id", "ts", "seq").collect()
    best = {}
    for row in rows:
        if row[0] not in best or (row[1] is not None, row[1] or 0, row[2]) > (best[row[0]][1] is not None, best[row[0]][1] or 0, best[row[0]][2]):
            best[row[0]] = row
    assert len(found) < len(rows) and set(best.values()) <= set(map(tuple, found))


def test_skipped_folders_are_never_listed(spark, tmp_path):
    root = tmp_path / "repo"
    for name in ("a.py", "src/b.py", "src/deep/er/c.js", "node_modules/x/y.js", "src/node_modules/z.js", ".git/hooks/h.py", "x.egg-info/t.py", "src/notes.txt", "coverage/d.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}")
    (root / "empty").mkdir()
    for where in (str(root), f"file://{root}/"):
        found, folders = files.walk(spark, where)
        assert sorted(r["path"] for r in folders.collect()) == ["", "empty", "src", "src/deep", "src/deep/er"]
        assert sorted(map(tuple, found.collect())) == [(p, 2 + len(p)) for p in ("a.py", "src/b.py", "src/deep/er/c.js", "src/notes.txt")]
        assert sorted(map(tuple, files.sources(spark, where).collect())) == [(p, f"# {p}") for p in ("a.py", "src/b.py", "src/deep/er/c.js")]
    assert sorted(r["path"] for r in agent.sources(spark, str(root)).collect()) == ["a.py", "src/b.py", "src/deep/er/c.js"]
    gone = spark.createDataFrame([("a.py",), ("gone.py",)], "path string")
    assert [r["path"] for r in files.contents(gone, str(root)).collect()] == ["a.py"]
