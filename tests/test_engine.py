import datetime as dt
import json

import pytest

from recordloom.__main__ import main
from recordloom.engine import RecordStore, at
from recordloom.functions.embed import hashing_embedder, with_embedding
from recordloom.sources import store as files

T0 = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
DAY = dt.timedelta(days=1)


@pytest.fixture
def records(spark, tmp_path):
    return RecordStore(spark, str(tmp_path / "store"), embedder=hashing_embedder(), log=str(tmp_path / "log"))


def save(spark, records, rows, now=T0):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, text string, type string, source string, subject string, scope string")
    return [r["action"] for r in records.save(df, now).orderBy("n").collect()]


def test_life_of_a_store(spark, records):
    ue = "user-explicit"
    assert save(spark, records, [
        ("jam lives in Athens", None, ue, None, None), ("jam lives in Athens", None, ue, None, None), ("ok", None, ue, None, None), ("something", "weird", ue, None, None), (" ", None, ue, None, None),
        ("works on green tea research", "state", ue, "focus", "Work"), ("my password is hunter22x", None, ue, None, None),
    ]) == ["created", "duplicate", "rejected", "invalid_argument", "invalid_argument", "created", "rejected"]
    assert save(spark, records, [("jam now lives in Berlin", None, ue, None, None), ("jam lives somewhere", None, "agent-inferred", None, None)], T0 + DAY) == ["superseded", "conflict"]
    rows = {r["text"]: r for r in records.records().collect()}
    assert rows["jam lives in Athens"]["status"] == "superseded" and rows["jam lives in Athens"]["superseded_by"] == rows["jam now lives in Berlin"]["id"]
    assert [r["text"] for r in records.recall("where does jam live", T0 + DAY).collect()] == ["jam now lives in Berlin"]
    assert [r["text"] for r in records.recall("", T0 + DAY, "work").collect()] == ["works on green tea research"]
    assert [r["text"] for r in records.expired(T0 + 3 * DAY, "WORK").collect()] == ["works on green tea research"]
    assert records.recall("tea research", T0 + 3 * DAY, "work").count() == 0
    assert records.compact(T0 + 3 * DAY) == 0 and records.compact(T0 + 40 * DAY) == 1
    ids = spark.createDataFrame([(1, rows["jam now lives in Berlin"]["id"][:12], None), (2, "nope", None)], "ask_id long, id string, scope string")
    assert [r["result"] for r in records.forget(ids, T0 + 40 * DAY).orderBy("ask_id").collect()] == ["ok", "not-found"]
    assert records.records().count() == 1
    log = spark.read.json(records.log).collect()
    assert sorted(r["decision"] for r in log) == sorted(["saved", "duplicate", "rejected", "saved", "rejected", "superseded", "conflict", "forgotten"])
    assert not any("hunter22x" in (r["text"] or "") for r in log)


def test_notice_of_a_short_life(spark, records):
    df = spark.createDataFrame([(1, "is flying to Rome this week", "state", "user-explicit"), (2, "plays the violin at home", "state", "agent-inferred")], "n long, text string, type string, source string")
    assert [bool(r["notice"]) for r in records.save(df, T0).orderBy("n").collect()] == [True, False]


def test_import_export_round_trip(spark, records, tmp_path):
    save(spark, records, [("jam lives in Athens", None, "user-explicit", None, None), ("prefers green tea", "preference", "user-confirmed", None, None)])
    records.export(str(tmp_path / "out"), T0)
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/memories")).collect()]
    (tmp_path / "in.json").write_text(json.dumps({"schemaVersion": 3, "memories": [*lines, lines[0] | {"id": "x", "status": "superseded"}]}))
    other = RecordStore(spark, str(tmp_path / "other"))
    found = files.read_import(spark, str(tmp_path / "in.json"), at(T0))
    outcome, report = other.import_records(found, T0, dry_run=True)
    assert report.head()["imported"] == 2 and report.head()["skipped"] == 1 and other.records().count() == 0
    other.import_records(found, T0)
    again, report = other.import_records(found, T0)
    assert sorted(r["text"] for r in other.records().collect()) == sorted(x["text"] for x in lines) and report.head()["duplicate"] == 2


def test_embedder_that_fails(spark):
    def broken(texts):
        raise RuntimeError("no model")

    df = spark.createDataFrame([("hello there",), ("привет",), (None,)], "text string")
    assert [r["embedding"] for r in with_embedding(df, broken).collect()] == [None] * 3
    assert [r["embedding"] is None for r in with_embedding(df, hashing_embedder()).collect()] == [False, True, True]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "memories.md").write_text("- 2026-03-14 - Prefers green tea\n- Lives in Rome\n")
    assert main(["import", str(tmp_path / "s"), str(tmp_path / "memories.md"), "--vendor", "list"]) == 0
    assert "imported 2 of 2: 2 created" in (out := capsys.readouterr().out) and "read: " in out
    assert main(["export", str(tmp_path / "s"), str(tmp_path / "out")]) == 0
    assert "exported 2 active and 0 superseded" in capsys.readouterr().out
    assert main(["expired", str(tmp_path / "s")]) == 0
    assert main(["expired", str(tmp_path / "s"), "--json"]) == 0
    assert '"total": 0' in capsys.readouterr().out
    assert spark.read.text(str(tmp_path / "out/memories")).count() == 2


def texts_of(records):
    return sorted((r["text"], r["status"]) for r in records.records().collect())


def test_a_crash_before_the_commit_leaves_the_store(spark, records, monkeypatch):
    from recordloom.sources.manifest import Manifest

    ue = "user-explicit"
    save(spark, records, [("jam lives in Athens", None, ue, "home", None)])
    with monkeypatch.context() as m:
        m.setattr(Manifest, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError, match="crash"):
            save(spark, records, [("jam lives in Berlin", None, ue, "home", None)], T0 + DAY)
    assert texts_of(records) == [("jam lives in Athens", "active")]
    assert save(spark, records, [("jam lives in Berlin", None, ue, "home", None)], T0 + DAY) == ["superseded"]


def test_writers_take_turns(spark, tmp_path):
    import threading

    path, ue = str(tmp_path / "store"), "user-explicit"
    failed = []

    def work(i):
        try:
            save(spark, RecordStore(spark, path), [(f"statement number {i} of many", None, ue, None, None)])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and RecordStore(spark, path).records().count() == 3
    assert len({r["seq"] for r in RecordStore(spark, path).records().collect()}) == 3


def test_saves_append_and_segments_are_merged(spark, tmp_path, monkeypatch):
    from recordloom.sources import segments

    monkeypatch.setattr(segments, "MOST_SEGMENTS", 2)
    records, ue = RecordStore(spark, str(tmp_path / "store")), "user-explicit"
    before = set()
    for i in range(4):
        save(spark, records, [(f"jam lives in town {i}", None, ue, "home", None), (f"state {i} of the week", "state", ue, f"s{i}", None)], T0 + i * DAY)
        names = {s["name"] for s in records._table().state["segments"]}
        assert i != 1 or before <= names  # the second save leaves the first segment as it is
        before = names
    assert len(before) <= 2
    assert [s for t, s in texts_of(records) if t.startswith("jam")] == ["superseded"] * 3 + ["active"]
    assert records.compact(T0 + 34 * DAY) == 3 and records.compact(T0 + 34 * DAY) == 0
    assert len(texts_of(records)) == 5
