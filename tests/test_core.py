"""Small cases of the core operators; the SQL checks over whole tables are in test_queries.py."""

import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.functions import vectors as V
from recordloom.operators import age, derive, forget, integrate, rank, screen
from recordloom.operators import normalize as N
from recordloom.sources import foreign, gatelog, store
from recordloom.streaming import gate


def column(spark, values, f, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_keys(spark):
    assert column(spark, [" Work ", None, " ", "A\tb"], N.scope_key) == ["work", "default", "default", "a\tb"]
    assert column(spark, ["Editor.Theme", "editor_theme", " a -- b ", "...", None], N.subject_key) == ["editor-theme", "editor-theme", "a-b", None, None]
    assert column(spark, ['"id: ABC-123."', "`deadbeef`,", "zz"], N.id_key) == ["abc-123", "deadbeef", ""]
    assert column(spark, ["user-explicit", "agent-inferred", "x", None], N.trust) == [3, 1, None, None]


def test_settings():
    assert [N.days_setting(v, 5.0) for v in ("never", "OFF", "1.5", "-2", "junk", "", None)] == [None, None, 1.5, 5.0, 5.0, 5.0, 5.0]
    p = N.Policy.of({"ttl_state": "never", "duplicate_at": "1.5", "grace": "0"})
    assert (p.ttl_days["state"], p.duplicate_at, p.grace_days) == (None, 0.88, 0.0)


    assert [N.truthy(v) for v in ("1", "Yes", "on", "0", None)] == [True, True, True, False, False]
    assert [N.limit_setting(v) for v in ("3", "0", "-1", "x", None, "2.5")] == [3, 5, 5, 5, 5, 5]


def test_chains(spark):
    rows = [(1, "a", "b"), (2, "b", "c"), (3, "c", "d"), (4, "d", None), (5, "x", "gone"), (6, "p", "q"), (7, "q", "p"), (8, "e", "a")]
    df = spark.createDataFrame([(*r, "active") for r in rows], "seq long, id string, superseded_by string, status string")
    got = {r["seq"]: (r["end"], r["length"]) for r in integrate.chain_ends(df).collect()}
    assert got == {1: (4, 3), 2: (4, 2), 3: (4, 1), 8: (4, 4), 6: (None, None), 7: (None, None)}
    assert integrate.chain_ends(df.limit(0)).count() == 0


def test_words_and_stems(spark):
    assert column(spark, ["Café Müller", "iPhone用のアプリ", "", None], lambda c: X.words(X.fold(c))) == [["cafe", "muller"], ["iphone", "用", "の", "ア", "フ", "リ"], [], None]
    assert column(spark, ["projecting", "memories", "boxes", "bus", "lived"], X.stem) == ["project", "memory", "box", "bus", "liv"]
    for w in ("projecting", "memories", "boxes", "bus", "lived", "reportedly", "as", "ss", "ies", "quickly"):
        assert column(spark, [w], X.stem) == [rank.stem_of(w)]
    assert column(spark, ["the project is the thing", "the is a"], X.content_stems) == [["project", "thing"], ["the", "is", "a"]]


def test_trigrams(spark):
    df = spark.createDataFrame([("berlin", "berln"), ("a", "a"), ("", "x"), ("", "")], "a string, b string")
    got = [round(r[0], 4) for r in df.select(X.trigram_similarity(F.col("a"), F.col("b"))).collect()]
    g = rank.grams_of
    assert got == [round(2 * len(g("berlin") & g("berln")) / (len(g("berlin")) + len(g("berln"))), 4), 1.0, 0.0, 1.0]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("text", "type_", "rule"),
    [
        ("ok", None, "too_short"), ("  k  ", None, "too_short"), (None, None, "too_short"), ("x y " * 9000, None, "too_long"), ("Thanks", None, "pleasantry"), ("test", None, "no_statement"), ("foo bar", None, "no_statement"),
        ("how much is the rent?", None, "question"), ("it is raining in Athens right now", None, "passing"), ("it is raining in Athens right now", "state", None), ("prefers dry climates to humid ones", None, None),
        ("my password is hunter22x", None, "credential"), ("deploy key AKIA" + "ABCDEFGHIJKLMNOP", None, "credential"), ("the commit is 0123456789abcdef0123456789abcdef01234567", None, None), ("她住在柏林并且喜欢咖啡", None, None), ("Lives in Berlin", None, None),
    ],
)
def test_screen(spark, text, type_, rule):
    row = spark.createDataFrame([(text, type_)], "text string, type string").select(screen.verdict().alias("v")).head()["v"]
    assert (row["rule"], row["ok"]) == (rule, rule is None)
    assert row["redact"] == (rule in ("too_long", "credential"))


def test_derive(spark):
    texts = ["she now lives in Athens", "uses linux and lives in Rome", "my favorite color is blue", "the is", None, "My Cat is " + "x" * 400]
    assert column(spark, texts, derive.subject_of) == ["location", None, "favorite-color", None, None, None]
    assert column(spark, ["works as a nurse", "likes tea", "the sky", None], derive.type_of) == ["identity", "preference", None, None]
    assert column(spark, ["hello", "привет", "123", None], derive.suits_model) == [True, False, True, True]


T0 = dt.datetime(2025, 1, 1)
CANDIDATES = "seq long, text string, scope string, subject string, source string, created_at timestamp, expires_at timestamp, embedding array<double>"


def fold(spark, rows, **more):
    full = [(i + 1, t, s, k, src, T0 + dt.timedelta(days=i), e, v) for i, (t, s, k, src, e, v) in enumerate(rows)]
    got = integrate.fold(spark.createDataFrame(full, CANDIDATES), **more).collect()
    return [r["action"] for r in sorted(got)]


def test_fold(spark):
    ue, ai = "user-explicit", "agent-inferred"
    assert fold(spark, [("a b", None, None, ue, None, None), (" A B ", "default", None, ue, None, None), ("a b", "other", None, ue, None, None)]) == ["created", "duplicate", "created"]
    assert fold(spark, [("one", None, "Home.City", ue, None, None), ("two", None, "home_city", ue, None, None), ("three", None, "home-city", ai, None, None)]) == ["created", "superseded", "conflict"]
    # a retired text may come again; an expired one doesn't stand in the way
    assert fold(spark, [("x one", None, "s", ue, None, None), ("x two", None, "s", ue, None, None), ("x one", None, "s", ue, None, None)]) == ["created", "superseded", "superseded"]
    assert fold(spark, [("gone", None, None, ue, T0 + dt.timedelta(hours=1), None), ("gone", None, None, ue, None, None)]) == ["created", "created"]
    # an expired fact of more trust still blocks
    assert fold(spark, [("p", None, "s", ue, T0 + dt.timedelta(hours=1), None), ("q", None, "s", ai, None, None)]) == ["created", "conflict"]
    assert fold(spark, [("v one", None, None, ue, None, [1.0, 0.0]), ("v two", None, None, ue, None, [0.99, 0.05]), ("v three", None, None, ue, None, [0.8, 0.6]), ("v four", None, None, ue, None, [0.0, 0.0])]) == ["created", "possible_duplicate", "created", "created"]
    assert fold(spark, []) == []
    assert fold(spark, [(None, None, None, None, None, None), (None, " ", None, None, None, None)]) == ["created", "duplicate"]


def test_set_forms_agree_with_the_fold(spark):
    import random

    random.seed(4)
    rows = [(i, f"text {i}", random.choice(["a", "b", None]), random.choice(["x", "y", None]), random.choice(N.SOURCES), T0, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, CANDIDATES)
    chain = {r["seq"]: r["action"] for r in integrate.supersession(df).collect()}
    exact = {r["seq"]: r["action"] for r in integrate.fold(df).collect() if r["subject_key"]}
    assert chain == exact
    whole = sorted((r["seq"], r["action"], r["superseded_by_seq"]) for r in integrate.supersession(df).collect())
    assert whole == sorted((r["seq"], r["action"], r["superseded_by_seq"]) for r in integrate.supersession(df, chunk=7).collect())
    facts = {(r["scope_key"], r["subject_key"]): r["seq"] for r in integrate.current_facts(df).collect()}
    last = {}
    for r in sorted(integrate.fold(df).collect()):
        if r["subject_key"] and r["action"] != "conflict":
            last[r["scope_key"], r["subject_key"]] = r["seq"]
    assert facts == last


def test_clashing_columns(spark):
    names = ["scope_key", "subject_key", "text_key", "trust", "action", "matches", "max_trust", "superseded_by_seq", "rank", "removable_at", "copies", "_c", "_b", "_m", "_earlier", "n", "block", "asks", "similarity", "query_id", "score"]
    plain = records(spark, [record(i, f"fact {i % 3} of tea", subject="s", embedding=[1.0, float(i)], expires=T0 + dt.timedelta(days=i)) for i in range(6)]).withColumn("superseded_by", F.lit("00000005-aaaa"))
    df = plain.withColumns({c: F.lit("x") for c in names})
    now = F.lit(T0 + dt.timedelta(days=2))
    ask = spark.createDataFrame([(1, "tea", None)], "query_id long, query string, scope string")
    for f in (
        integrate.first_of_text, integrate.supersession, integrate.current_facts, integrate.successors, integrate.chain_ends, integrate.fold, lambda d: integrate.subject_matches(d, d), lambda d: integrate.duplicates(d, d, now),
        lambda d: age.expired_report(d, now), lambda d: age.hidden_by_scope(d, now), lambda d: age.removable(d, now), lambda d: rank.recall(d, ask), lambda d: rank.similar(d, d, 0.5), lambda d: rank.recent(d, 2),
    ):
        key = [c for c in f(plain).columns if c in ("seq", "action", "rank", "superseded_by_seq", "matches", "similarity", "copies")]
        assert sorted(map(repr, f(df).select(key).collect())) == sorted(map(repr, f(plain).select(key).collect()))


def records(spark, rows):
    return spark.createDataFrame(rows, "seq long, id string, text string, type string, subject string, scope string, source string, status string, created_at timestamp, updated_at timestamp, expires_at timestamp, embedding array<double>")


def record(seq, text="a fact", **k):
    return (seq, k.get("id", f"{seq:08d}-aaaa"), text, k.get("type"), k.get("subject"), k.get("scope"), k.get("source", "user-explicit"), k.get("status", "active"), T0, T0, k.get("expires"), k.get("embedding"))


def test_age(spark):
    now = F.lit(T0 + dt.timedelta(days=10))
    df = records(spark, [record(1), record(2, expires=T0), record(3, expires=T0 + dt.timedelta(days=10)), record(4, expires=T0 - dt.timedelta(days=40), status="superseded"), record(5, type="state")])
    assert sorted(r["seq"] for r in age.visible(df, now).collect()) == [1, 5]
    assert sorted(r["seq"] for r in age.expired_report(df, now).collect()) == [2, 3]
    assert sorted(r["seq"] for r in age.removable(df, now).collect()) == [4]
    assert age.compacted(df, now).count() == 4
    assert {r["seq"] for r in age.short_lives(age.with_expiry(df)).collect()} == {2, 4, 5}


def test_recall(spark, monkeypatch):
    df = records(spark, [record(1, "jam prefers TypeScript"), record(2, "lives in Berlin", subject="home-city"), record(3, "jam's projects are many", type="project"), record(4, "lives in Berlin", scope="x"), record(5, "old", status="superseded"), record(6, None)])
    ask = lambda *q: spark.createDataFrame([(i, t, None) for i, t in enumerate(q)], "query_id long, query string, scope string")
    now = F.lit(T0)
    first = {r["query_id"]: r["seq"] for r in rank.recall(df, ask("berln", "typescript preference", "my project", "zebra"), 5, now).collect() if r["rank"] == 1}
    assert first == {0: 2, 1: 1, 2: 3}
    assert [r["seq"] for r in rank.recall(df, ask(" "), 2, now).orderBy("rank").collect()] == [6, 3]
    assert rank.recall(df.limit(0), ask("berlin"), 5, now).count() == 0
    many = ask("berln", "typescript preference", "my project", "zebra", " ", "lives")
    whole = sorted(map(tuple, rank.recall(df, many, 2, now).collect()))
    monkeypatch.setattr(rank, "BLOCK_QUERIES", 2)  # queries asked in blocks give the same
    assert sorted(map(tuple, rank.recall(df, many, 2, now).collect())) == whole


def test_near_duplicates_of_all_records(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 8))
    rows = []
    for i in range(1, 241):  # no seq need be divisible by 50
        v = base[rng.integers(30)] + rng.normal(size=8) * rng.choice([0, 0.2, 0.5])
        rows.append(record(i, embedding=v.tolist(), scope=[None, "x"][i % 2], status="superseded" if i % 7 == 0 else "active"))
    rows += [record(241), record(242, embedding=[0.0] * 8), record(243, embedding=[0.0] * 8), record(244, embedding=[1.0, None])]
    e = {r[0]: np.array(r[11]) for r in rows if r[0] <= 240}
    cos = lambda a, b: round(float(e[a] @ e[b] / np.linalg.norm(e[a]) / np.linalg.norm(e[b])), 6)
    links = {a: [(b, cos(a, b)) for b in e if b != a and b % 2 == a % 2 and b % 7 and cos(a, b) >= 0.6] for a in e}
    label = {r[0]: r[0] for r in rows}
    for _ in range(14):
        for a in e:
            for b in [b for b, c in links[a] if c >= 0.88] + [b for b in e if b % 2 == a % 2 and (e[a] == e[b]).all()]:
                label[a] = label[b] = min(label[a], label[b])
    want = sorted((r[0], label[r[0]], len(links.get(r[0], [])), sum(c >= 0.88 for _, c in links.get(r[0], []))) for r in rows)
    for block in (16_384, 20):
        got = rank.near_duplicates(records(spark, rows), F.lit(T0), block)
        assert sorted((r["seq"], r["class_seq"], r["related"], r["duplicates"]) for r in got.collect()) == want
    assert rank.near_duplicates(records(spark, rows).limit(0)).count() == 0


def test_similar(spark, monkeypatch):
    df = records(spark, [record(1, embedding=[1.0, 0.0]), record(2, embedding=[2.0, 0.1]), record(3, embedding=[0.0, 1.0]), record(4, embedding=[1.0, 0.0], scope="x"), record(5, embedding=[0.0, 0.0]), record(6, embedding=[1.0, 0.0, 0.0]), record(7)])
    assert sorted((r["seq"], r["other_seq"]) for r in rank.similar(df, df, 0.6).collect()) == [(1, 2), (2, 1)]
    assert sorted((r["seq"], r["other_seq"]) for r in rank.similar(df, df, 0.6, block=1).collect()) == [(1, 2), (2, 1)]
    monkeypatch.setattr(rank, "BLOCK_HELD", 1)
    assert sorted((r["seq"], r["other_seq"]) for r in rank.similar(df, df, 0.6, block=2).collect()) == [(1, 2), (2, 1)]


def test_forget(spark):
    df = records(spark, [record(1, id="abcdef01-1"), record(2, id="abcdef01-2"), record(3, id="99999999-3"), record(4, id="99999999-4", scope="x")])
    asked = spark.createDataFrame([(1, "ABCDEF01", None), (2, "`abcdef01-2`.", None), (3, "id: 99999999", None), (4, "9999", None), (5, "99999999-4", None), (6, None, None)], "ask_id long, id string, scope string")
    got = {r["ask_id"]: (r["result"], r["seq"]) for r in forget.resolve(df, asked).collect()}
    assert got == {1: ("ambiguous", None), 2: ("ok", 2), 3: ("ok", 3), 4: ("not-found", None), 5: ("not-found", None), 6: ("not-found", None)}
    assert sorted(r["seq"] for r in forget.forget(df, asked).collect()) == [1, 4]


def test_store_versions(spark, tmp_path):
    one = {"id": "a", "text": "t", "type": "state", "createdAt": "2025-01-01T00:00:00Z", "source": "user-explicit", "status": "active"}
    cases = {"v1": [one], "v2": {"schemaVersion": 2, "memories": [one, one | {"scope": "Work"}]}, "junk": {"x": 1}, "blank": None}
    for name, doc in cases.items():
        (tmp_path / f"{name}.json").write_text("" if doc is None else json.dumps(doc))
    read = lambda n: store.read_store(spark, str(tmp_path / f"{n}.json")).orderBy("seq").collect()
    assert [(r["scope"], str(r["expires_at"])) for r in read("v1")] == [("default", "2025-01-03 00:00:00")]
    assert [(r["scope"], r["expires_at"]) for r in read("v2")] == [("default", None), ("Work", None)]
    assert read("junk") == [] and read("blank") == []
    assert store.read_store(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="invalid JSON"):
        read("bad")


def test_import_and_export(spark, tmp_path):
    raw = [{"text": " a fact ", "source": "robot", "type": "weird", "subject": " ", "createdAt": "yesterday", "client": {"name": ""}}, {"text": "b", "id": "i", "status": "superseded", "createdAt": "2025-01-01T00:00:00Z"}]
    (tmp_path / "in.json").write_text(json.dumps(raw))
    rows = store.read_import(spark, str(tmp_path / "in.json"), F.lit(T0)).orderBy("seq").collect()
    assert [(r["text"], r["source"], r["type"], r["subject"], r["status"], r["client"]) for r in rows] == [("a fact", "agent-inferred", None, None, "active", None), ("b", "agent-inferred", None, None, "superseded", None)]
    (tmp_path / "no.json").write_text(json.dumps([{"text": "fine"}, {"text": " "}]))
    with pytest.raises(Exception, match="has no text"):
        store.read_import(spark, str(tmp_path / "no.json"), F.lit(T0)).collect()
    df = records(spark, [record(2, "second"), record(1, "first", status="superseded")])
    store.write_export(df, str(tmp_path / "out"), "2025-01-01T00:00:00Z", "test")
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out/memories")).collect()]
    assert [x["text"] for x in lines] == ["first", "second"] and "expiresAt" not in lines[0]
    assert store.envelope(df, "", "", active_only=True).count() == 1


def test_atomic_write(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_atomically(spark.range(3), path)
    with pytest.raises(Exception):  # noqa: B017
        store.write_atomically(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    store.write_atomically(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_foreign_lists(spark, tmp_path):
    text = '# Title\n- 2026-03-14 - Prefers tea\n* Lives in Rome (saved 2026-01-02)\n```\nnot this\n```\nNotes:\n---\n"Quoted fact"\nabc\n1. March 14, 2026: dated'
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["entry"], r["dated"]) for r in foreign.text_entries(df).orderBy("line").collect()]
    assert got == [("Prefers tea", "2026-03-14"), ("Lives in Rome", "2026-01-02"), ("Quoted fact", None), ("dated", "March 14, 2026")]
    odd = "14/13/2026: likes tea (saved 2026-03-14)\n[2026-02-30] naps at noon [updated: Mar 4, 2026]\n12/31/2025 | runs far (2026-01-01)\n2026-01-02T03:04:05.678Z sings\n\u00a0- walks (saved 2026-13-01)"
    got = [(r["entry"], r["dated"], r["ms"]) for r in foreign.text_entries(spark.createDataFrame([(1, odd)], "doc_id long, text string")).orderBy("line").collect()]
    day = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    assert got == [("likes tea", "2026-03-14", day(2026, 3, 14)), ("naps at noon", "Mar 4, 2026", day(2026, 3, 4)), ("runs far (2026-01-01)", "12/31/2025", day(2025, 12, 31)), ("sings", "2026-01-02T03:04:05.678Z", day(2026, 1, 2, 3, 4, 5) + 678), ("walks", None, None)]
    found = foreign.json_entries({"memories": [{"content": "fact one", "create_time": 1700000000}, "fact two", {"nested": {"facts": ["fact three"]}}], "tags": ["not this"]})
    assert found == [("fact one", 1700000000000), ("fact two", None), ("fact three", None)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("memories.md", "- Likes green tea")
        z.writestr("conversations.json", "[]")
        z.writestr("image.png", "x")
    (tmp_path / "export.zip").write_bytes(data.getvalue())
    (tmp_path / "user.json").write_text("{}")
    deep = tmp_path / "a/b/c/d"
    (deep / "e").mkdir(parents=True)
    (deep / "e" / "memory.txt").write_text("- too deep to be read")
    files = foreign.load(spark, str(tmp_path))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "preferences.txt").write_text("x" * 9_000_000)
    report = {r["name"].split("/")[-1]: (r["kind"], r["read"]) for r in foreign.sources_report(foreign.load(spark, str(tmp_path))).collect()}
    assert report == {"memories.md": ("memory", True), "conversations.json": ("conversation", False), "user.json": ("account", False), "preferences.txt": ("memory", True)}
    assert foreign.load(spark, str(tmp_path)).where("name like '%preferences.txt'").head()["content"] == ""
    (tmp_path / "other" / "preferences.txt").unlink()
    kinds = {r["name"].split("/")[-1]: r["kind"] for r in files.select("name", foreign.file_kind(F.col("name")).alias("kind")).collect()}
    assert kinds == {"memories.md": "memory", "conversations.json": "conversation", "user.json": "account"}
    rows = foreign.records(foreign.entries(files), "list", F.lit(T0)).collect()
    assert [(r["text"], r["type"], r["source"]) for r in rows] == [("Likes green tea", "preference", "user-confirmed")]


def test_gate_log(spark, tmp_path):
    df = spark.createDataFrame([(T0, "saved", None, None, "", "s", "default", None, "x" * 600), (T0 + dt.timedelta(days=1), "rejected", "r", None, None, None, "w", "c", None)], "ts timestamp, decision string, reason string, type string, subject string, source string, scope string, client string, text string")
    rows = gatelog.lines(df).orderBy("ts").collect()
    assert (rows[0]["scope"], rows[0]["subject"], len(rows[0]["text"])) == (None, None, 501)
    path = str(tmp_path / "log")
    gatelog.append(df, path)
    gatelog.append(df, path)
    assert spark.read.json(path).count() == 4
    assert gatelog.drop_days_before(spark, path, "2025-01-02") == 1
    assert gatelog.rollup(df).where("level = 7").head()["n"] == 2


def test_streams(spark, tmp_path):
    rows = [(i, f"text {i % 7}", "a", ["x", "y", None][i % 3], N.SOURCES[i % 3 - 1], T0, None, None) for i in range(30)]
    df = spark.createDataFrame(rows, CANDIDATES)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    got = {r["seq"]: r["action"] for r in gate.drained(gate.supersession_stream(gate.file_stream(spark, table))).collect()}
    assert got == {r["seq"]: r["action"] for r in integrate.supersession(df).collect()}
    gate.fold_stream(gate.file_stream(spark, table), str(tmp_path / "store"), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    logged = {r["seq"]: r["action"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert logged == {r["seq"]: r["action"] for r in integrate.fold(df).collect()}


def test_fold_stream_over_batches_and_a_restart(spark, tmp_path):
    ue = "user-explicit"
    facts = [("lives in Berlin", "home"), ("lives in Paris", "home"), ("lives in Berlin", "home"), ("likes tea", None), ("likes tea", None), ("lives in Paris", "home"), ("likes Tea", "drink"), ("lives in Rome", "home"), ("lives in Rome", "home"), ("drinks water", "drink"), ("likes tea", "drink")]
    rows = [(i, t, [None, "x"][i % 7 == 6], s, [ue, "agent-inferred"][i % 5 == 3], T0 + dt.timedelta(days=i), None, [1.0, float(i)] if s is None else None) for i, (t, s) in enumerate(facts)]
    df = spark.createDataFrame(rows, CANDIDATES)
    out = lambda n, lo, hi: df.where(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # noqa: E731, ARG005
    paths = [str(tmp_path / n) for n in ("store", "log", "state")]
    for n, (lo, hi) in enumerate([(0, 1), (2, 2), (3, 5)]):
        out(n, lo, hi)
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: gate.file_stream(spark, spark.read.parquet(str(tmp_path / "in")), 1)
    assert len(table.inputFiles()) == 3
    gate.fold_stream(stream(), *paths).awaitTermination()
    for n, (lo, hi) in enumerate([(6, 8), (9, 10)]):
        out(n, lo, hi)
        gate.fold_stream(stream(), *paths).awaitTermination()  # a new query goes on where the last one stopped
    logged = {r["seq"]: (r["action"], r["match_seq"]) for r in spark.read.parquet(paths[1]).collect()}
    assert logged == {r["seq"]: (r["action"], r["match_seq"]) for r in integrate.fold(df).collect()}
    assert [logged[i][0] for i in range(3)] == ["created", "superseded", "superseded"]
    assert spark.read.parquet(paths[1]).select("batch").distinct().count() == 5


def test_hints_name_the_most_similar(spark):
    rows = [(i, f"t{i}", None, None, None, T0, None, [1.0, x]) for i, x in enumerate([0.0, 0.9, 1.2, 1.1, -0.7])]
    got = {r["seq"]: [(h["seq"], h["similarity"]) for h in r["near"]] for r in integrate.fold(spark.createDataFrame(rows, CANDIDATES)).collect()}
    assert got[0] == [] and [s for s, _ in got[2]] == [1, 0] and [s for s, _ in got[3]] == [1, 0] and [s for s, _ in got[4]] == [0]


def test_a_crash_between_the_renames_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_atomically(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old-1")  # the moment between the two renames
    store.write_atomically(spark.range(4), str(tmp_path / "other"))
    store.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "t").rename(tmp_path / "t.old-2")
    store.write_atomically(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_log_rotation(spark, tmp_path):
    df = spark.createDataFrame([(T0, "saved", None, None, None, "s", "w", None, "x" * 400)], "ts timestamp, decision string, reason string, type string, subject string, source string, scope string, client string, text string")
    path = str(tmp_path / "log")
    for _ in range(3):
        gatelog.append(df, path, 900)
    assert spark.read.json(path).count() + spark.read.json(f"{path}.1").count() == 3 if (tmp_path / "log.1").exists() else spark.read.json(path).count() == 3
    gatelog.append(df, path, 1)
    assert spark.read.json(path).count() == 1 and (tmp_path / "log.1").exists()
