"""The training-data operators against brute force on small, dirty inputs."""

import collections
import datetime as dt
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import bktree, history, leaks, neighbours, pii, split, survivors, tokens
from recordloom.llm import setjoin as S
from recordloom.llm.words import scope_key, words

HAVE_TOKENIZER = os.path.exists(tokens.tokenizer_path(tokens.BYTE_BPE))
needs_tokenizer = pytest.mark.skipif(not HAVE_TOKENIZER, reason="needs the public tokenizer's files")
VOCAB = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(3000)]


def clashing(df):
    """Columns whose names the operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("ck", "words", "key", "a", "b", "r", "ord", "g", "row_key", "start", "block", "task", "cos") if c not in df.columns})


def texts(rng, n):
    """Texts of common and rare words, many of them edited copies of earlier ones, with nulls and blanks."""
    out = []
    for _ in range(n):
        k = rng.random()
        if k < 0.05:
            out.append(rng.choice([None, "", "  ", "short one", "x"]))
        elif k < 0.5 and out and (base := rng.choice(out)):
            w = base.split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(VOCAB)
            if rng.random() < 0.3:
                rng.shuffle(w)
            out.append(rng.choice([" ", "  ", ", "]).join(w))
        else:
            out.append(" ".join(rng.choice(VOCAB) for _ in range(rng.randint(6, 25))))
    return out


def near(a, b, t=0.7):
    return len(a & b) >= t * len(a | b) - 1e-9


# ---- words and set joins ----------------------------------------------------------------------


def test_words():
    assert words(None) == words("") == words(" ​!") == []
    assert words("Ｆｕｌｌ_Width ½ Éa") == ["full", "width", "1", "2", "éa"]
    assert scope_key(None) == scope_key("  ") == "default" and scope_key(" Work ") == "work"


def test_keys_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for hot in (0, 5, 10**9):
        freq = rng.integers(0, 20, S.BUCKETS).astype(np.int32)
        for _ in range(60):
            n = int(rng.integers(1, 40))
            a = np.unique(rng.integers(-(2**62), 2**62, n))
            b = a.copy()
            for _ in range(int(rng.integers(0, 5))):
                b[rng.integers(len(b))] = rng.integers(-(2**62), 2**62)
            b = np.unique(b)
            if not near(set(a.tolist()), set(b.tolist())):
                continue
            keys = [set(S.key_rows(x, np.array([0, len(x)]), freq, hot, 0.7)[1].tolist()) for x in (a, b)]
            assert keys[0] & keys[1]
            d = len(set(a.tolist()) ^ set(b.tolist()))
            sk = S.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
            assert S.hamming(sk[:1], sk[1:])[0] <= d <= S.radius(np.array([len(a)]), np.array([len(b)]), 0.7)[0]


# ---- p4 ---------------------------------------------------------------------------------------


def memories(spark, rows):
    return spark.createDataFrame(rows, "seq long, text string, scope string")


def test_near_pairs_and_groups(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LEAST", 8)  # so that hot keys are split on small data, too
    monkeypatch.setattr(S, "HOT_SHARE", 10**9)
    rng = random.Random(2)
    rows = [(i, t, rng.choice([None, "a", " A ", "b"])) for i, t in enumerate(texts(rng, 700))]
    df = clashing(memories(spark, rows))
    got = [tuple(r) for r in bktree.near_pairs(df).collect()]
    sets = [(i, scope_key(s), set(words(t))) for i, t, s in rows]
    sets = [x for x in sets if len(x[2]) >= 8]
    want = {(x[0], y[0]) for i, x in enumerate(sets) for y in sets[i + 1 :] if x[1] == y[1] and near(x[2], y[2])}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    label = {i: i for i, _, _ in sets}
    for _ in range(40):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    # keys cut into blocks give the same
    monkeypatch.setattr(S, "SHARD_MOST", 4)
    monkeypatch.setattr(S, "CHUNK_ROWS", 50)
    monkeypatch.setattr(bktree, "CLASS_BLOCK", 2)  # classes dealt to several blocks
    again = [tuple(r) for r in bktree.near_pairs(df).collect()]
    assert len(again) == len(set(again)) and set(again) == want
    first = {}
    for i, s, w in sets:
        first.setdefault((s, frozenset(w)), i)
    rep = {i: first[s, frozenset(w)] for i, s, w in sets}
    assert {tuple(r) for r in bktree.near_links(df).collect()} == {(rep[a], rep[b]) if rep[a] < rep[b] else (rep[b], rep[a]) for a, b in want if rep[a] != rep[b]}
    assert {r["seq"]: r["class_seq"] for r in bktree.near_groups(df).collect()} == rep
    groups = {r["seq"]: r["group_seq"] for r in bktree.near_groups(df).collect()}
    assert groups == label


def test_near_pairs_without_rows(spark):
    empty = memories(spark, [(1, None, None), (2, "", "a")])
    assert bktree.near_pairs(empty).count() == bktree.near_pairs(empty.limit(0)).count() == bktree.near_groups(empty.limit(0)).count() == 0


def test_forest_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    sketch[150:] = sketch[:150] ^ (np.uint64(1) << rng.integers(0, 60, (150, 2)).astype(np.uint64))
    shard = np.sort(rng.integers(0, 6, 300))
    size = rng.integers(8, 40, 300)
    found = {(int(max(a, b)), int(min(a, b))) for x, y in bktree.Forest(shard, sketch).search(np.arange(300), size, 0.7) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(300) for j in range(i) if shard[i] == shard[j] and S.hamming(sketch[i : i + 1], sketch[j : j + 1])[0] <= S.radius(size[i : i + 1], size[j : j + 1], 0.7)[0]}
    assert found == want


def test_keys_are_read_whole_in_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(6)
    for _ in range(50):
        key = np.sort(rng.integers(0, rng.integers(1, 30), 60))
        ck = rng.integers(0, 40, 60)
        names = ["key", "ck", "n", "s0", "s1", "side"]
        table = pa.table({"key": key, "ck": ck, "n": rng.integers(1, 9, 60).astype(np.int32), "s0": ck, "s1": ck, "side": np.zeros(60, np.int32)}).select(names)
        parts = list(S.by_keys(iter(table.to_batches(max_chunksize=int(rng.integers(1, 20))))))
        seen = [set(p["key"].to_pylist()) for p in parts]
        assert not any(a & b for i, a in enumerate(seen) for b in seen[i + 1 :])
        assert {(k, c) for p in parts for k, c in zip(p["key"].to_pylist(), p["ck"].to_pylist(), strict=True)} == set(zip(key.tolist(), ck.tolist(), strict=True))


# ---- p3 ---------------------------------------------------------------------------------------


def expected_cases(store, items):
    seen = [set(words(t)) for t in store]
    out = set()
    for b, p, t in sorted(items, key=lambda x: x[:2]):
        w = set(words(t))
        if len(w) >= 8 and any(near(w, x) for x in seen):
            out.add((b, p))
        else:
            seen.append(w)
    return out


def test_batches_against_history(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "HOT_LEAST", 8)
    rng = random.Random(5)
    all_ = texts(rng, 500)
    store, rest = all_[:250], all_[250:]
    cuts = sorted(rng.sample(range(250), 3))
    batches = [rest[a:b] for a, b in zip([0, *cuts], [*cuts, 250], strict=True)] + [[], None]
    memory = spark.createDataFrame([(i, t) for i, t in enumerate(store)], "seq long, text string")
    envelopes = spark.createDataFrame([(i + 1, None if b is None else [(t,) for t in b]) for i, b in enumerate(batches)], "batch_no long, memories array<struct<text:string>>")
    items = [(i + 1, p, t) for i, b in enumerate(batches) for p, t in enumerate(b or [])]
    want = expected_cases(store, items)
    assert {tuple(r) for r in history.found(clashing(memory), envelopes).collect()} == want and want
    monkeypatch.setattr(S, "SHARD_MOST", 4)  # keys cut into blocks
    monkeypatch.setattr(history, "RANGE_KEYS", 500)  # several ranges
    monkeypatch.setattr(history, "RANGE_SETS", 64)
    monkeypatch.setattr(history, "BLOCK_ROWS", 600)  # several blocks of a batch
    monkeypatch.setattr(history, "MOST_RUNS", 3)  # so that runs are merged on the way
    monkeypatch.setattr(history, "ROUNDS", 1)  # what is open after a round is resolved in order
    # one batch after another gives the same, each by an index of its own that takes up the folder
    path = f"file://{tmp_path}/index"
    history.HistoryIndex(spark, path).start(memory)
    got, most = set(), 0
    for i in range(1, len(batches) + 1):
        index = history.HistoryIndex(spark, path)
        out = index.ingest(history.batch_items(envelopes.where(F.col("batch_no") == i)))
        got |= {(r["batch_no"], r["pos"]) for r in out.where("is_case").collect()}
        most = max(most, len(index.runs))
    assert got == want and most == 3
    index.compact()
    assert len(index.runs) == 1
    # texts that were accepted, and edits of them, are cases for whoever opens the folder
    again = [(9, i, t) for i, t in enumerate(store)]
    hit = {r["pos"] for r in history.HistoryIndex(spark, path).ingest(spark.createDataFrame(again, "batch_no long, pos long, text string")).where("is_case").collect()}
    assert hit == {i for i, t in enumerate(store) if len(set(words(t))) >= 8}
    with pytest.raises(ValueError, match="similarity"):
        history.HistoryIndex(spark, path, similarity=0.8)


def test_a_small_batch_reads_the_ranges_it_has_keys_in(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(history, "RANGE_KEYS", 100)
    monkeypatch.setattr(history, "RANGE_SETS", 100)
    rng = random.Random(8)
    memory = spark.createDataFrame([(" ".join(f"x{rng.randrange(10**6)}" for _ in range(12)),) for _ in range(2000)], "text string")
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index").start(memory)
    text = memory.head()[0].rsplit(" ", 1)[0] + " other"
    ranges = {}
    plain = history.HistoryIndex._table
    monkeypatch.setattr(history.HistoryIndex, "_table", lambda self, kind, *a: ranges.setdefault(kind, plain(self, kind, *a)))
    assert [tuple(r) for r in index.ingest(spark.createDataFrame([(1, 0, text)], "batch_no long, pos long, text string")).collect()] == [(1, 0, True)]
    size = lambda files: sum(os.path.getsize(f.removeprefix("file://")) for f in files)
    run = index.runs[0]
    for kind, share in (("keys", 0.1), ("sets", 0.15)):
        whole = spark.read.parquet(f"file://{tmp_path}/index/{kind}/{run}").inputFiles()
        scanned = [r[0] for r in ranges[kind].select(F.input_file_name()).distinct().collect()]
        assert "PartitionFilters: [" in (plan := ranges[kind]._jdf.queryExecution().toString()) and "range" in plan
        assert 0 < size(scanned) < share * size(whole)


def test_a_crash_while_ingesting_leaves_the_state_before(spark, monkeypatch, tmp_path):
    text = "one two three four five six seven eight nine"
    items = spark.createDataFrame([(1, 0, text)], "batch_no long, pos long, text string")
    index = history.HistoryIndex(spark, f"file://{tmp_path}/index").start(spark.createDataFrame([("a b c d e f g h i j k",)], "text string"))

    def crash(*_, **__):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(history.Manifest, "commit", crash)
        with pytest.raises(RuntimeError, match="crash"):
            index.ingest(items)
    for case in (False, True):
        assert [tuple(r) for r in history.HistoryIndex(spark, f"file://{tmp_path}/index").ingest(items).collect()] == [(1, 0, case)]


def test_a_chain_of_edits_is_resolved_in_one_task(spark, monkeypatch):
    w = [f"w{i}" for i in range(90)]
    chain = [(1, i, " ".join(w[2 * i : 2 * i + 16])) for i in range(37)]  # each similar to the next only
    df = spark.createDataFrame(chain, "batch_no long, pos long, text string")
    rounds = []
    plain = history.HistoryIndex._rounds
    monkeypatch.setattr(history.HistoryIndex, "_rounds", staticmethod(lambda now, later, most: rounds.append(most) or plain(now, later, most)))
    got = {r["pos"] for r in history.HistoryIndex(spark).ingest(df).where("is_case").collect()}
    assert got == {p for _, p in expected_cases([], chain)} == set(range(1, 37, 2)) and rounds == [history.ROUNDS, None]


def test_history_that_is_empty(spark):
    none = spark.createDataFrame([], "seq long, text string")
    one = spark.createDataFrame([(1, [("a b c d e f g h",), ("a b c d e f g h i",), (None,)])], "batch_no long, memories array<struct<text:string>>")
    assert {tuple(r) for r in history.found(none, one).collect()} == {(1, 1)}
    assert history.found(none, one.limit(0)).count() == 0


# ---- p1 ---------------------------------------------------------------------------------------


def brute_neighbours(rows, k=10, least=0.85):
    good = [(s, np.array(v, float)) for s, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    if not good:
        return set()
    seq, v = np.array([s for s, _ in good]), np.stack([x / np.linalg.norm(x) for _, x in good])
    out = set()
    for i in range(len(seq)):
        c = np.round(v @ v[i], 6)
        c[i] = -9
        for j in np.lexsort((seq, -c))[:k]:
            if c[j] >= least:
                out.add((int(min(seq[i], seq[j])), int(max(seq[i], seq[j]))))
    return out


def vectors(rng, n):
    base = rng.standard_normal((n, 64))
    for i in range(n // 3, n):
        if rng.random() < 0.6:
            base[i] = base[rng.integers(i)] + rng.standard_normal(64) * rng.choice([0.0, 0.1, 0.3, 0.5])
    rows = [(int(i), [float(x) for x in v * rng.choice([1.0, 2.0, 0.5])]) for i, v in enumerate(base)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 64), (n + 3, [1.0] * 32), (n + 4, [None] * 64), (n + 5, [float("nan")] * 64)]
    rows += [(n + 10 + i, rows[5][1]) for i in range(30)]  # one vector very often
    return rows


def test_neighbours_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = vectors(rng, 900)
    df = clashing(spark.createDataFrame(rows, "seq long, embedding array<double>"))
    want = brute_neighbours(rows)
    got = [tuple(r) for r in neighbours.found(df).collect()]
    assert len(got) == len(set(got))
    assert len(set(got) & want) >= 0.98 * len(want) and len(set(got) - want) <= 0.02 * len(want)
    # cells cut into blocks give the same
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    assert {tuple(r) for r in neighbours.found(df).collect()} == set(got)


def test_cells_that_grow_with_the_data(monkeypatch, spark):
    """With the number of cells held down: what is filed of a vector stays the same, what it is compared with grows little, and recall stays."""
    rng = np.random.default_rng(31)
    monkeypatch.setattr(neighbours, "MOST_CELLS", 2)
    monkeypatch.setattr(neighbours, "CELL", 200)
    monkeypatch.setattr(neighbours, "SPLIT", 600)
    compared, filed = [], []
    plain = neighbours.similar_pairs

    def counting(v, codes, left, right, low):
        compared[-1] += len(left) * len(right)
        return plain(v, codes, left, right, low)

    monkeypatch.setattr(neighbours, "similar_pairs", counting)
    centres = rng.standard_normal((400, 64))
    for n in (1500, 6000, 24000):
        v = centres[rng.integers(0, 400, n)] + 0.35 * rng.standard_normal((n, 64))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        compared.append(0)
        every = np.arange(n)
        found = {(min(a, b), max(a, b)) for i, j, c in neighbours.cell_pairs(v, every, every, 10, 0.85) for a, b, x in zip(i.tolist(), j.tolist(), c.tolist(), strict=True) if x >= 0.85}
        asked = rng.choice(n, 200, replace=False)
        want = set()
        for a in asked.tolist():
            cos = v @ v[a]
            cos[a] = -2
            want |= {(min(a, b), max(a, b)) for b in np.argsort(-cos)[:10].tolist() if cos[b] >= 0.85}
        assert len(found & want) >= 0.97 * len(want)
    assert compared[2] / 24000 < 2.5 * compared[1] / 6000
    # through Spark: rows filed per vector don't depend on the size of cells
    rows = [(i, x.tolist()) for i, x in enumerate(v[:4000])]
    got = {tuple(r) for r in neighbours.found(spark.createDataFrame(rows, "seq long, embedding array<double>")).collect()}
    want = brute_neighbours(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_nearest_of_vectors_without_close_ones(spark, monkeypatch):
    rng = np.random.default_rng(33)
    v = rng.standard_normal((500, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "seq long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.neighbours(df, k=5, least=-1.0).collect():
        got[r["seq"]].add(r["other"])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    np.fill_diagonal(cos, -2)
    want = {i: set(np.argsort(-cos[i], kind="stable")[:5].tolist()) for i in range(500)}
    assert all(len(x) == 5 for x in got.values()) and sum(len(got[i] & want[i]) for i in want) >= 0.99 * 2500
    # a dense cloud: only what may be among the k best is reranked
    dense = np.full(64, 1.0) + 0.2 * rng.standard_normal((3000, 64))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    every = np.arange(3000)
    parts = list(neighbours.cell_pairs(dense, every, every, 10, 0.85))
    assert sum(len(i) for i, _, _ in parts) < 0.1 * 3000 * 2999 / 2
    cos = np.round(dense @ dense.T, 6)
    np.fill_diagonal(cos, -2)
    found = {(a, b) for i, j, _ in parts for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(min(i, j), max(i, j)) for i in range(3000) for j in np.argsort(-cos[i], kind="stable")[:10].tolist()}
    assert len({(min(x), max(x)) for x in found} & want) >= 0.99 * len(want)


def test_neighbours_without_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0] * 64)], "seq long, embedding array<double>")
    assert neighbours.found(df).count() == neighbours.found(df.limit(0)).count() == 0


def test_codes_bound_and_packing():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((400, 64))
    v[200:] = v[:200] + 0.4 * rng.standard_normal((200, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.abs(neighbours.unpack(neighbours.pack(v), 64) - v).max() < 1e-7
    every = np.arange(400)
    codes = neighbours.Codes(v, v.mean(axis=0), neighbours.turn(64))
    found = {(int(i), int(j)) for a, b, _ in neighbours.similar_pairs(v, codes, every, every, np.full(400, 0.85)) for i, j in zip(a, b, strict=True)}
    i, j = np.nonzero(np.triu(v @ v.T, 1) >= 0.85)
    want = set(zip(i.tolist(), j.tolist(), strict=True))
    assert want <= found or len(want - found) <= 0.005 * len(want)


# ---- p2 ---------------------------------------------------------------------------------------

PII = [
    ("Mail goes to ann.lee+x@mail.example first.", {"email"}), ("write ann (at) uni (dot) test", {"email"}), ("see ann[at]uni.test", {"email"}), ("ann＠uni.test", {"email"}), ("Runs as root@localhost.", set()), ("Ping @lantern", set()),
    ("Tel. +1 (212) 555-0140", {"phone"}), ("ring 0491 570 166 before", {"phone"}), ("Mobile: 07700900321", {"phone"}), ("Call 020 7946 0534", {"phone"}), ("Tel. 06 39 98 96 07", {"phone"}), ("Order 7700-4471-220 shipped.", set()), ("Version 2025.10.31-2.", set()),
    ("passport no. AK0008884;", {"id_number"}), ("Steuer-ID 00 532 710 947", {"id_number"}), ("SSN: 666 77 1854", {"id_number"}), ("tax id 000-796-279", {"id_number"}), ("Ticket 204-11-9982 is closed.", set()), ("DNI 12345678Z", {"id_number"}),
    ("Lives at 33a Zellel Road, Flat 2", {"address"}), ("PO Box 1117, Rome", {"address"}), ("Nettstraße 12, 67129 Ort", {"address"}), ("63, rue des Lilas", {"address"}), ("Calle Mayor 97, 3º B", {"address"}), ("Route 61 North playlist.", set()), ("Exit 24 Street mode first.", set()),
    ("Met Mirella Stone last spring.", {"name"}), ("MIRELLA STONE", {"name"}), ("mirella stone", {"name"}), ("Stone, Mirella", {"name"}), ("Dr. Stone called", {"name"}), ("Reports to Orla Quint.", {"name"}), ("The Amber Desk theme stays.", set()),
    (None, set()), ("", set()), ("plain words only", set()), ("a" * 200_000, set()),
]


def test_pii_cases():
    found = pii.Detector(["Mirella", None, " "])
    for text, kinds in PII:
        assert {s.kind for s in found.spans(text)} == kinds, text


ADVERSE = {
    "dots before an at sign": "a." * 50_000 + "a@ ", "letters before an at sign": "a" * 100_000 + "@", "letters behind an address": "x@y.z " + "a" * 100_000, "labels": "a@" + "b.1" * 33_000, "at signs": ("a" * 10 + "@") * 9_000, "spelled dots": "a [dot] " * 12_000 + "@b.cc",
    "spelled at signs": " at a" * 20_000, "addresses": "ann@uni.test " * 8_000, "hyphens": "A-" * 50_000 + " 1", "given names": "ann-" * 25_000, "cues": "met A" + "-A" * 50_000, "id words": "SSN 1 " * 16_000, "phones": "020 7946 0534 " * 7_000, "digits": "1 " * 50_000, "capitals": "ssn " + "A" * 100_000, "streets": "1 A" + ".A" * 48_000 + " street",
}


@pytest.mark.parametrize("name", ADVERSE)
def test_pii_reads_adverse_texts_in_linear_time(name):
    found = pii.Detector(["Ann"])
    began = time.process_time()
    found.spans(ADVERSE[name])
    assert time.process_time() - began < 1.5  # 100 KB; below 1 s on an idle machine


# Sentences of other makes than the test tables': whole names that the list has, and that only a word before announces.
SENTENCES = [
    "My sister Ilka Brandt plays the oboe.", "Yesterday our neighbour Tomas Ridge fixed the fence.", "Dear Hanne Vogt, the parcel came.", "We had lunch with Anna Kowal near the lake.", "Anna Kowal and her dog moved out.", "The form was signed by Peer Lund in March.",
    "Prof. Amsel gave the talk.", "ask Frau Winter about the keys", "It was Mr Okoro who rang.", "His lawyer Dana Whitlock wrote back.", "anna kowal has the spare key", "Kowal, Anna is on the list.", "Sincerely, Rita Moss", "the landlord Otto Brehm lives upstairs",
]
NO_NAMES = [
    "Dear diary, it rained all day.", "My friend likes long walks.", "The coach left at noon.", "Our teacher praised the Blue Team's effort.", "They met late on Friday evening.", "we met some people there", "Mother Nature was kind to us.", "He reports to nobody.", "The son of a baker, he bakes.", "Annapolis is a town.", "Rows are signed by default.", "A dentist works next door.",
]


def test_pii_names_in_other_sentences():
    found = pii.Detector(["Anna", "Peer"])
    hit = [any(s.kind == "name" for s in found.spans(t)) for t in SENTENCES]
    wrong = [t for t in NO_NAMES if any(s.kind == "name" for s in found.spans(t))]
    assert sum(hit) >= 0.9 * len(hit), [t for t, h in zip(SENTENCES, hit, strict=True) if not h]
    assert len(wrong) <= 1, wrong


def test_pii_hints_are_implied_by_their_patterns():
    found = pii.Detector(["Mirella"])
    for text, kind in (("SIN: 046-454-286", "id_number"), ("SIN #046 454 286", "id_number"), ("Dr.\u00a0Stone called", "name"), ("Lindenweg12 is it", "address"), ("Lives at 63,\u00a0rue des Lilas", "address"), ("PO Box\t1117", "address"), ("a.b. dot c@d.test", "email")):
        assert kind in {s.kind for s in found.spans(text)}, text


def test_pii_masks_and_validators(spark):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    found = pii.Detector([])
    t = "To a@b.test or IBAN GB82 WEST 1234 5698 7654 32 and card 4111 1111 1111 1111."
    assert pii.mask(t, found.spans(t)) == "To [EMAIL] or IBAN [IBAN] and card [CARD]."
    rows = [(i, t) for i, (t, _) in enumerate(PII)] + [(0, PII[0][0])]
    df, names = clashing(spark.createDataFrame(rows, "seq long, text string")), spark.createDataFrame([("Mirella",), (None,)], "given string")
    want = collections.Counter((i, k) for i, (_, kinds) in enumerate(PII) for k in kinds) + collections.Counter({(0, "email"): 1})
    assert collections.Counter(tuple(r) for r in pii.kinds(df, "seq", names).collect()) == want
    out = pii.detect(df, "seq", names)
    assert out.where("masked is null").count() == 1 and pii.detect(df.limit(0), "seq", names).count() == 0


# ---- p6 ---------------------------------------------------------------------------------------


def test_survivors(spark):
    rng = random.Random(9)
    body = ["one two three four five six seven eight", "One, two three four five six seven eight!", "b c d e f g h i j", "too short", None]
    sources = ["user-explicit", " USER_EXPLICIT ", "user confirmed", "agent-inferred", "robot", None]
    subjects = ["tea", None, " ", "N/A", "unknown", "coffee"]
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, rng.choice(body), rng.choice([None, "a", "A "]), rng.choice(sources), rng.choice(subjects), rng.choice([None, t0, t0 + dt.timedelta(days=1)]), "state", "active") for i in range(60)]
    df = clashing(spark.createDataFrame(rows, "seq long, text string, scope string, source string, subject string, updated_at timestamp, type string, status string"))
    by = collections.defaultdict(list)
    for r in rows:
        if len(set(words(r[1]))) >= 8:
            by[scope_key(r[2]), tuple(words(r[1]))].append(r)
    trust = {"userexplicit": 3, "userconfirmed": 2, "agentinferred": 1}
    order = lambda r: (trust.get(re.sub(r"[\s_-]", "", (r[3] or "").lower()), 0), r[5] or dt.datetime(1900, 1, 1), -r[0])
    want = set()
    for g in by.values():
        if len(g) > 1:
            named = [r for r in g if r[4] and r[4].strip().lower() not in ("", "none", "n/a", "unknown")]
            want.add((min(r[0] for r in g), max(g, key=order)[0], max(g, key=lambda r: order(r)[1:])[0], max(named, key=order)[0] if named else -1))
    assert {tuple(r) for r in survivors.found(df).collect()} == want and len(want) > 2
    voted = {r["group_seq"]: r for r in survivors.survivors(df).collect()}
    assert set(voted) == {w[0] for w in want} and all(r["type"] == "state" for r in voted.values())
    # the votes, counted again: trust times decay, summed per value; the value is shown as its best row has it
    latest = max(r[5] for r in rows if r[5])
    weight = lambda r: round((1 + trust.get(re.sub(r"[\s_-]", "", (r[3] or "").lower()), 0)) * 2 ** (-((latest - r[5]).days if r[5] else 3650) / 180), 12)
    for g in (g for g in by.values() if len(g) > 1):
        for column, name in ((3, "source"), (4, "subject")):
            votes = collections.defaultdict(list)
            for r in g:
                if r[column] is not None and not (name == "subject" and r[4].strip().lower() in ("", "none", "n/a", "unknown")):
                    votes[re.sub(r"[\s_-]+", "-", r[column].strip(" ").lower())].append((weight(r), -r[0], r[column]))
            best = max(votes.values(), key=lambda v: (round(sum(x[0] for x in v), 9), max(v)), default=[(0, 0, None)])
            assert voted[min(r[0] for r in g)][name] == max(best)[2]
    assert survivors.found(df.limit(0)).count() == survivors.survivors(df.limit(0)).count() == 0


# ---- p7, p9 -----------------------------------------------------------------------------------

ODD = ["", "Hello world, it's 2025!", "a" * 5000, "\n\n \t\n  x", "漢字かな交じり文", "naïve café ½ 😀👍🏽", "<|endoftext|> is text", "the" * 50, "\u0000​﻿", "1234567890" * 30, "  trailing  "]


@needs_tokenizer
def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path(tokens.BYTE_BPE))
    library.encode_special_tokens = True
    rng = random.Random(10)
    letters = "aàbeéinorst TIE09.,'\n漢字😀"
    rows = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000))]
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    df = clashing(spark.createDataFrame([*enumerate(rows), (len(rows), None)], "doc_id long, text string"))
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encoded(df).collect()}
    assert got == dict(enumerate([*want, []]))
    assert tokens.encoded(df.limit(0)).count() == 0


@needs_tokenizer
def test_pairs_apart_equal_merging():
    bpe = tokens.ByteBPE.load(tokens.tokenizer_path(tokens.BYTE_BPE))
    raw = {i: t for t, i in bpe.vocab.items()}
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 50000, 3000), rng.integers(0, 50000, 3000)
    a[:1000], b[:1000] = rng.integers(0, 600, 1000), rng.integers(0, 600, 1000)
    got = bpe.apart(a, b)
    for x, y, g in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        if bpe.merged(raw[x]) == [x] and bpe.merged(raw[y]) == [y]:
            assert g == (bpe.merged(raw[x] + raw[y]) == [x, y])


@needs_tokenizer
def test_split(spark):
    bpe = tokens.ByteBPE.load(tokens.tokenizer_path(tokens.BYTE_BPE))
    rng = random.Random(12)
    sentence = lambda: " ".join(rng.choice(VOCAB) for _ in range(rng.randint(3, 20))) + rng.choice([". ", "! ", "\n", "\n\n", "\n# Head\n"])
    rows = [*ODD, *("".join(sentence() for _ in range(rng.randint(1, 60))) for _ in range(40)), "\n" * 4000, " x" * 3000, "漢" * 2000]
    df = clashing(spark.createDataFrame([*enumerate(rows), (len(rows), None)], "doc_id long, text string"))
    for limit, overlap in ((100, 20), (30, 0), (7, 3)):
        pieces = collections.defaultdict(list)
        for r in split.split(df, limit=limit, overlap=overlap).orderBy("doc_id", "piece_no").collect():
            pieces[r["doc_id"]].append(r)
        large = {i for i, t in enumerate(rows) if bpe.count([t])[0] > limit}
        assert set(pieces) == large
        for i, ps in pieces.items():
            assert "".join(rows[i][p["fresh"] : p["end"]] for p in ps) == rows[i]
            assert all(p["piece"] == rows[i][p["start"] : p["end"]] and p["start"] <= p["fresh"] for p in ps)
            over = [p for p in ps if p["n_tokens"] > limit]
            assert all(p["end"] - p["fresh"] <= 1 for p in over)  # a single character may be over a tiny limit
            assert all(p["n_tokens"] == bpe.count([p["piece"]])[0] for p in ps)
            shared = [bpe.count([rows[i][p["start"] : p["fresh"]]])[0] for p in ps[1:]]
            assert all(n <= overlap + 2 for n in shared) and ps[0]["start"] == ps[0]["fresh"] == 0
            # from half of the overlap up, whatever the text; a cut within a word counts anew, and a character of several tokens can't be cut
            assert all(n >= overlap // 2 - (2 if limit > 50 else overlap) for n in shared), (i, limit, shared)
    # sections just under the limit, and texts without spaces or of one run, keep the overlap, too
    part = lambda n, h: f"# {h}\n" + " ".join("word" for _ in range(n)) + ".\n"
    long = ["".join(part(n, f"h{i}") for i in range(6)) for n in (1188, 1145, 1079, 700, 90)] + ["漢字仮名" * 3000, "a" * 30_000, "ab1" * 8_000, "\n" * 5_000, " " * 9_000, "x" * 4000 + " " + "words and " * 1500]
    for i, text in enumerate(long):
        ps = split.Counted(bpe, text, atom=1080).pieces(1200, 120)
        assert "".join(text[f:e] for _, e, f, _ in ps) == text and all(n <= 1200 == bpe.count([text[s:e]])[0] or n == bpe.count([text[s:e]])[0] <= 1200 for s, e, _, n in ps)
        shared = [int(bpe.count([text[s:f]])[0]) for s, _, f, _ in ps[1:]]
        assert (len(ps) > 1) == (bpe.count([text])[0] > 1200) and all(55 <= n <= 124 for n in shared), (i, shared)
    with pytest.raises(ValueError, match="overlap"):
        split.split(df, limit=10, overlap=10)
    # natural boundaries: short paragraphs are kept whole
    text = "\n\n".join(" ".join(f"p{i}w{j}" for j in range(8)) for i in range(30))
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert all(p["piece"].startswith("p") and p["piece"].rstrip().endswith("w7") for p in split.split(one, limit=120, overlap=0).collect())


@needs_tokenizer
def test_split_where_the_cache_of_words_is_reset(monkeypatch):
    """A worker's cache that is full is reset between two texts of one block: their counts and pieces stay those of an empty cache."""
    path, rng = tokens.tokenizer_path(tokens.BYTE_BPE), random.Random(14)
    word = lambda: "".join(rng.choice("abcdeghiklmnorstuvz") for _ in range(rng.randint(4, 9)))
    rows = ["\n\n".join(" ".join(word() for _ in range(rng.randint(20, 90))) for _ in range(12)) for _ in range(20)]
    want = [split.Counted(tokens.ByteBPE.load(path), t, atom=180).pieces(200, 40) for t in rows]
    monkeypatch.setattr(tokens, "WORDS_KEPT", 500)
    bpe, resets = tokens.ByteBPE(path), []
    reset = bpe._reset
    monkeypatch.setattr(bpe, "_reset", lambda: (resets.append(1), reset()))
    got = [(int(c[1][-1]), split.Counted(bpe, t, c, 180).pieces(200, 40)) for t, c in zip(rows, bpe.word_counts(rows), strict=True)]
    assert resets and [p for _, p in got] == want
    assert [n for n, _ in got] == bpe.count(rows).tolist()


# ---- p8 ---------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(13)
    item = lambda: " ".join(rng.choice(VOCAB) for _ in range(rng.randint(5, 40)))
    items = [(i, item()) for i in range(40)] + [(40, None), (41, ""), (42, "too short")]
    items.append((43, items[3][1]))
    docs = []
    for i in range(300):
        parts = [" ".join(rng.choice(VOCAB) if rng.random() < 0.7 else f"own{rng.randrange(9999)}" for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = rng.choice(items[:40])[1].split()
            a = rng.randrange(len(w))
            parts.insert(rng.randrange(len(parts) + 1), rng.choice([" ", " - ", "\n"]).join(w[a : a + rng.randint(5, 40)]).upper())
        docs.append((i, " ; ".join(parts)))
    docs += [(300, None), (301, ""), (302, docs[0][1])]
    windows = collections.defaultdict(set)
    for k, t in items:
        w = words(t)
        for a in range(len(w) - 11):
            windows[tuple(w[a : a + 12])].add(k)
    want = {(i, k) for i, t in docs for a in range(len(words(t)) - 11) for k in windows.get(tuple(words(t)[a : a + 12]), ())}
    d, e = clashing(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in leaks.found(d, e).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert leaks.found(d, e.limit(0)).count() == leaks.found(d.limit(0), e).count() == 0


def test_paraphrases(spark):
    item = "the reviewer in Marlow counted exactly 4711 parcels before Dunmere closed its harbour office in June"
    told = "someone said the reviewer in Marlow counted about 4711 parcels before Dunmere closed the harbour office in June again"
    d = spark.createDataFrame([(1, told), (2, "nothing of the kind is told in this text about parcels")], "doc_id long, text string")
    rows = leaks.leaks(d, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["verbatim"]) for r in rows] == [(1, 9, False)] and rows[0]["lcs"] >= 10


def test_passages_are_all_windows_with_enough_item_words():
    x = np.arange(16)
    x[[7, 8]] = -1
    for front in range(3):  # item words in front move the places, not what is kept
        p = leaks.Passages([np.r_[np.arange(50, 50 + front), x].astype(np.int32)])
        assert (p.at - leaks.MARGIN).tolist() == list(range(5 + front)) and p.row.tolist() == [0] * (5 + front)
    x[9] = -1
    assert leaks.Passages([x.astype(np.int32)]).at.tolist() == [] and leaks.Passages([]).at.tolist() == []


def test_products_and_index_equal_plain_ones(monkeypatch):
    rng = np.random.default_rng(19)
    lists = [rng.integers(-1, 9, n).astype(np.int32) for n in (30, 12, 5, 80)]
    idf, thin = rng.random(9) + 1, rng.standard_normal((9, 4))
    p = leaks.Passages(lists)
    rows = [(r, w) for r, x in enumerate(lists) for w in leaks.windows_of(x) if (w >= 0).sum() >= leaks.ENOUGH]
    a = np.array([[idf[j] * (w == j).sum() for j in range(9)] for _, w in rows])
    assert p.row.tolist() == [r for r, _ in rows]
    weighted = leaks.with_zero(thin, idf)
    assert np.allclose(p.project(weighted), a @ thin, atol=1e-4) and np.allclose(p.square(idf), (a * a).sum(axis=1))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(p.gram(idf, weighted), a.T @ (a @ thin), atol=1e-4)
    same = [i == j for i, (_, x) in enumerate(rows) for j, (_, y) in enumerate(rows) if (x == y).all()]
    assert len(set(p.hashes().tolist())) == len(rows) - (len(same) - len(rows)) // 2
    # a long text is cut into parts that have every window
    monkeypatch.setattr(leaks, "LONGEST", 40)
    long = np.arange(500)
    parts = leaks.stretches(long)
    assert all(e - s <= 40 for s, e in parts) and {i for s, e in parts for i in range(s, e - 11)} == set(range(489))
    # the index finds what comparing with every window finds
    item = np.repeat(np.arange(40), rng.integers(1, 60, 40))
    latent = np.cumsum(rng.standard_normal((len(item), 16)), axis=0) + 2 * rng.standard_normal(16)
    latent = leaks.unit(latent)
    v = leaks.unit(latent[rng.integers(0, len(latent), 300)] + 0.15 * rng.standard_normal((300, 16)))
    index = leaks.LatentIndex.of(latent, item)
    got = {(int(i), int(j)) for p_, w_, _ in index.candidates(v) for i, j in zip(p_, w_, strict=True)}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(v @ latent.T >= leaks.NEAR)), strict=True)) and len(got) > 300


def test_planted_paraphrases(spark, monkeypatch):
    rng = random.Random(23)
    items = [(i, " ".join(rng.choice(VOCAB[60:]) for _ in range(rng.randint(14, 30)))) for i in range(60)]
    docs, want = [], set()
    for n in range(300):
        k = rng.randrange(60)
        w = items[k][1].split()
        for _ in range(1 + n % 3):  # one to three words replaced, put in or left out
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["other"], [rng.choice(VOCAB)]])
        around = lambda: [rng.choice(["own", "words", rng.choice(VOCAB), f"own{rng.randrange(99)}"]) for _ in range(rng.randint(0, 30))]
        docs.append((n, " ".join([*around(), *w, *around()])))
        want.add((n, k))
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, e).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.01 * len(want), (len(got & want), len(got - want))
    monkeypatch.setattr(leaks, "BLOCK_WINDOWS", 200)  # items asked in blocks give the same
    monkeypatch.setattr(leaks, "PAIRS", 50)
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, e).collect()} == got
    monkeypatch.setattr(leaks, "MOST_ITEM_WORDS", 100)
    with pytest.raises(ValueError, match="words of items"):
        leaks.leaks(d, e)


def leaked(spark, told, *items):
    rows = leaks.leaks(spark.createDataFrame([(1, told)], "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return [(r["item_id"], r["lcs"], r["verbatim"]) for r in rows]


def test_a_paraphrase_is_not_displaced_by_a_reordered_window(spark):
    w = [f"w{i}" for i in range(12)]
    told = " ".join([*w[::-1], "other", "words", *w[:5], "replaced", *w[6:]])
    assert leaked(spark, told, " ".join(w)) == [(0, 11, False)]


def test_answers_near_a_passage_count(spark):
    w, other = [f"w{i}" for i in range(10)], [f"y{i}" for i in range(4)]
    item = " ".join([*w, "4711", "4712"])
    # the answers stand behind the only window that is similar enough, within the words around it
    told = " ".join([*w, *other, "4711", "4712"])
    rest = " ".join(f"rare{i}" for i in range(40))
    assert leaked(spark, told, item, " ".join(other) + " " + rest) == [(0, 12, False)]


def test_the_words_of_candidates_are_compared_exactly():
    rng = np.random.default_rng(17)
    near, targets = rng.integers(-1, 15, (400, 24)), rng.integers(0, 15, (400, 12))
    met, lcs = leaks.in_common(near, targets)

    def subsequence(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    assert lcs.tolist() == [subsequence(a, b) for a, b in zip(near, targets, strict=True)]
    assert [[bool(m >> j & 1) for j in range(12)] for m in met.tolist()] == np.array([np.isin(b, a) for a, b in zip(near, targets, strict=True)]).tolist()
    for a, b in zip(near, targets, strict=True):
        for x, y in ((a, b), (a[:5], b)):
            runs = {n for n in range(1, 13) for i in range(len(x)) for j in range(len(y)) if len(x[i : i + n]) == n and (x[i : i + n] >= 0).all() and x[i : i + n].tolist() == y[j : j + n].tolist()}
            assert leaks.longest_run(x, y) == max(runs, default=0)
    assert sum((list(range(9))[s] for s in leaks.blocks(np.array([3, 1, 1, 9, 1, 1, 1, 1, 1]), 4)), []) == list(range(9)) and leaks.blocks(np.zeros(0, int), 4) == []


def test_pn_queries_are_listed():
    from recordloom.llm import queries

    names = queries.queries()
    assert all(re.fullmatch(r"p\d+_\w+", n) for n in names)
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 8, 9)} | {"p7_ids"} <= set(names)
