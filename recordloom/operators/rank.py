"""Recall: ranking stored records for queries.

Queries are sent to every task in blocks of BLOCK_QUERIES; records are scored where they are
read, each task keeps its best rows per query, and only those are shuffled. Scores are fuzzy-lexical,
blended with the cosine of vectors where the query has one. Ties go to the smaller seq.

Null texts score as empty (0). A blank query asks for the most recent records by seq instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.text import FUZZY_FLOOR, STOPWORDS, fold_text
from recordloom.functions.vectors import LEXICAL_WEIGHT, SEMANTIC_WEIGHT
from recordloom.operators.groups import components
from recordloom.operators.integrate import unit
from recordloom.operators.normalize import DUPLICATE_AT, LEXICAL_AT, RELATED_AT, SEMANTIC_AT, live, scope_key
from recordloom.session import stored

BLOCK_QUERIES = 10_000
SCORES_AT_ONCE = 4_000_000  # entries of a matrix
BLOCK_HELD = 65_536  # records of a scope that one task compares with a block of queries
TOKEN_WEIGHT, TRIGRAM_WEIGHT, TYPE_BOOST = 0.75, 0.25, 0.15
_SINGLES = "⺀-⿟々〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺヽ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-龎\U00020000-\U0003FFFF"
_WORD = re.compile(f"[{_SINGLES}]|[^\\W_{_SINGLES}]+")
_STOP = frozenset(STOPWORDS)


def stem_of(word: str) -> str:
    """As functions.text.stem."""
    for ending in ("ing", "edly", "ed", "ly"):
        if word.endswith(ending) and len(word) >= len(ending) + 3:
            word = word[: -len(ending)]
            break
    if word.endswith("ies") and len(word) >= 5:
        word = word[:-3] + "y"
    for ending in ("es", "s"):
        if word.endswith(ending) and len(word) >= len(ending) + 3:
            return word[: -len(ending)]
    return word


def stems_of(text: str) -> list[str]:
    every = _WORD.findall(fold_text(text) or "")
    return [stem_of(w) for w in ([w for w in every if w not in _STOP] or every)]


def grams_of(text: str) -> frozenset[str]:
    padded = f"  {text} "
    return frozenset(padded[i : i + 3] for i in range(len(padded) - 2))


class Asked:
    """The queries of one scope, and lexical scores of many texts for all of them at once: matrix products over the few words and trigrams the queries have."""

    def __init__(self, names: list, queries: list[str], vectors: list[np.ndarray | None]):
        self.names = np.array(names, np.int64)
        self.blank = np.array([not q.strip() for q in queries])
        stems = [stems_of(q) for q in queries]
        self.usable = np.array([bool(s) for s in stems])
        #: distinct words of the queries, and the length each has in each query
        self.words = sorted({w for s in stems for w in s})
        number = {w: i for i, w in enumerate(self.words)}
        self.lengths = np.zeros((len(self.words), len(stems)))
        for q, s in enumerate(stems):
            for w in s:
                self.lengths[number[w], q] += len(w)
        self.total = np.maximum(self.lengths.sum(axis=0), 1)
        self.grams = [grams_of(w) for w in self.words]
        self.having: dict[str, list[int]] = {}
        for i, g in enumerate(self.grams):
            for x in g:
                self.having.setdefault(x, []).append(i)
        whole = [grams_of(" ".join(s)) for s in stems]
        self.gram_number = {g: i for i, g in enumerate(sorted({x for w in whole for x in w}))}
        self.whole = np.zeros((len(self.gram_number), len(stems)), np.float32)
        for q, w in enumerate(whole):
            self.whole[[self.gram_number[x] for x in w], q] = 1
        self.whole_size = np.array([len(w) for w in whole])
        self.types = {t: np.array([stem_of(t) in s for s in stems]) for t in ("identity", "project", "preference", "state")}
        self.by_length: dict[int, np.ndarray] = {}
        for q, v in enumerate(vectors):
            if v is not None:
                self.by_length.setdefault(len(v), np.zeros((len(stems), len(v))))[q] = v
        self.has_vector = np.array([v is not None for v in vectors])
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _alike(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """(words of the queries, Dice coefficients) of at least FUZZY_FLOOR."""
        out = self.known.get(word)
        if out is None:
            g, n = grams_of(word), {}
            for x in g:
                for i in self.having.get(x, ()):
                    n[i] = n.get(i, 0) + 1
            dice = {i: 1.0 if self.words[i] == word else 2 * c / (len(g) + len(self.grams[i])) for i, c in n.items()}
            dice = {i: d for i, d in dice.items() if d >= FUZZY_FLOOR}
            if len(self.known) > 200_000:
                self.known.clear()
            out = self.known[word] = (np.fromiter(dice.keys(), np.int64, len(dice)), np.fromiter(dice.values(), float, len(dice)))
        return out

    def lexical(self, stems: list[list[str]], types: list[str | None]) -> np.ndarray:
        """texts x queries."""
        best = np.zeros((len(stems), len(self.words)))
        at, word, dice = [], [], []
        shared = np.zeros((len(stems), len(self.gram_number)), np.float32)
        size = np.zeros(len(stems))
        for r, s in enumerate(stems):
            for w in set(s):
                i, d = self._alike(w)
                if len(i):
                    at.append(np.full(len(i), r))
                    word.append(i)
                    dice.append(d)
            g = grams_of(" ".join(s))
            size[r] = len(g)
            if hit := [n for x in g if (n := self.gram_number.get(x)) is not None]:
                shared[r, hit] = 1
        if at:
            np.maximum.at(best, (np.concatenate(at), np.concatenate(word)), np.concatenate(dice))
        token = best @ self.lengths / self.total
        whole = 2.0 * (shared @ self.whole) / (size[:, None] + self.whole_size)
        out = TOKEN_WEIGHT * token + TRIGRAM_WEIGHT * whole
        for t, asks in self.types.items():
            if asks.any():
                rows = np.array([x == t for x in types], bool)
                out[np.ix_(rows, asks)] = np.minimum(1.0, out[np.ix_(rows, asks)] + TYPE_BOOST)
        out[np.array([not s for s in stems], bool)] = 0
        out[:, ~self.usable] = 0
        return out

    def semantic(self, vectors: list[np.ndarray | None]) -> np.ndarray:
        out = np.zeros((len(vectors), len(self.names)))
        for n, asked in self.by_length.items():
            rows = [r for r, v in enumerate(vectors) if v is not None and len(v) == n]
            if rows:
                out[rows] += np.stack([vectors[r] for r in rows]) @ asked.T
        return out


def scored_text(text: str | None, subject: str | None) -> str:
    extra = re.sub(r"[-_]+", " ", subject) if subject else ""
    return f"{text or ''} {extra}" if extra else text or ""


HALF = 1e-9  # added before rounding to six digits, so that what ends in a half goes up however it was summed


def recall(store: DataFrame, queries: DataFrame, k: int = 5, as_of: F.Column | None = None, include_retired: bool = False) -> DataFrame:
    """(query_id, rank, seq, score, lexical, semantic): the k best records of the scope of each of queries(query_id, query, scope[, vector]).

    store(seq, text, subject, type, scope, status, expires_at[, embedding]). A query without a scope asks in the default one. More than BLOCK_QUERIES queries are asked in blocks of about that many, each in a scan of its own."""
    spark = store.sparkSession
    has_vector = "vector" in queries.columns
    asked = queries.select("query_id", F.coalesce("query", F.lit("")).alias("query"), scope_key().alias("scope"), (F.col("vector").cast("array<double>") if has_vector else F.lit(None).cast("array<double>")).alias("vector"))
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    found = None
    for i in range(blocks):
        block = asked if blocks == 1 else asked.where(F.expr(f"pmod(xxhash64(query_id), {blocks}) = {i}"))
        part = _recall(store if include_retired or as_of is None else store.where(live(as_of)), [tuple(q) for q in block.collect()], k, has_vector)  # about BLOCK_QUERIES rows
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "seq", "score", *(F.round(F.col(c) + HALF, 6).alias(c) for c in ("lexical", "semantic")))


def _recall(visible: DataFrame, asked: list[tuple], k: int, has_vector: bool) -> DataFrame:
    """(query_id, score, seq, lexical, semantic): of each task the k best of each query."""
    spark = visible.sparkSession
    shared = spark.sparkContext.broadcast(asked)
    has_embedding = "embedding" in visible.columns and has_vector
    source = visible.select("seq", "text", "subject", "type", scope_key().alias("scope"), *([F.col("embedding").cast("array<double>").alias("embedding")] if has_embedding else []))
    source = source.join(F.broadcast(spark.createDataFrame([(s,) for s in {q[2] for q in asked}], "scope string")), "scope", "left_semi").select(*source.columns)
    names = ["query_id", "score", "seq", "lexical", "semantic"]
    types = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]

    def scored(asks: Asked, rows: list[tuple]) -> list[np.ndarray]:
        """(query_id, score, seq, lexical, semantic) of the rows that qualify."""
        seq = np.array([r[0] for r in rows], np.int64)
        lexical = asks.lexical([stems_of(scored_text(r[1], r[2])) for r in rows], [r[3] for r in rows])
        semantic = asks.semantic([unit(r[4]) for r in rows]) if has_embedding else np.zeros_like(lexical)
        score = np.where(asks.has_vector, LEXICAL_WEIGHT * np.clip(lexical, 0, 1) + SEMANTIC_WEIGHT * np.clip(semantic, 0, 1), lexical)
        score = np.round(score + HALF, 6)
        # a blank query asks for the latest records
        score[:, asks.blank], lexical[:, asks.blank], semantic[:, asks.blank] = seq[:, None], 0, 0
        r, q = np.nonzero((lexical + HALF >= LEXICAL_AT) | (semantic + HALF >= SEMANTIC_AT) | asks.blank)
        return [asks.names[q], score[r, q], seq[r], lexical[r, q], semantic[r, q]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_scope: dict[str, list] = {}
        for name, query, scope, vector in shared.value:
            by_scope.setdefault(scope, []).append((name, query, unit(vector)))
        by_scope = {s: Asked(*map(list, zip(*q, strict=True))) for s, q in by_scope.items()}
        best = [np.zeros(0, t.to_pandas_dtype()) for t in types]
        for b in batches:
            columns = b.to_pydict()
            rows: dict[str, list] = {}
            for row in zip(*(columns[c] for c in ("scope", "seq", "text", "subject", "type")), columns["embedding"] if has_embedding else repeat(None)):
                rows.setdefault(row[0], []).append(row[1:])
            for scope, of_scope in rows.items():
                asks = by_scope[scope]
                step = max(64, SCORES_AT_ONCE // (len(asks.names) + len(asks.words) + len(asks.gram_number)))
                for i in range(0, len(of_scope), step):
                    best = [np.concatenate(x) for x in zip(best, scored(asks, of_scope[i : i + step]), strict=True)]
                    order = np.lexsort((best[2], -best[1], best[0]))
                    name = best[0][order]
                    first = np.maximum.accumulate(np.where(np.r_[True, name[1:] != name[:-1]], np.arange(len(name)), 0)) if len(name) else order
                    order = order[np.arange(len(name)) - first < k]
                    best = [x[order] for x in best]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(best, types, strict=True)], names=names)

    return source.mapInArrow(run, "query_id long, score double, seq long, lexical double, semantic double")


def similar(store: DataFrame, queries: DataFrame, floor: float, as_of: F.Column | None = None, block: int = 4096) -> DataFrame:
    """(seq, other_seq, similarity) of each of queries(seq, scope, embedding) with the records of its scope of at least that cosine, itself left out.

    The queries are spread over blocks of their scope, the records over parts of BLOCK_HELD, and each block meets each part once: an equi-join on (scope, block, part), not a cross join; scores are matrix products."""
    visible = store if as_of is None else store.where(live(as_of))
    side = lambda df, q: df.where("embedding is not null").select(scope_key().alias("scope"), "seq", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(q).alias("asks"))
    asks, held = side(queries, True), side(visible, False)
    counts = asks.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(held.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK_HELD).cast("int").alias("parts")), "scope")
    of = lambda n: F.expr(f"cast(pmod(xxhash64(seq), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = asks.join(counts, "scope").withColumn("block", of("blocks")).withColumn("part", every("parts"))
    held = held.join(counts, "scope").withColumn("part", of("parts")).withColumn("block", every("blocks"))
    both = asks.unionByName(held).select("scope", (F.col("block") * F.col("parts") + F.col("part")).alias("block"), "asks", "seq", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked = None, {}
        for b in batches:
            c = b.to_pydict()
            held_: dict[int, list] = {}

            def flush() -> list[tuple]:
                out = []
                for n, rows in held_.items():
                    if n in asked:
                        q = asked[n]
                        if isinstance(q, list):
                            q = asked[n] = (np.array([s for s, _ in q]), np.stack([v for _, v in q]))
                        cos = np.stack([v for _, v in rows]) @ q[1].T
                        seqs = np.array([s for s, _ in rows])
                        i, j = np.nonzero(cos >= floor - 1e-9)
                        keep = seqs[i] != q[0][j]
                        out += list(zip(q[0][j][keep].tolist(), seqs[i][keep].tolist(), cos[i, j][keep].tolist(), strict=True))
                held_.clear()
                return out

            rows: list[tuple] = []
            for scope, part, asks_, seq, e in zip(c["scope"], c["block"], c["asks"], c["seq"], c["embedding"], strict=True):
                if (scope, part) != at:
                    rows += flush()
                    at, asked = (scope, part), {}
                v = unit(e)
                if v is not None:
                    (asked if asks_ else held_).setdefault(len(v), []).append((seq, v))
            rows += flush()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["seq", "other_seq", "similarity"])

    return both.repartition("scope", "block").sortWithinPartitions("scope", "block", F.desc("asks")).mapInArrow(run, "seq long, other_seq long, similarity double").withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= floor)


def near_duplicates(store: DataFrame, as_of: F.Column | None = None, block: int = 16_384) -> DataFrame:
    """(seq, class_seq, related, duplicates): one row for each record of store(seq, scope, embedding, status, expires_at).

    related, duplicates: how many other live records of the scope have a cosine of at least RELATED_AT, DUPLICATE_AT;
    class_seq: the least seq it is connected to by duplicates, equal vectors always being of one class. Every vector
    meets every live one of its scope, so the work grows with the square of a scope."""
    length = F.expr("aggregate(embedding, 0D, (a, x) -> a + x * x)")
    alive = F.lit(True) if as_of is None else F.coalesce(live(as_of), F.lit(False))
    rows = store.select("seq", scope_key().alias("scope"), F.col("embedding").cast("array<double>").alias("embedding"), alive.cast("int").alias("alive")).withColumn("usable", F.coalesce((length > 0) & (length < float("inf")), F.lit(False)))
    nodes = stored(rows.where("usable").groupBy("scope", "embedding").agg(F.min("seq").alias("ck"), F.sum("alive").alias("n")), "vectors")
    counts = nodes.groupBy("scope").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count("*") / (4 * block)).cast("int").alias("parts"))
    of = lambda n: F.expr(f"cast(pmod(xxhash64(ck), {n}) as int)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = nodes.join(counts, "scope").withColumn("block", of("blocks")).withColumn("part", every("parts")).withColumn("asks", F.lit(True))
    held = nodes.where("n > 0").join(counts, "scope").withColumn("part", of("parts")).withColumn("block", every("blocks")).withColumn("asks", F.lit(False))
    both = asks.unionByName(held).select("scope", (F.col("block") * F.col("parts") + F.col("part")).alias("block"), "asks", "ck", "n", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, held_ = None, {}, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for d, rows_ in held_.items():
                if d not in asked:
                    continue
                q = asked[d]
                if isinstance(q, list):
                    q = asked[d] = (np.array([k for k, _, _ in q]), np.stack([v for _, _, v in q]))
                totals = np.zeros((2, len(q[0])), np.int64)
                for i in range(0, len(rows_), 512):
                    part = rows_[i : i + 512]
                    keys, n = np.array([k for k, _, _ in part]), np.array([x for _, x, _ in part])
                    cos = np.stack([v for _, _, v in part]) @ q[1].T
                    h, a = np.nonzero(cos >= RELATED_AT - 1e-6)
                    c = np.round(cos[h, a], 6)
                    keep = (keys[h] != q[0][a]) & (c >= RELATED_AT)
                    h, a, c = h[keep], a[keep], c[keep]
                    near = c >= DUPLICATE_AT
                    totals[0] += np.bincount(a, n[h], len(q[0])).astype(np.int64)
                    totals[1] += np.bincount(a[near], n[h[near]], len(q[0])).astype(np.int64)
                    yield made(q[0][a[near]], keys[h[near]], np.zeros((2, int(near.sum())), np.int64))
                some = np.flatnonzero(totals[0])
                yield made(q[0][some], None, totals[:, some])
            held_.clear()

        def made(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array(n[0]), pa.array(n[1])], names=["a", "b", "related", "duplicates"])

        for batch in batches:
            vectors = batch.column(5)
            offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)
            for i, (scope, part, asks_, k, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(5)), strict=True)):
                if (scope, part) != at:
                    yield from flush()
                    at = (scope, part)
                    asked.clear()
                v = flat[offsets[i] : offsets[i + 1]]
                (asked if asks_ else held_).setdefault(len(v), []).append((k, n, v / np.linalg.norm(v)))
            yield from flush()

    met = stored(both.repartition("scope", "block").sortWithinPartitions("scope", "block", F.desc("asks")).mapInArrow(run, "a long, b long, related long, duplicates long"), "near")
    edges = met.where("b is not null").select("a", "b")
    named = nodes.select("ck", F.col("ck").alias("group_seq"))
    both_ways = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    groups = components(both_ways, named)
    totals = met.where("b is null").groupBy(F.col("a").alias("ck")).agg(F.sum("related").alias("related"), F.sum("duplicates").alias("duplicates"))
    each = nodes.join(groups, "ck").join(totals, "ck", "left").select("scope", "embedding", "n", "group_seq", "related", "duplicates")
    own = lambda c: F.coalesce(c, F.lit(0)) + F.col("n") - F.col("alive")  # noqa: E731 - equal vectors
    found = rows.where("usable").join(each, ["scope", "embedding"]).select("seq", F.col("group_seq").alias("class_seq"), own(F.col("related")).alias("related"), own(F.col("duplicates")).alias("duplicates"))
    return found.unionByName(rows.where("not usable").select("seq", F.col("seq").alias("class_seq"), F.lit(0).cast("long").alias("related"), F.lit(0).cast("long").alias("duplicates")))


def recent(store: DataFrame, k: int = 5, as_of: F.Column | None = None) -> DataFrame:
    """The k latest visible records of each scope by seq."""
    visible = store if as_of is None else store.where(live(as_of))
    w = Window.partitionBy("scope_key").orderBy(F.desc("seq"))
    return visible.withColumn("scope_key", scope_key()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
