"""Evaluation texts leaking into training text: latent semantic retrieval.

1. One scan of the documents counts, over all of them, how many use each word of the items, and keeps
   the stretches in which at least ENOUGH of every RUN words in a row are words of the items; nothing
   else can hold a passage. Passages are the windows of RUN words of these stretches, all of them.
2. A distributed randomised SVD of the TF-IDF passages: tasks multiply their share of A'A with a thin
   random matrix and add up in two steps, so that no task has more than SUMMED partial sums; the driver
   only sees vocabulary x RANK numbers; one power step, then the basis.
3. Passages are compared with the windows of the items by cosine in the latent space, through an index:
   GROUP consecutive windows of an item have a centre and a greatest angle to it, groups are in cells that
   have the same. By the triangle inequality only cells and groups within reach are opened, so the index
   finds all that comparing with every window would. Equal windows have bitwise equal vectors, so a
   passage of RUN words in common has a cosine of 1 and can't be missed.
4. Candidates are checked on the words, at each of their places, best cosine first, until one passes:
   the longest common subsequence of the item's window and the passage with RUN / 2 words on either
   side, and the answers, the numbers and rarest words of the window, that are repeated there; a window
   repeated as a whole needs no answers. Before that, 64-bit signatures of the words and of the answers
   tell which candidates lack too many to pass. The longest run in common makes a pair verbatim (RUN words
   or more).

Null, empty and short texts leak nothing; repeated rows of an item are one item each. The items are a
bounded table (MOST_ITEM_WORDS, counted first), asked in blocks of BLOCK_WINDOWS; every other table may
grow. A stretch of more than LONGEST words is read in overlapping parts: no window is lost, but a run
longer than that would count in parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import words
from recordloom.session import stored

RUN, ENOUGH = 12, 10
MARGIN = RUN // 2  # words on either side of a passage that count as near
RANK, OVERSAMPLE = 64, 8
NEAR = 0.8  # least cosine of a candidate
MOST_ITEM_WORDS = 2_000_000
BLOCK_WINDOWS = 200_000  # windows of items asked at once: 51 MB of latent vectors
GROUP = 8  # windows of an item in a group of the index
PLACES = 100_000  # words of stretches that are looked at together
PAIRS = 500_000  # of places and windows of items that are looked at together
LONGEST = 50_000
CHUNK = 512  # rows of the vocabulary in one partial sum
SUMMED = 64  # partial sums added up by one task
LCS_SHARE, ANSWER_SHARE = 0.8, 0.5
SEEDS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]  # of the signatures


class Items:
    """The items as numbers of their vocabulary."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        texts = [(k, words(t)) for k, t in rows if k is not None]
        texts = [(k, w) for k, w in texts if len(w) >= RUN]
        self.ids = [k for k, _ in texts]
        self.words = sorted({x for _, w in texts for x in w})
        self.number = {w: i for i, w in enumerate(self.words)}
        self.texts = [np.array([self.number[x] for x in w], np.int32) for _, w in texts]

    def blocks(self) -> Iterator[slice]:
        """Items of together about BLOCK_WINDOWS windows."""
        yield from blocks(np.array([len(t) - RUN + 1 for t in self.texts]), BLOCK_WINDOWS)


def windows_of(text: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(text, RUN) if len(text) >= RUN else np.zeros((0, RUN), np.int32)


def stretches(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the parts covered by windows with enough item words (numbers >= 0); of long ones, overlapping parts."""
    if len(numbers) < RUN:
        return []
    c = np.concatenate([[0], np.cumsum(numbers >= 0)])
    starts = np.flatnonzero(c[RUN:] - c[:-RUN] >= ENOUGH)
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > RUN)
    out = zip(starts[np.r_[0, new + 1]].tolist(), (starts[np.r_[new, len(starts) - 1]] + RUN).tolist(), strict=True)
    shared = RUN - 1 + 2 * MARGIN
    return [(a, min(e, a + LONGEST)) for s, e in out for a in range(s, max(s + 1, e - shared), LONGEST - shared)]


def rolling(x: np.ndarray, n: int, add: np.ufunc = np.add) -> np.ndarray:
    """Sums of n rows in a row. Which rows are added to which depends on n alone, so equal rows have equal sums to the last bit."""
    power, sums = x, {}
    for k in range(n.bit_length()):
        if n >> k & 1:
            sums[k] = power
        power = add(power[: -(1 << k)], power[1 << k :]) if len(power) > 1 << k else power[:0]
    out, at, m = None, 0, max(0, len(x) - n + 1)
    for k in sorted(sums, reverse=True):
        part = sums[k][at : at + m]
        out, at = part if out is None else add(out, part), at + (1 << k)
    return out


class Passages:
    """The windows with enough item words of some stretches, laid side by side with margins of no words."""

    def __init__(self, lists: list[np.ndarray]):
        gap = np.full(MARGIN, -1, np.int32)
        self.flat = np.concatenate([x for s in lists for x in (gap, s, gap)]) if lists else gap
        sizes = np.array([len(s) for s in lists], np.int64)
        row = np.repeat(np.arange(len(lists)), sizes + 2 * MARGIN) if lists else np.full(MARGIN, -1)
        place = np.arange(len(self.flat)) - np.repeat(np.cumsum(sizes + 2 * MARGIN) - sizes - 2 * MARGIN, sizes + 2 * MARGIN) if lists else np.zeros(MARGIN, np.int64)
        inside = (place >= MARGIN) & (place < MARGIN + sizes[row]) if lists else np.zeros(MARGIN, bool)
        if len(self.flat) < RUN:
            self.at = np.zeros(0, np.int64)
        else:
            self.at = np.flatnonzero(inside[: -RUN + 1] & inside[RUN - 1 :] & (rolling((self.flat >= 0).astype(np.int32), RUN) >= ENOUGH))
        #: the stretch of each window
        self.row = row[self.at]

    def square(self, idf: np.ndarray) -> np.ndarray:
        """The squared length of the TF-IDF vector of each window; a word that comes k times has k times the weight."""
        weight = np.where(self.flat >= 0, idf[self.flat] ** 2, 0.0)
        out = rolling(weight, RUN)
        for d in range(1, RUN):
            same = (self.flat[:-d] == self.flat[d:]) & (self.flat[d:] >= 0)
            if same.any():
                out = out + 2 * rolling(np.where(same, weight[d:], 0.0), RUN - d)
        return np.maximum(out[self.at], 1e-12)

    def project(self, weighted: np.ndarray) -> np.ndarray:
        """The windows times a matrix (vocabulary + 1 x rank) whose rows are multiplied with the weights of the words, the last one 0."""
        return rolling(weighted[self.flat], RUN)[self.at] if len(self.at) else np.zeros((0, weighted.shape[1]), weighted.dtype)

    def gram(self, idf: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        """A'(A thin) of the windows, each scaled to length 1."""
        out = np.zeros((len(weighted) - 1, weighted.shape[1]))
        if not len(self.at):
            return out
        z = np.zeros((len(self.flat) + RUN - 1, weighted.shape[1]), np.float32)
        z[self.at + RUN - 1] = self.project(weighted) / self.square(idf)[:, None]
        # what the windows over each word come to
        over = rolling(z, RUN)
        used = np.flatnonzero(self.flat >= 0)
        used = used[np.argsort(self.flat[used], kind="stable")]
        word = self.flat[used]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.add.reduceat(over[used].astype(np.float64), first, axis=0) * idf[word[first], None]
        return out

    def hashes(self) -> np.ndarray:
        """uint64 that tell the windows apart."""
        x = self.flat.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        out = np.zeros(max(0, len(x) - RUN + 1), np.uint64)
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            for j in range(RUN):
                out = out * np.uint64(0x9E3779B97F4A7C55) + x[j : j + len(out)]
        return out[self.at]


def signature(numbers: np.ndarray, seed: int) -> np.ndarray:
    """A bit of 64 for each word, none for -1."""
    with np.errstate(over="ignore"):
        bit = (numbers.astype(np.int64).view(np.uint64) * SEEDS[seed]) >> np.uint64(58)
    return np.where(numbers >= 0, np.uint64(1) << bit, np.uint64(0))


def with_zero(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.concatenate([matrix * idf[:, None], np.zeros((1, matrix.shape[1]))]).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    most = np.abs(v).max(axis=1, keepdims=True, initial=0)
    v = v / np.where(most > 0, most, 1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class LatentIndex(NamedTuple):
    """Windows of items in groups, groups in cells; each with the least cosine to its centre at which it can hold a window of a cosine of NEAR."""

    latent: np.ndarray  # in order of cells, then groups
    window: np.ndarray  # the number of each of them
    start: np.ndarray  # of the windows of each group
    centre: np.ndarray
    least: np.ndarray
    cells: np.ndarray
    cell_least: np.ndarray
    cell_start: np.ndarray  # of the groups of each cell

    @classmethod
    def of(cls, latent: np.ndarray, item: np.ndarray) -> LatentIndex:
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        start = np.concatenate([np.arange(a, b, GROUP) for a, b in zip(first, np.r_[first[1:], len(item)], strict=True)])
        size = np.diff(np.r_[start, len(item)])
        group = np.repeat(np.arange(len(start)), size)
        centre = unit(np.add.reduceat(latent, start, axis=0))
        wide = np.maximum.reduceat(angle((latent * centre[group]).sum(axis=1)), start)
        cells = centre[np.random.default_rng(3).choice(len(centre), math.ceil(math.sqrt(len(centre))), replace=False)]
        for _ in range(4):
            near = nearest(centre, cells)
            total = np.zeros_like(cells)
            np.add.at(total, near, centre)
            cells = np.where(np.abs(total).max(axis=1, keepdims=True) > 0, unit(total), cells)
        near = nearest(centre, cells)
        order = np.argsort(near, kind="stable")
        window = np.argsort(np.argsort(order, kind="stable")[group], kind="stable")
        centre, wide, near, size = centre[order], wide[order], near[order], size[order]
        used, cell_start = np.unique(near, return_index=True)
        cells = cells[used]
        reach = np.maximum.reduceat(angle((centre * np.repeat(cells, np.diff(np.r_[cell_start, len(near)]), axis=0)).sum(axis=1)) + wide, cell_start)
        bound = lambda w: (np.cos(np.minimum(np.pi, math.acos(NEAR) + w)) - 1e-4).astype(np.float32)
        return cls(latent[window], window, np.r_[0, np.cumsum(size)], centre, bound(wide), cells, bound(reach), np.r_[cell_start, len(near)])

    def candidates(self, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of v, window, cosine) of at least NEAR."""
        opened = v @ self.cells.T >= self.cell_least
        for c in range(len(self.cells)):
            rows = np.flatnonzero(opened[:, c])
            groups = slice(self.cell_start[c], self.cell_start[c + 1])
            within = v[rows] @ self.centre[groups].T >= self.least[groups]
            some = within.any(axis=1)
            rows, within = rows[some], within[some]
            # the groups of the cell that any of the rows opens, with those rows
            hit = np.flatnonzero(within.any(axis=0)) + groups.start
            if not len(hit):
                continue
            w = np.concatenate([np.arange(self.start[g], self.start[g + 1]) for g in hit.tolist()])
            cos = v[rows] @ self.latent[w].T
            p, q = np.nonzero(cos >= NEAR)
            if len(p):
                yield rows[p], self.window[w[q]], cos[p, q]


def nearest(v: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return np.concatenate([(v[i : i + 4096] @ cells.T).argmax(axis=1) for i in range(0, len(v), 4096)])


def lists_of(b: pa.RecordBatch, column: int) -> list[np.ndarray]:
    c = b.column(column)
    offsets, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
    return [flat[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]


def portions(lists: list[np.ndarray]) -> Iterator[slice]:
    """Lists of together about PLACES words."""
    yield from blocks(np.array([len(x) + 2 * MARGIN for x in lists], np.int64), PLACES)


def read_items(eval_items: DataFrame) -> Items:
    """The items, once they have been counted."""
    rows = eval_items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(words(t)) for b in batches for t in b.column(1).to_pylist())], pa.int64())], names=["n"])

    n = rows.mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0
    if n > MOST_ITEM_WORDS:
        raise ValueError(f"{n} words of items, more than {MOST_ITEM_WORDS}: ask for parts of the items one after another")
    return Items([tuple(r) for r in rows.collect()])


def scan(documents: DataFrame, items: Items) -> tuple[DataFrame, np.ndarray]:
    """(stretches(doc_id, pos, words array<int>), inverse document frequencies)."""
    shared = documents.sparkSession.sparkContext.broadcast(items.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        used = np.zeros(len(number) + 1, np.int64)
        types = [pa.int64(), pa.int32(), pa.list_(pa.int32())]
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words(text)
                used[-1] += 1
                numbers = np.fromiter(map(number.get, w, repeat(-1)), np.int32, len(w))
                used[np.unique(numbers[numbers >= 0])] += 1
                out += [(k, s, numbers[s:e]) for s, e in stretches(numbers)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "pos", "words"])
        # the counts of the task: one row, of the size of the vocabulary
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), pa.array([used.astype(np.int32)], types[2])], names=["doc_id", "pos", "words"])

    all_ = stored(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pos int, words array<int>"), "p8-stretches")
    counts = all_.where("pos = -1").select(F.posexplode("words").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # the size of the vocabulary
    used = np.zeros(len(items.words) + 1)
    used[counts["i"].to_numpy()] = counts["n"].to_numpy()
    return all_.where("pos >= 0"), np.log((1 + used[-1]) / (1 + used[:-1])) + 1


def basis_of(parts: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """float32[vocabulary, rank]: the leading right singular vectors of the TF-IDF passages of documents and items."""
    size = len(items.words)
    thin_ = min(RANK + OVERSAMPLE, size)
    tasks = parts.rdd.getNumPartitions()
    parts = parts.select("words").coalesce(min(tasks, SUMMED * SUMMED))

    def product(thin: np.ndarray) -> np.ndarray:
        shared = parts.sparkSession.sparkContext.broadcast((idf, with_zero(thin, idf)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, t = shared.value
            total = np.zeros((len(f), t.shape[1]))
            for b in batches:
                lists = lists_of(b, 0)
                for s in portions(lists):
                    total += Passages(lists[s]).gram(f, t)
            some = [c for c in range(0, len(total), CHUNK) if total[c : c + CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[c : c + CHUNK].tobytes() for c in some], pa.binary())], names=["c", "v"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = np.zeros(len(table["v"][0].as_py()) // 8)
            for x in table["v"]:
                total += np.frombuffer(x.as_py(), np.float64)
            return pa.table({"c": [key[0].as_py()], "v": pa.array([total.tobytes()], pa.binary())})

        out = np.zeros((size, thin_))
        weighted = with_zero(thin, idf)
        for s in portions(items.texts):
            out += Passages(items.texts[s]).gram(idf, weighted)
        # at most SUMMED * SUMMED partial sums, added up SUMMED at a time
        partial = parts.mapInArrow(run, "c long, v binary").withColumn("s", F.spark_partition_id() % SUMMED)
        summed = partial.groupBy("c", "s").applyInArrow(add, "c long, v binary").groupBy("c").applyInArrow(add, "c long, v binary").toArrow()
        for c, v in zip(summed["c"].to_pylist(), summed["v"].to_pylist(), strict=True):
            out[c : c + CHUNK] += np.frombuffer(v, np.float64).reshape(-1, thin_)
        return out

    q = np.linalg.qr(product(np.random.default_rng(5).standard_normal((size, thin_))))[0]
    z = product(q)
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def longest_run(a: np.ndarray, b: np.ndarray) -> int:
    """The most consecutive words in common."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    same = np.zeros((n, m + n), bool)
    same[:, :m] = (a[::-1, None] == b) & (a[::-1, None] >= 0)
    # row i moved right by i: a diagonal is a column
    columns = np.zeros((m + n - 1, n + 1), bool)
    columns[:, :n] = same.ravel()[: n * (m + n - 1)].reshape(n, -1).T
    return int(np.diff(np.flatnonzero(~columns.ravel()), prepend=-1).max()) - 1


def in_common(near: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(met, lcs) of each row of targets: a bit for each of its words that near has, and the longest common subsequence with near."""
    at = np.zeros(near.shape, np.int32)
    for j in range(targets.shape[1]):
        at |= (near == targets[:, j : j + 1]).astype(np.int32) << j
    v = np.full(len(near), (1 << targets.shape[1]) - 1, np.int32)  # Hyyrö's bits: the zeros are the length
    for j in range(near.shape[1]):
        u = v & at[:, j]
        v = ((v + u) | (v - u)) & ((1 << targets.shape[1]) - 1)
    return np.bitwise_or.reduce(at, axis=1), targets.shape[1] - np.bitwise_count(v)


def blocks(sizes: np.ndarray, most: int) -> list[slice]:
    """Slices of consecutive sizes that come to most, or to one size more."""
    ends = np.cumsum(sizes)
    cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // most)) + 1).tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


class Checker:
    """The words of the items' windows, against which candidates are checked."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], index: LatentIndex, rare: np.ndarray):
        self.ids, self.texts, self.index = ids, texts, index
        self.item = np.repeat(np.arange(len(texts)), [len(t) - RUN + 1 for t in texts])
        self.targets = np.concatenate([windows_of(t) for t in texts])
        self.keys = (rare[self.targets].astype(np.int32) << np.arange(RUN, dtype=np.int32)).sum(axis=1, dtype=np.int32)
        self.least = math.ceil(LCS_SHARE * RUN)
        #: signatures of the words and of the answers of each window
        self.words = [np.bitwise_or.reduce(signature(self.targets, i), axis=1) for i in range(len(SEEDS))]
        self.answers = [np.bitwise_or.reduce(signature(np.where(rare[self.targets], self.targets, -1), i), axis=1) for i in range(len(SEEDS))]
        n = np.bitwise_count(self.keys)
        self.may_lack = n - np.ceil(ANSWER_SHARE * n).astype(n.dtype)

    def check(self, near: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passes, lcs, share of the answers) of the words near passages and windows."""
        met, lcs = in_common(near, self.targets[w])
        answers = np.bitwise_count(met & self.keys[w]) / np.maximum(np.bitwise_count(self.keys[w]), 1)
        return (lcs == RUN) | (lcs >= self.least) & (answers >= ANSWER_SHARE), lcs, answers

    def best(self, lists: list[np.ndarray], weighted: np.ndarray) -> dict[tuple[int, int], tuple[float, int, float]]:
        """(cosine, lcs, answers) by (list, item): of the candidates that pass, the one of highest cosine."""
        found: dict[int, tuple[float, int, float]] = {}
        p = Passages(lists)
        if not len(p.at):
            return {}
        around = np.lib.stride_tricks.sliding_window_view(p.flat, RUN + 2 * MARGIN)
        has = [rolling(signature(p.flat, i), RUN + 2 * MARGIN, np.bitwise_or) for i in range(len(SEEDS))]
        # equal windows are looked up once, and checked at each of their places
        _, where, back = np.unique(p.hashes(), return_index=True, return_inverse=True)
        order = np.argsort(back, kind="stable")
        first = np.searchsorted(back[order], np.arange(len(where) + 1))
        latent = unit(p.project(weighted)[where])
        n_items = len(self.texts)
        for i in range(0, len(latent), 4096):
            for q, w, c in self.index.candidates(latent[i : i + 4096]):
                n = first[i + q + 1] - first[i + q]
                for s in blocks(n, PAIRS):
                    k = np.repeat(np.arange(len(q))[s], n[s])
                    o = order[np.repeat(first[i + q[s]] - np.cumsum(n[s]) + n[s], n[s]) + np.arange(len(k))]
                    # each bit that is missing is a word, or an answer, at least; with more missing than may be, none can pass
                    for theirs, mine in zip(zip(self.answers, self.words, strict=True), has, strict=True):
                        lacks = ~mine[p.at[o] - MARGIN]
                        enough = (np.bitwise_count(theirs[0][w[k]] & lacks) <= self.may_lack[w[k]]) & (np.bitwise_count(theirs[1][w[k]] & lacks) <= RUN - self.least)
                        k, o = k[enough], o[enough]
                    self._first_to_pass(found, p.row[o] * n_items + self.item[w[k]], c[k], w[k], around, p.at[o] - MARGIN)
        return {divmod(key, n_items): x for key, x in found.items()}

    def _first_to_pass(self, found: dict, pair: np.ndarray, cos: np.ndarray, w: np.ndarray, around: np.ndarray, at: np.ndarray) -> None:
        """Candidates of a pair are checked from the highest cosine down, one, two, four ... at a time, until one passes."""
        if not len(pair):
            return
        order = np.lexsort((-cos, pair))
        pair, cos, w, at = pair[order], cos[order], w[order], at[order]
        names, begin = np.unique(pair, return_index=True)
        end = np.r_[begin[1:], len(pair)]
        known = np.array([found[x][0] if x in found else -2.0 for x in names.tolist()])
        step = 1
        while len(names):
            n = np.minimum(step, end - begin)
            i = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            i = i[cos[i] > np.repeat(known, n)]
            ok, lcs, answers = self.check(around[at[i]], w[i])
            hit = np.flatnonzero(ok)
            passed, one = np.unique(pair[i[hit]], return_index=True)
            for name, x in zip(passed.tolist(), hit[one].tolist(), strict=True):
                found[name] = (float(cos[i[x]]), int(lcs[x]), float(answers[x]))
            begin = begin + n
            on = (begin < end) & ~np.isin(names, passed)
            on[on] &= cos[begin[on]] > known[on]
            names, begin, end, known = names[on], begin[on], end[on], known[on]
            step *= 2


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, lcs, cosine, answers, verbatim): documents with passages of items, at their best place.

    run: consecutive words in common; lcs: of RUN words of the item's window, those that come in order near the passage; answers: the share of the window's answers it repeats."""
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, run int, lcs int, cosine double, answers double, verbatim boolean"
    items = read_items(eval_items)
    if not items.texts:
        return spark.createDataFrame([], schema)
    parts, idf = scan(documents, items)
    basis = basis_of(parts, items, idf)
    weighted = with_zero(basis, idf)
    rare = np.array([w.isdigit() for w in items.words]) | (idf >= np.quantile(idf, 0.5))
    # stretches of hot documents are spread over all tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.select("doc_id", "words").repartition(tasks, "doc_id", F.hash("words"))
    hits = None
    for block in items.blocks():
        texts = items.texts[block]
        latent = unit(np.concatenate([Passages(texts[s]).project(weighted) for s in portions(texts)]))
        item = np.repeat(np.arange(len(texts)), [len(t) - RUN + 1 for t in texts])
        shared = spark.sparkContext.broadcast((items.ids[block], texts, LatentIndex.of(latent, item), rare, weighted))  # at most about BLOCK_WINDOWS windows

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, texts, index, rare, weighted = shared.value
            checker = Checker(ids, texts, index, rare)
            for b in batches:
                docs, lists = b.column(0).to_pylist(), lists_of(b, 1)
                for s in portions(lists):
                    rows = []
                    for (r, k), (cos, lcs, share) in checker.best(lists[s], weighted).items():
                        together = longest_run(lists[s][r], texts[k])
                        rows.append((docs[s][r], ids[k], together, lcs, round(min(cos, 1.0), 4), round(share, 4), together >= RUN))
                    if rows:
                        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["doc_id", "item_id", "run", "lcs", "cosine", "answers", "verbatim"])

        found_ = spread.mapInArrow(run, schema)
        hits = found_ if hits is None else hits.unionByName(found_)
    return hits.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("lcs").alias("lcs"), F.max("cosine").alias("cosine"), F.max("answers").alias("answers"), F.bool_or("verbatim").alias("verbatim"))


def found(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that share at least RUN consecutive words with an item."""
    return leaks(documents, eval_items).where("verbatim").select("doc_id", "item_id")
