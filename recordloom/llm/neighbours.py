"""Most similar vectors for every vector: randomly rotated one-bit codes with error bounds.

Vectors are scaled to length 1; equal ones form a class, and each class is compared once. Spherical
k-means on a bounded sample gives cells; every vector is filed under its PROBES nearest cells, so two
similar vectors share a cell almost surely. In a cell, a vector less the centre of the cell is rotated at
random, padded to twice its length, and kept as one bit per dimension; the Hamming distance of two codes and a correction scalar
each (the inner product of code and vector) estimate their inner product, with an error bound of Z
standard deviations. Pairs whose upper bound reaches the wanted cosine are reranked with their full
vectors, which travel as 24-bit fixed point numbers (error of a cosine about 1e-7). Where very many
pairs would, the wanted cosine of a vector is first raised to that of its k-th best neighbour by the
estimate, so that what is reranked doesn't grow with the density.

The index is fitted on a sample but holds every vector, in MOST_CELLS cells at most. A cell that grows
beyond SPLIT vectors with the data is fitted anew in its task, on its own vectors, into cells of about
CELL, again with PROBES each: what a vector is compared with, and what is shuffled of it, stays the same
at any size. A task reads cell by cell. Only a cell of more than BLOCK classes is cut into blocks that are
compared pair by pair in separate tasks, so a hot region neither lands in one task nor is cut short.
A class of any size sends one vector per task of the scan.

Null vectors, vectors of another length or with null or infinite numbers, and all-zero ones take no
part. Ties of the rounded cosine go to the smaller seq. An empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import stored

PROBES = 4
CELL = 1500  # classes wanted in a cell
MOST_CELLS, SAMPLE_PER_CELL, MOST_SAMPLE = 16384, 32, 262_144  # bounds of the fitted index
SPLIT = 8192  # vectors of a cell that are compared without fitting it anew
BLOCK = 262_144  # classes of a cell in one task: 50 MB of vectors
DENSE = 8  # times k candidates a vector, from which on the k-th best is sought first
Z = 4.0  # standard deviations of the error bound
FIXED = (1 << 23) - 1
PAIRS_AT_ONCE = 1_000_000
TASK_BYTES = 1 << 28  # of filed vectors that one task streams


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors of length 1) of the usable rows of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    if not len(rows):
        return rows, np.zeros((0, dim))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        # first by the largest number, so that no square overflows or vanishes
        most = np.abs(flat).max(axis=1, keepdims=True)
        v = flat / most
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True)) + 0.0
    good = np.isfinite(v).all(axis=1) & (most[:, 0] > 0)
    return rows[good], v[good]


def class_keys(v: np.ndarray) -> np.ndarray:
    """Signed 64 bits that name each vector, to single precision."""
    single = np.ascontiguousarray(v.astype(np.float32) + 0.0)
    return np.array([xxhash.xxh3_64_intdigest(x.data) - (1 << 63) for x in single], np.int64)


def pack(v: np.ndarray) -> np.ndarray:
    """uint8[n, 3 * dim]: 24-bit fixed point."""
    whole = np.rint(v * FIXED).astype("<i4")
    return np.ascontiguousarray(whole.view(np.uint8).reshape(*v.shape, 4)[:, :, :3]).reshape(len(v), 3 * v.shape[1])


def unpack(raw: np.ndarray, dim: int) -> np.ndarray:
    whole = np.zeros((len(raw), dim, 4), np.uint8)
    whole[:, :, 1:] = raw.reshape(len(raw), dim, 3)
    return (whole.reshape(len(raw), -1).view("<i4") >> 8) / FIXED


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """float32[cells, dim]: spherical k-means of a sample."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample.astype(np.float32), axis=0)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds if len(x) > len(c) else 0):
        near = np.concatenate([(x[i : i + 2048] @ c.T).argmax(axis=1) for i in range(0, len(x), 2048)])
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.r_[True, near[order][1:] != near[order][:-1]])
        total = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        ok = norm[:, 0] > 1e-6
        c[near[order][first][ok]] = (total / np.maximum(norm, 1e-6))[ok]
    return c


def nearest_cells(v: np.ndarray, cells: np.ndarray, probes: int) -> np.ndarray:
    """int[n, probes]."""
    probes = min(probes, len(cells))
    out = np.empty((len(v), probes), np.int64)
    single = v.astype(np.float32)
    for i in range(0, len(v), 2048):
        s = single[i : i + 2048] @ cells.T
        out[i : i + 2048] = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
    return out


def turn(dim: int, seed: int = 11) -> np.ndarray:
    """float64[dim, BITS(dim)]: the first rows of a random rotation of the padded space."""
    bits = code_bits(dim)
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0][:dim]


@lru_cache(maxsize=4)
def _turn(dim: int) -> np.ndarray:
    return turn(dim)


def code_bits(dim: int) -> int:
    """Vectors are padded with zeros to twice their length, up to whole words: more bits, a tighter bound."""
    return 64 * -(-2 * dim // 64)


class Codes:
    """One-bit codes of vectors about a centre, and what their estimates need."""

    def __init__(self, v: np.ndarray, centre: np.ndarray, rotation: np.ndarray):
        rest = v - centre
        self.size = rotation.shape[1]
        self.norm = np.maximum(np.linalg.norm(rest, axis=1), 1e-9)
        turned = (rest / self.norm[:, None]) @ rotation
        self.bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
        #: the inner product of the code (of length 1) and the vector
        self.fit = np.abs(turned).sum(axis=1) / math.sqrt(self.size)
        self.along = v @ centre
        self.square = float(centre @ centre)

    def most_apart(self, a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The most differing bits of codes of fits a and b, if the vectors about the centre have a cosine of at least `wanted`, but for an error of Z standard deviations."""
        s = np.clip(wanted, -1, 1)
        spread = (a * a * (1 - b * b) + b * b * (1 - a * a)) * (1 - s * s) + (1 - a * a) * (1 - b * b)
        return self.size / 2 * (1 - a * b * s + Z * np.sqrt(spread / (self.size - 1)))

    def wanted(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        """The cosine about the centre at which two vectors have an inner product of `least`."""
        return (least - self.along[i] - self.along[j] + self.square) / (self.norm[i] * self.norm[j])

    def reach(self, i: np.ndarray, others: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Per vector, the most differing bits at which a pair with any of the others can still reach the lower `low` of the two."""
        over = np.minimum(low[i], low[others].min()) - self.along[i] - self.along[others].max() + self.square
        wanted = np.minimum(over / (self.norm[i] * self.norm[others].max()), over / (self.norm[i] * self.norm[others].min()))
        return self.most_apart(self.fit[i], np.full(len(i), self.fit[others].min()), wanted)

    def apart(self, i: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Differing bits, len(i) x len(others)."""
        mine, theirs = self.bits[i], self.bits[others]
        out = np.bitwise_count(mine[:, None, 0] ^ theirs[None, :, 0])
        for w in range(1, theirs.shape[1]):
            more = np.bitwise_count(mine[:, None, w] ^ theirs[None, :, w])
            out = out + more if self.size < 256 else out.astype(np.uint16) + more
        return out


def similar_pairs(v: np.ndarray, codes: Codes, left: np.ndarray, right: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of left x right with a cosine of at least about the lower `low` of the two; for left = right each pair once."""
    if not len(left) or not len(right):
        return
    own = left is right
    reach = np.minimum(codes.reach(left, right, low), codes.size).astype(np.int64)
    single = v.astype(np.float32)
    step = max(1, PAIRS_AT_ONCE // (4 * len(right)))
    for at in range(0, len(left), step):
        i, others = left[at : at + step], right[at:] if own else right
        apart = codes.apart(i, others)
        p, q = np.nonzero(apart <= np.maximum(reach[at : at + step, None], -1))
        if own:
            p, q = (x[q > p] for x in (p, q))
        h = apart[p, q]
        p, q = i[p], others[q]
        wanted = np.minimum(low[p], low[q])
        near = h <= codes.most_apart(codes.fit[p], codes.fit[q], codes.wanted(p, q, wanted))
        p, q, wanted = p[near], q[near], wanted[near]
        for k in range(0, len(p), PAIRS_AT_ONCE):
            pp, qq = p[k : k + PAIRS_AT_ONCE], q[k : k + PAIRS_AT_ONCE]
            close = np.einsum("ij,ij->i", single[pp], single[qq]) >= wanted[k : k + PAIRS_AT_ONCE] - 1e-4
            pp, qq = pp[close], qq[close]
            yield pp, qq, np.einsum("ij,ij->i", v[pp], v[qq])


def lowest(v: np.ndarray, codes: Codes, left: np.ndarray, right: np.ndarray, k: int, least: float) -> np.ndarray:
    """The cosine that is wanted of each vector: `least`, or where very many pairs reach that, the k-th best of the 4 k whose codes are nearest. A pair below the wanted cosine of both is among the k best of neither."""
    low = np.full(len(v), least - 1e-6)
    if min(len(left), len(right)) <= 4 * k:
        return low
    some = left[:: max(1, len(left) // 32)]
    likely = codes.apart(some, right) <= np.minimum(codes.reach(some, right, low), codes.size).astype(np.int64)[:, None]
    if likely.sum() <= DENSE * k * len(some):
        return low
    step = max(1, PAIRS_AT_ONCE // (4 * len(right)))
    for mine, others in ((left, right),) if left is right else ((left, right), (right, left)):
        for at in range(0, len(mine), step):
            i = mine[at : at + step]
            # the nearest is the vector itself, if it is among the others
            near = others[np.argpartition(codes.apart(i, others), 4 * k, axis=1)[:, : 4 * k + 1]]
            cos = np.where(near == i[:, None], -2.0, np.einsum("ij,ikj->ik", v[i], v[near]))
            low[i] = np.maximum(low[i], np.sort(cos, axis=1)[:, -k] - 2e-6)
    return low


def cell_pairs(v: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the vectors of a cell that may be among each other's k best; a pair may come more than once."""
    if left is right and len(left) > SPLIT:
        own = v[left]
        cells = max(2, len(left) * PROBES // CELL)
        rng = np.random.default_rng(len(left))
        fitted = fit_cells(own[rng.choice(len(own), min(len(own), SAMPLE_PER_CELL * cells), replace=False)], cells)
        near = nearest_cells(own, fitted, PROBES)
        row, cell = np.repeat(np.arange(len(own)), near.shape[1]), near.ravel()
        order = np.argsort(cell, kind="stable")
        bounds = np.flatnonzero(np.diff(cell[order], prepend=-1))
        parts = np.split(left[row[order]], bounds[1:])
        if max(map(len, parts)) < 0.7 * len(left):
            for part in parts:
                yield from cell_pairs(v, part, part, k, least)
            return
        # what can't be told apart is compared as it is
    every = left if left is right else np.concatenate([left, right])
    at = v[every]
    codes = Codes(at, at.mean(axis=0), _turn(v.shape[1]))
    a = np.arange(len(left))
    b = a if left is right else np.arange(len(left), len(every))
    for i, j, cos in similar_pairs(at, codes, a, b, lowest(at, codes, a, b, k, least)):
        yield every[i], every[j], cos


def best_of(a: np.ndarray, cos: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their a, by falling cosine, then rising seq."""
    order = np.lexsort((seq, -cos, a))
    s = a[order]
    first = np.r_[True, s[1:] != s[:-1]]
    rank = np.arange(len(s)) - np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return order[rank < k]


def class_neighbours(vectors: DataFrame, k: int, least: float, dim: int) -> tuple[DataFrame, DataFrame]:
    """(members(seq, ck), lists(a, b, cos, b_seq)): of each class its k best other classes of a rounded cosine of at least `least`; b_seq is the smallest seq of b."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = unit_vectors(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(class_keys(v))], names=["seq", "ck"])

    source = vectors.select(F.col("seq").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    members = stored(source.mapInArrow(keyed, "seq long, ck long"), "p1-members")
    total = members.count()
    cells = int(min(MOST_CELLS, max(1, total * PROBES // CELL)))
    wanted = min(MOST_SAMPLE, SAMPLE_PER_CELL * cells, total)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = int((1 << 64) * min(1.0, 1.05 * wanted / max(1, total))) - (1 << 63)
        for b in batches:
            _, v = unit_vectors(b.column(1), dim)
            v = v[class_keys(v) < cut]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v.astype(np.float32)], pa.binary())], names=["v"])

    # the keys are hashes, so those below a bound are a random sample of the classes; at most MOST_SAMPLE vectors
    got = source.mapInArrow(sampled, "v binary").limit(MOST_SAMPLE).toArrow()["v"].to_pylist()
    sample = np.frombuffer(b"".join(got), np.float32).reshape(-1, dim) if got else np.eye(1, dim, dtype=np.float32)
    shared = vectors.sparkSession.sparkContext.broadcast(fit_cells(sample, cells))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, seen = shared.value, set()
        n = np.zeros(len(fitted), np.int64)
        for b in batches:
            _, v = unit_vectors(b.column(1), dim)
            new = _unseen(class_keys(v), seen)
            n += np.bincount(nearest_cells(v[new], fitted, PROBES).ravel(), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["cell", "n"])

    blocks: dict[int, int] = {}
    if total > BLOCK:  # else no cell can have more
        sizes = source.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(f"n > {BLOCK}").toArrow()  # at most MOST_CELLS rows
        blocks = {int(c): -(-int(n) // BLOCK) for c, n in zip(sizes["cell"].to_pylist(), sizes["n"].to_pylist(), strict=True)}

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, least_seq = shared.value, {}
        many = np.ones(len(fitted), np.int64)
        for c, n in blocks.items():
            many[c] = n
        for b in batches:
            rows, v = unit_vectors(b.column(1), dim)
            ck, seq = class_keys(v), b.column(0).take(pa.array(rows)).to_numpy()
            # the smallest seq so far stands for a class; it is sent again if a smaller one comes later
            new = []
            for i in np.lexsort((seq, ck)).tolist():
                c, s = int(ck[i]), int(seq[i])
                if s < least_seq.get(c, s + 1):
                    least_seq[c] = s
                    new.append(i)
            new = np.array(new, np.int64)
            v, ck, seq = v[new], ck[new], seq[new]
            near = nearest_cells(v, fitted, PROBES)
            row, cell = np.repeat(np.arange(len(v)), near.shape[1]), near.ravel()
            # a cell of several blocks: the row meets every block of the cell once
            mine = (ck[row].view(np.uint64) % many[cell].astype(np.uint64)).astype(np.int64)
            times = many[cell]
            row, cell, mine = (np.repeat(x, times) for x in (row, cell, mine))
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            task = (cell << 40) | (np.minimum(mine, other) << 20) | np.maximum(mine, other)
            raw = pack(v)
            width = raw.shape[1]
            data = pa.Array.from_buffers(pa.binary(width), len(row), [None, pa.py_buffer(np.ascontiguousarray(raw[row]))]).cast(pa.binary()) if len(row) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(mine), pa.array(ck[row]), pa.array(seq[row]), data], names=["task", "block", "ck", "seq", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_task(batches):
            task, block, ck, seq = (cell[c].to_numpy() for c in ("task", "block", "ck", "seq"))
            order = np.lexsort((seq, ck))
            # copies of a class from several tasks of the scan: the smallest seq stays
            at = order[np.r_[True, ck[order][1:] != ck[order][:-1]]]
            if len(at) < 2:
                continue
            data = cell["v"].combine_chunks()
            data = pa.concat_arrays(data.chunks) if isinstance(data, pa.ChunkedArray) else data
            begin = int.from_bytes(data.buffers()[1].to_pybytes()[4 * data.offset : 4 * data.offset + 4], "little")
            raw = np.frombuffer(data.buffers()[2], np.uint8, len(data) * 3 * dim, begin).reshape(-1, 3 * dim)
            v = unpack(raw[at], dim)
            one, two = (int(task[0]) >> 20) & 0xFFFFF, int(task[0]) & 0xFFFFF
            every = np.arange(len(at))
            left, right = (every, every) if one == two else (every[block[at] == one], every[block[at] == two])
            parts = list(cell_pairs(v, left, right, k, least))
            if not parts:
                continue
            i, j, cos = (np.concatenate(x) for x in zip(*parts, strict=True))
            cos = np.round(cos, 6)
            i, j, cos = (x[cos >= least] for x in (i, j, cos))
            i, j, cos = np.r_[i, j], np.r_[j, i], np.r_[cos, cos]
            if len(at) > SPLIT:  # a pair may come from several of its cells
                _, once = np.unique(i * len(at) + j, return_index=True)
                i, j, cos = i[once], j[once], cos[once]
            c, s = ck[at], seq[at]
            best = best_of(i, cos, s[j], k)
            i, j, cos = i[best], j[best], cos[best]
            yield pa.RecordBatch.from_arrays([pa.array(c[i]), pa.array(c[j]), pa.array(cos), pa.array(s[j])], names=["a", "b", "cos", "b_seq"])

    # a task streams its cells, one in memory at a time
    size = total * PROBES * (3 * dim + 40)
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    tasks = source.mapInArrow(filed, "task long, block long, ck long, seq long, v binary").repartition(parts, "task").sortWithinPartitions("task")
    found = tasks.mapInArrow(compared, "a long, b long, cos double, b_seq long").groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("b_seq").alias("b_seq"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "b_seq"))
    return members, found.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after another, from batches sorted by `task`."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        task = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != task[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _unseen(ck: np.ndarray, seen: set[int]) -> np.ndarray:
    """The places of the keys not met before, each key once."""
    out = []
    for i, k in enumerate(ck.tolist()):
        if k not in seen:
            seen.add(k)
            out.append(i)
    return np.array(out, np.int64)


def neighbours(vectors: DataFrame, k: int = 10, least: float = 0.85, dim: int = 64) -> DataFrame:
    """(seq, other): of each row of vectors(seq, embedding) its k rows of highest rounded cosine, of those of at least `least`."""
    members, lists = class_neighbours(vectors, k, least, dim)
    lists = stored(lists, "p1-lists")
    # of a class, k + 1 rows are enough for any list
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("ck").orderBy("seq"))).where(F.col("r") <= k + 1).select("ck", "seq")
    few = stored(few, "p1-few")
    own = few.select(F.col("ck").alias("a"), F.lit(1.0).alias("cos"), "seq")
    others = lists.join(few.withColumnRenamed("ck", "b"), "b").select("a", "cos", "seq")
    top = own.unionByName(others).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cos"), "seq"))).where(F.col("r") <= k + 1)
    arrays = top.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "seq"))), lambda x: x["seq"]).alias("near")).where(F.size("near") > 1)
    return members.join(arrays.withColumnRenamed("a", "ck"), "ck").select("seq", F.explode(F.slice(F.filter("near", lambda x: x != F.col("seq")), 1, k)).alias("other"))


def found(memories: DataFrame) -> DataFrame:
    """(seq_a, seq_b) with seq_a < seq_b: pairs of which one is a neighbour of the other."""
    near = neighbours(memories)
    return near.select(F.least("seq", "other").alias("seq_a"), F.greatest("seq", "other").alias("seq_b")).distinct()
