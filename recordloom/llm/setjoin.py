"""Common ground of the near-duplicate operators: classes of equal word sets, an order of words by
frequency, exact prefix keys, odd sketches and the exact check of candidates.

Two sets A and B of a Jaccard similarity of at least t share a word among the |A| - ceil(t|A|) + 1
rarest words of A and the like of B, under any common order of words, and two among one word more if
they share two at all. Every class is therefore filed under the former ("prefix keys"), except that
words used by very many texts are replaced by the pairs of such words in the longer prefix: sets that
have no rarer word in common meet there, so this splits hot keys and loses nothing. Word frequencies
are counted over all texts in a fixed number of buckets; the order only decides how evenly the keys
spread, never which pairs are found.

An odd sketch keeps the parity of the words that fall into each of 128 bits. The Hamming distance of
two sketches never exceeds the size of the symmetric difference of the sets, and
J >= t  <=>  |A xor B| <= (1-t)/(1+t) (|A|+|B|), so a search with that radius misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import scope_key, set_key, word_set

BUCKETS = 1 << 20  # of the word frequencies: 4 MB to each executor, whatever the corpus
HOT_LEAST, HOT_SHARE = 1000, 8192  # a bucket with more classes than that, and than 1/HOT_SHARE of all, is split further
SHARD_MOST = 100_000  # rows of a key that one task compares
CHUNK_ROWS = 250_000  # rows of whole keys that a task looks at together
SKETCH_WORDS = 2  # 64-bit words of a sketch
KEY_SCHEMA = "key long, ck long, n int, s0 long, s1 long"


def floor_sim(similarity: float) -> float:
    return similarity - 1e-9


def list_array(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64)))


def with_word_sets(df: DataFrame, keep: list[str], least: int, by_scope: bool) -> DataFrame:
    """The columns `keep` (longs) of df(text[, scope]) and: words, the sorted hashes of the words (of the scope); ck, the class of that set.

    Rows with fewer than `least` distinct words are left out."""
    cols = [*keep, "text", *(["scope"] if by_scope else [])]
    schema = ", ".join([*(f"{c} long" for c in keep), "ck long", "words array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            scopes = b.column(len(keep) + 1).to_pylist() if by_scope else None
            rows, sets, keys = [], [], []
            for i, text in enumerate(texts):
                w = word_set(text, scope_key(scopes[i]) if scopes else None)
                if len(w) >= least:
                    rows.append(i)
                    sets.append(w)
                    keys.append(set_key(w))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(len(keep))), pa.array(keys, pa.int64()), list_array(sets)], names=[*keep, "ck", "words"])

    return df.select(*cols).mapInArrow(run, schema)


def frequencies(classes: DataFrame) -> np.ndarray:
    """How many classes use each bucket of words; BUCKETS numbers, counted over all classes."""
    out = np.zeros(BUCKETS, np.int32)
    counted = classes.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(BUCKETS - 1).cast("int").alias("b")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out[counted["b"].to_numpy()] = counted["n"].to_numpy()
    return out


def once_per_task(rows: DataFrame, *cols: str) -> DataFrame:
    """rows(ck, words, *cols (longs)), of each class only the first row of a task: what is left of hot classes is small, without a shuffle. A class may still come from several tasks."""
    schema = "ck long, words array<long>" + "".join(f", {c} long" for c in cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            take = []
            for i, k in enumerate(b.column(0).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    take.append(i)
            yield b.take(pa.array(take, pa.int64()))

    return rows.select("ck", "words", *cols).mapInArrow(run, schema)


def sketches(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """int64[n, SKETCH_WORDS]: odd sketches of the lists."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    bit = (flat.view(np.uint64) >> np.uint64(24)).astype(np.int64) & (64 * SKETCH_WORDS - 1)
    odd = np.bincount(row * (64 * SKETCH_WORDS) + bit, minlength=n * 64 * SKETCH_WORDS).reshape(n, 8 * SKETCH_WORDS, 8) & 1
    return np.packbits(odd.astype(np.uint8), axis=2, bitorder="little").reshape(n, 8 * SKETCH_WORDS).view(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key of the unordered pair of two 64-bit hashes."""
    with np.errstate(over="ignore"):
        lo, hi = np.minimum(a, b).view(np.uint64), np.maximum(a, b).view(np.uint64)
        x = (lo * np.uint64(0x9E3779B97F4A7C15)) ^ (hi + np.uint64(0x7F4A7C15))
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def key_rows(flat: np.ndarray, offsets: np.ndarray, freq: np.ndarray, hot: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of the prefixes of the lists."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    f = freq[flat & (BUCKETS - 1)]
    order = np.lexsort((flat, f, row))
    flat, f = flat[order], f[order]
    place = np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)
    overlap = np.ceil(sizes * floor_sim(similarity)).astype(np.int64)
    prefix = sizes - overlap + 1
    frequent = f > hot
    # sets that may share a single word keep the frequent ones as keys, too
    plain = (place < np.repeat(prefix, sizes)) & (~frequent | np.repeat(overlap < 2, sizes))
    # frequent words end the order, so the pairs of frequent words in the prefix longer by one are a tail of it
    longer = np.minimum(prefix + 1, sizes)
    left = np.flatnonzero(frequent & (place < np.repeat(longer, sizes)))
    count = (offsets[:-1] + longer)[row[left]] - left - 1
    right = np.repeat(left + 1, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    left = np.repeat(left, count)
    return np.concatenate([row[plain], row[left]]), np.concatenate([flat[plain], mixed(flat[left], flat[right])])


def prefix_keys(classes: DataFrame, freq: np.ndarray, total: int, similarity: float) -> DataFrame:
    """(key long, ck long, n int, s0 long, s1 long) of classes(ck, words)."""
    shared = classes.sparkSession.sparkContext.broadcast(freq)  # BUCKETS numbers
    hot = max(HOT_LEAST, total // HOT_SHARE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(lists) else np.empty(0)
            if not len(flat):
                continue
            offsets -= offsets[0]
            rows, keys = key_rows(flat, offsets, shared.value, hot, similarity)
            sk = sketches(flat, offsets)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(0).take(pa.array(rows)), pa.array(np.diff(offsets)[rows].astype(np.int32)), pa.array(sk[:, 0]), pa.array(sk[:, 1])], names=["key", "ck", "n", "s0", "s1"])

    return classes.select("ck", "words").mapInArrow(run, KEY_SCHEMA)


def spread(keys: DataFrame, largest: int) -> DataFrame:
    """keys(KEY_SCHEMA, ...) with `side`, in which no key has many more than SHARD_MOST rows, if any may have more than `largest` of them.

    The rows of a larger key are dealt to blocks by class, and each pair of blocks becomes a key of its own, so that its tasks together still compare every pair: side 0 are rows of one block, to be compared with each other; sides 1 and 2 those of two blocks, to be compared with the other side only."""
    if largest <= SHARD_MOST:
        return keys.withColumn("side", F.lit(0))
    bucket = F.col("key").bitwiseAND(BUCKETS - 1)
    counted = keys.groupBy(bucket.alias("_b")).count().where(F.col("count") > SHARD_MOST).select("_b", F.ceil(F.col("count") / SHARD_MOST).alias("_n")).toArrow()
    if not counted.num_rows:
        return keys.withColumn("side", F.lit(0))
    # at most BUCKETS rows
    large = keys.sparkSession.createDataFrame(counted.to_pandas(), "_b long, _n long")
    dealt = keys.withColumn("_b", bucket).join(F.broadcast(large), "_b", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("_i", F.pmod("ck", "_n")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    key = F.when(F.col("_n") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("_i", "_j"), F.greatest("_i", "_j")))
    side = F.when(F.col("_i") == F.col("_j"), 0).when(F.col("_i") < F.col("_j"), 1).otherwise(2)
    return dealt.withColumns({"key": key, "side": side}).select(*keys.columns, "side")


def together(keys: DataFrame) -> DataFrame:
    """The rows of a key in one task, side by side; by_keys reads them."""
    return keys.repartition("key").sortWithinPartitions("key", "side")


def radius(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """The largest symmetric difference of sets of these sizes that are similar enough."""
    t = floor_sim(similarity)
    return np.floor((1 - t) / (1 + t) * (na + nb)).astype(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def by_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task of together(), as tables of whole keys, sorted by key, side and size, each class of a key once: what is in memory is bounded by CHUNK_ROWS and the largest key, not by the task."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= CHUNK_ROWS:
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut or held[0].column(0)[0].as_py() != key[-1]:
                # all rows before the last key of the batch
                before = [x for x in held[:-1] if x.column(0)[-1].as_py() != key[-1]]
                split = held[len(before) : -1]
                rest = []
                for x in split:
                    k = int(np.searchsorted(x.column(0).to_numpy(), key[-1]))
                    before.append(x.slice(0, k))
                    rest.append(x.slice(k))
                yield _ordered(pa.Table.from_batches([*before, b.slice(0, cut)]))
                held = [x for x in [*rest, b.slice(cut)] if x.num_rows]
                n = sum(x.num_rows for x in held)
    if held:
        yield _ordered(pa.Table.from_batches(held))


def _ordered(whole: pa.Table) -> pa.Table:
    key, side, ck = (whole[c].to_numpy() for c in ("key", "side", "ck"))
    order = np.lexsort((ck, whole["n"].to_numpy(), side, key))
    k, s, c = key[order], side[order], ck[order]
    # copies of a class come from several tasks of the scan
    first = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (c[1:] != c[:-1])] if len(order) else np.zeros(0, bool)
    return whole.take(pa.array(order[first]))


def read_sketches(whole: pa.Table) -> np.ndarray:
    return np.stack([whole["s0"].to_numpy(), whole["s1"].to_numpy()], axis=1).view(np.uint64)


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs(a, b, ...) of classes whose word sets are similar enough, exactly; rows(ck, words) may repeat classes."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("ck")).distinct()
    sets = rows.select("ck", "words").join(needed, "ck", "left_semi").groupBy("ck").agg(F.first("words").alias("words"))
    a, b = sets.toDF("a", "_wa"), sets.toDF("b", "_wb")
    both = pairs.join(a, "a").join(b, "b").withColumn("_s", F.size(F.array_intersect("_wa", "_wb")))
    return both.where(F.col("_s") >= F.lit(floor_sim(similarity)) * (F.size("_wa") + F.size("_wb") - F.col("_s"))).select(pairs.columns)
