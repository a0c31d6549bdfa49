"""Near-duplicate records with small edits: BK-trees over odd sketches, sharded by prefix keys.

The Hamming distance between the sets of words of two texts is the integer metric; an odd sketch
(setjoin) bounds it from below in 128 bits. The classes filed under one key form a shard; each shard
becomes one BK-tree, whose children are keyed by the distance to the parent, and a search follows
only edges within the radius. All trees of a partition are built and searched level by level in
NumPy, some whole shards at a time. Shards are shuffled to where they are searched, not broadcast:
together they are about as large as the input (README), so no executor could hold them. Candidates are checked exactly against the word sets.

Null, blank and short texts (fewer than `least` distinct words) belong to no pair or group; exact
repeats of a word set form one class; ties do not arise, since the smallest seq names a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import setjoin as S
from recordloom.operators.groups import components
from recordloom.session import stored

BLOCK = 200_000  # search pairs looked at together
CLASS_BLOCK = 1000  # rows of a class that one block of its pairs has


class Forest:
    """The BK-trees of many shards: rows sorted by shard; the first row of a shard is its root. Rows that are no members (they come last in their shard) only search."""

    def __init__(self, shard: np.ndarray, sketch: np.ndarray, member: np.ndarray | None = None):
        n = len(shard)
        member = np.ones(n, bool) if member is None else member
        self.sketch = sketch
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        self.level: list[np.ndarray] = []
        change = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        node, todo = self.root.copy(), np.flatnonzero(~change & member)
        self.level.append(np.flatnonzero(change & member))
        #: whether a row's shard has a tree
        self.rooted = member[self.root]
        while len(todo):
            # each row below a node goes to the child of its distance; the first to come becomes that child
            far = S.hamming(sketch[todo], sketch[node[todo]])
            order = np.lexsort((todo, far, node[todo]))
            rows, far = todo[order], far[order]
            above = node[rows]
            first = np.r_[True, (above[1:] != above[:-1]) | (far[1:] != far[:-1])]
            child = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
            self.parent[rows[first]], self.edge[rows[first]] = above[first], far[first]
            self.level.append(rows[first])
            node[rows] = child
            todo = np.sort(rows[~first])
        born = np.flatnonzero(self.parent >= 0)
        by = np.argsort(self.parent[born], kind="stable")
        self.children = born[by]
        self.start = np.searchsorted(self.parent[born][by], np.arange(n + 1))

    def search(self, rows: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, node) of one shard, row > node, with a sketch distance within the radius of their sizes."""
        for at in range(0, len(rows), BLOCK):
            q = rows[at : at + BLOCK]
            q = q[self.rooted[q]]
            node = self.root[q]
            # no partner is larger than the query divided by the similarity
            widest = S.radius(size[q], np.floor(size[q] / S.floor_sim(similarity)), similarity)
            while len(q):
                parts = []
                for i in range(0, len(q), 8 * BLOCK):
                    qq, nn, ww = (x[i : i + 8 * BLOCK] for x in (q, node, widest))
                    far = S.hamming(self.sketch[qq], self.sketch[nn])
                    hit = (nn < qq) & (far <= S.radius(size[qq], size[nn], similarity))
                    yield qq[hit], nn[hit]
                    count = self.start[nn + 1] - self.start[nn]
                    again = np.repeat(np.arange(len(qq)), count)
                    child = self.children[np.repeat(self.start[nn], count) + np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)]
                    near = np.abs(self.edge[child] - far[again]) <= ww[again]
                    parts.append((qq[again[near]], child[near], ww[again[near]]))
                q, node, widest = (np.concatenate(x) for x in zip(*parts, strict=True))


def candidates(keys: DataFrame, similarity: float) -> DataFrame:
    """(a long, b long), a < b: classes that meet in a shard within the radius; repeats are possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in S.by_keys(batches):
            key = whole["key"].to_numpy()
            # a shard of one class has no pairs
            same = key[1:] == key[:-1]
            whole = whole.filter(pa.array(np.r_[same, False] | np.r_[False, same]))
            key, ck, side, size = whole["key"].to_numpy(), whole["ck"].to_numpy(), whole["side"].to_numpy(), whole["n"].to_numpy().astype(np.int64)
            forest = Forest(key, S.read_sketches(whole), side != 2)
            for a, b in forest.search(np.flatnonzero(side != 1), size, similarity):
                x = np.unique(np.stack([np.minimum(ck[a], ck[b]), np.maximum(ck[a], ck[b])], axis=1), axis=0)
                x = x[x[:, 0] < x[:, 1]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return S.together(keys).mapInArrow(run, "a long, b long")


def near_classes(df: DataFrame, similarity: float = 0.7, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(rows, links) of df(seq, scope, text): rows(seq, ck), ck the class of the scope and set of words; links(a, b), the pairs of similar classes."""
    rows = stored(S.with_word_sets(df, ["seq"], least, by_scope=True), "p4-rows")
    classes = S.once_per_task(rows)
    freq = S.frequencies(classes)
    keys = S.spread(S.prefix_keys(classes, freq, rows.count(), similarity), int(freq.max()))
    pairs = stored(candidates(keys, similarity).distinct(), "p4-pairs")
    return rows.select("seq", "ck"), stored(S.verified(pairs, rows, similarity), "p4-links")


def near_pairs(df: DataFrame, similarity: float = 0.7, least: int = 8) -> DataFrame:
    """(seq_a, seq_b), seq_a < seq_b: all pairs of rows of one scope whose texts are similar enough, repeats included.

    The rows of a large class are dealt to blocks of about CLASS_BLOCK, and pairs of blocks are joined, so that no task has a whole hot class; two blocks meet once."""
    rows, links = near_classes(df, similarity, least)
    sizes = rows.groupBy("ck").agg(F.ceil(F.count("*") / CLASS_BLOCK).cast("int").alias("n"), F.count("*").alias("m")).where("m > 1 or n > 1")
    alike = sizes.select(F.col("ck").alias("a"), F.col("ck").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"))
    many = sizes.where("n > 1").select("ck", "n")
    apart = links.join(many.toDF("a", "na"), "a", "left").join(many.toDF("b", "nb"), "b", "left").select("a", "b", F.coalesce("na", F.lit(1)).alias("na"), F.coalesce("nb", F.lit(1)).alias("nb"))
    one = F.lit(1)
    met = alike.unionByName(apart).select("a", "b", "nb", F.explode(F.sequence(one, "na")).alias("i")).select("a", "b", "i", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(one), "nb")).alias("j"))
    dealt = rows.join(many, "ck", "left").select("seq", "ck", F.coalesce(F.expr("cast(pmod(xxhash64(seq), n) as int) + 1"), one).alias("part"))
    x, y = dealt.toDF("x", "a", "i"), dealt.toDF("y", "b", "j")
    both = met.join(x, ["a", "i"]).join(y, ["b", "j"]).where("a != b or i != j or x < y")
    return both.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))


def near_links(df: DataFrame, similarity: float = 0.7, least: int = 8) -> DataFrame:
    """(seq_a, seq_b), seq_a < seq_b: the pairs of similar texts that differ in their words, each text by the smallest seq of its class; p4_groups tells which rows a class has."""
    rows, links = near_classes(df, similarity, least)
    first = rows.groupBy("ck").agg(F.min("seq").alias("seq"))
    both = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return both.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))


def near_groups(df: DataFrame, similarity: float = 0.7, least: int = 8) -> DataFrame:
    """(seq, group_seq, class_seq, links): one row per text long enough; class_seq is the smallest seq with its set of words; group_seq is the smallest seq it is connected to, links the number of its similar texts (classes)."""
    rows, links = near_classes(df, similarity, least)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = rows.groupBy("ck").agg(F.min("seq").alias("group_seq"))
    labels = components(both, named)
    degree = both.groupBy(F.col("a").alias("ck")).agg(F.count("*").alias("links"))
    return rows.join(labels, "ck").join(named.toDF("ck", "class_seq"), "ck").join(degree, "ck", "left").select("seq", "group_seq", "class_seq", F.coalesce("links", F.lit(0)).alias("links"))
