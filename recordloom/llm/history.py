"""Deduplicating new batches against all history: multi-key sorted-neighbourhood runs.

A HistoryIndex is a folder that outlives the job. A run files each accepted class of texts under its prefix
keys (setjoin), in files by key range, sorted by key and number of words; a second table has the word sets,
in files by range of class. A manifest, written last, names the runs and how words are ordered; whoever
opens the folder goes on where the last one stopped, and a crash leaves the state before.

Ingesting batches takes the ranges of the runs that hold keys of the batch, and no others. Each sorted range
meets the sorted records of the batch under the same key whose number of words allows the similarity: the
window around a new record. Under prefix keys these windows hold every text that is similar enough, so
nothing is lost. History is never shuffled: the records of a batch go to it in blocks of at most BLOCK_ROWS
key records, each to the ranges it has keys in, so every range is read once per batch. Accepted texts become
a new run; when there are more than MOST_RUNS, the smaller ones are merged, and keys are made anew once the
history has grown to REKEY times what word frequencies were counted on.

Order of acceptance: an item is a case if it repeats an accepted text or an earlier item that is not
itself a case. Batches ingested together are resolved in their order, with the same result as one by
one: items without a similar predecessor are accepted, items similar to an accepted one are cases,
and so on for ROUNDS rounds; what is then still open is resolved in order, each group of connected items
in one task, only groups of more than GROUP_LINKS links by further rounds.

Null, blank and short texts (fewer than `least` distinct words) are never cases; they are kept as
partners if long enough to be similar to a case. Equal word sets form one class, of which the first
item in order stands for all.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import setjoin as S
from recordloom.operators.groups import components
from recordloom.session import shared_dir, stored
from recordloom.sources.manifest import Folder, Manifest, writer_lock

WINDOW_BLOCK = 2_000_000  # comparisons looked at together
RANGE_BITS = 12  # at most so many bits of a key or class name its range
RANGE_KEYS, RANGE_SETS = 1 << 20, 1 << 17  # rows wanted in a range
BLOCK_ROWS = 1_000_000  # key records of a batch that are sent to history at once: 50 MB
MOST_RUNS, REKEY = 8, 8
ROUNDS, GROUP_LINKS = 4, 5_000_000
SETS = "ck long, words array<long>"


def range_of(c: str, bits: int) -> Column:
    """The range of a 64-bit hash: its first bits."""
    return F.shiftrightunsigned(c, 64 - bits).cast("int") if bits else F.lit(0)


def bits_for(rows: int, wanted: int) -> int:
    return min(RANGE_BITS, max(0, math.ceil(math.log2(max(1, rows) / wanted))))


def window_pairs(keys: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of keys(KEY_SCHEMA, side): two classes of a key in the window around each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in S.by_keys(batches):
            key, size, ck, side = whole["key"].to_numpy(), whole["n"].to_numpy().astype(np.int64), whole["ck"].to_numpy(), whole["side"].to_numpy()
            order = np.lexsort((size, key))
            key, size, ck, side, sketch = key[order], size[order], ck[order], side[order], S.read_sketches(whole)[order]
            at = np.cumsum(np.r_[False, key[1:] != key[:-1]]) * (1 << 24) + size
            # the smaller of a pair looks up
            high = np.searchsorted(at, at - size + np.floor(size / S.floor_sim(similarity)).astype(np.int64), side="right")
            count = high - np.arange(len(at)) - 1
            ends = np.cumsum(count)
            done = 0
            while done < len(at):
                base = ends[done - 1] if done else 0
                until = max(done + 1, int(np.searchsorted(ends, base + WINDOW_BLOCK, side="right")))
                n = count[done:until]
                a = np.repeat(np.arange(done, until), n)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                keep = (side[a] == 0) | (side[a] != side[b])
                a, b = a[keep], b[keep]
                hit = S.hamming(sketch[a], sketch[b]) <= S.radius(size[a], size[b], similarity)
                x = np.unique(np.stack([np.minimum(ck[a[hit]], ck[b[hit]]), np.maximum(ck[a[hit]], ck[b[hit]])], axis=1), axis=0)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])
                done = until

    return S.together(keys).mapInArrow(run, "a long, b long")


class HistoryIndex:
    """Accepted texts as sorted runs under `path` (default: a new folder in the shared one); what is there already is taken up."""

    def __init__(self, spark: SparkSession, path: str | None = None, similarity: float = 0.7, least: int = 8):
        self.spark, self.similarity, self.least = spark, similarity, least
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
        #: shorter texts can't be similar to a text of `least` words
        self.partner = math.ceil(least * S.floor_sim(similarity))
        self.manifest = Manifest(spark, self.path)
        self._open()

    def _open(self) -> None:
        self.version, self.state = self.manifest.latest()
        if self.state and (self.state["similarity"], self.state["least"]) != (self.similarity, self.least):
            raise ValueError(f"{self.path} was made with similarity {self.state['similarity']} and least {self.state['least']}")
        self.state = {"similarity": self.similarity, "least": self.least, "freq": None, "total": 0, "runs": [], "gone": []} | self.state
        self._freq: np.ndarray | None = None

    @property
    def runs(self) -> list[str]:
        return [r["name"] for r in self.state["runs"]]

    def _commit(self, **changes: object) -> None:
        """The new state; files the state before it had done without are removed."""
        gone = [n for r in self.state["runs"] if r not in changes["runs"] for n in (f"sets/{r['name']}", f"keys/{r['name']}")]
        if self.state["freq"] not in (None, changes.get("freq", self.state["freq"])):
            gone.append(f"freq/{self.state['freq']}")
        old, self.state = self.state["gone"], self.state | changes | {"gone": gone}
        self.version = self.manifest.commit(self.version, self.state)
        folder = Folder(self.spark, self.path)
        for name in old:
            folder.delete(name)

    # ---- tables -------------------------------------------------------------------------------

    def _table(self, kind: str, schema: str, column: str, ranges: DataFrame | list[int] | None) -> DataFrame:
        """The rows of all runs; of `ranges` (numbers of RANGE_BITS bits) only."""
        parts = []
        for r in self.state["runs"]:
            t = self.spark.read.schema(f"{schema}, range int").parquet(f"{self.path}/{kind}/{r['name']}")
            if ranges is not None:
                t = t.where(F.col("range").isin(sorted({x >> (RANGE_BITS - r[column]) for x in ranges})))
            parts.append(t.drop("range"))
        out = parts[0]
        for t in parts[1:]:
            out = out.unionByName(t)
        return out

    def _keys(self, ranges: list[int] | None = None) -> DataFrame:
        return self._table("keys", S.KEY_SCHEMA, "key_bits", ranges)

    def _sets(self, ranges: list[int] | None = None) -> DataFrame:
        return self._table("sets", SETS, "set_bits", ranges)

    def frequencies(self) -> np.ndarray:
        """How often each bucket of words came when the order of words was fixed: any fixed order is exact."""
        if self._freq is None:
            t = self.spark.read.schema("b int, n int").parquet(f"{self.path}/freq/{self.state['freq']}").toArrow()  # at most BUCKETS rows
            self._freq = np.zeros(S.BUCKETS, np.int32)
            self._freq[t["b"].to_numpy()] = t["n"].to_numpy()
        return self._freq

    def _order(self, rows: DataFrame, total: int) -> dict:
        """The order of words by rows(ck, words): {freq, total}, written down."""
        name, self._freq = f"freq-{uuid.uuid4().hex[:8]}", S.frequencies(rows)
        some = np.flatnonzero(self._freq)
        table = pa.table({"b": pa.array(some.astype(np.int32)), "n": pa.array(self._freq[some])})
        self.spark.createDataFrame(table, "b int, n int").coalesce(1).write.parquet(f"{self.path}/freq/{name}")
        return {"freq": name, "total": total}

    def _run(self, rows: DataFrame, order: dict | None = None, keys: DataFrame | None = None) -> tuple[dict, dict]:
        """(a new run of rows(ck, words), the order of words): sets by range of class, each class once; keys in sorted files by range of key."""
        name = f"run-{uuid.uuid4().hex[:12]}"
        raw = f"{self.path}/raw/{name}"
        rows.write.parquet(raw)
        rows = self.spark.read.schema(SETS).parquet(raw)
        n = rows.count()
        order = order or self._order(rows, n)
        bits = bits_for(n, RANGE_SETS)
        by_class = rows.withColumn("range", range_of("ck", bits)).repartition(max(1, 1 << bits), "range")
        by_class.groupBy("range", "ck").agg(F.first("words").alias("words")).write.partitionBy("range").parquet(f"{self.path}/sets/{name}")
        if keys is None:
            keys = S.prefix_keys(rows, self.frequencies(), order["total"], self.similarity)
        key_bits = bits_for(8 * n, RANGE_KEYS)  # about so many keys to a class
        # ranges of about equal size, so a key of very many rows is cut into several files
        filed = keys.withColumn("range", range_of("key", key_bits)).repartitionByRange("range", "key", "n", "ck").sortWithinPartitions("range", "key", "n")
        filed.write.partitionBy("range").parquet(f"{self.path}/keys/{name}")
        Folder(self.spark, self.path).delete(f"raw/{name}")
        return {"name": name, "rows": n, "key_bits": key_bits, "set_bits": bits}, order

    # ---- changes ------------------------------------------------------------------------------

    def start(self, texts: DataFrame) -> HistoryIndex:
        """The first run, of all texts already accepted."""
        with writer_lock(self.spark, self.path):
            self._open()
            if self.state["runs"]:
                raise ValueError(f"{self.path} has a history already")
            run, order = self._run(S.once_per_task(S.with_word_sets(texts, [], self.partner, by_scope=False)))
            self._commit(runs=[run], **order)
        return self

    def compact(self, every: bool = True) -> None:
        """All runs merged into one of disjoint ranges, each class once; unless `every`, only the smaller runs."""
        with writer_lock(self.spark, self.path):
            self._open()
            self._compact(every)

    def _compact(self, every: bool) -> None:
        runs = sorted(self.state["runs"], key=lambda r: r["rows"])
        chosen, size = runs[:2], sum(r["rows"] for r in runs[:2])
        for r in runs[2:]:
            if every or r["rows"] <= 2 * size:
                chosen, size = [*chosen, r], size + r["rows"]
        total = sum(r["rows"] for r in runs)
        grown = total >= REKEY * max(1, self.state["total"])
        if grown:
            chosen = runs
        if len(chosen) < 2 and not grown:
            return
        whole, self.state = self.state, self.state | {"runs": chosen}
        sets, keys = self._sets(), None if grown else self._keys().dropDuplicates(["key", "ck"])
        self.state = whole
        run, order = self._run(sets, None if grown else {"freq": whole["freq"], "total": whole["total"]}, keys)
        self._commit(runs=[*(r for r in whole["runs"] if r not in chosen), run], **order)

    def ingest(self, items: DataFrame) -> DataFrame:
        """(batch_no, pos, is_case) of items(batch_no, pos, text) that are long enough to be cases; the accepted ones join the history."""
        with writer_lock(self.spark, self.path):
            self._open()
            return self._ingest(items)

    def _ingest(self, items: DataFrame) -> DataFrame:
        place = F.shiftleft("batch_no", 32) + F.col("pos")
        rows = stored(S.with_word_sets(items, ["batch_no", "pos"], self.partner, by_scope=False).withColumn("ord", place), "p3-items")
        once = S.once_per_task(rows)
        order = {"freq": self.state["freq"], "total": self.state["total"]} if self.state["freq"] else self._order(once, rows.count())
        classes = rows.groupBy("ck").agg(F.min("ord").alias("ord"), F.first(F.size("words")).alias("size"))
        fresh = stored(S.prefix_keys(once, self.frequencies(), order["total"], self.similarity), "p3-keys")
        spread = S.spread(fresh, S.SHARD_MOST + 1)
        links = stored(S.verified(window_pairs(spread, self.similarity).distinct(), rows, self.similarity), "p3-links")
        state = F.when(F.col("size") < self.least, 1)
        if self.runs:
            hits = self._known(rows, fresh).withColumn("hit", F.lit(True))
            begun = classes.join(hits, "ck", "left").select("ck", "ord", state.when(F.col("hit"), 2).otherwise(0).alias("state"))
        else:
            begun = classes.select("ck", "ord", state.otherwise(0).alias("state"))
        verdict = stored(self._resolve(stored(begun, "p3-begun"), links), "p3-states")
        items = rows.where(F.size("words") >= self.least).join(verdict.select("ck", F.col("ord").alias("first"), "state"), "ck")
        out = stored(items.select("batch_no", "pos", ((F.col("state") == 2) | (F.col("ord") != F.col("first"))).alias("is_case")), "p3-verdicts")
        accepted = S.once_per_task(rows.join(verdict.where("state = 1").select("ck"), "ck", "left_semi").select("ck", "words"))
        run, order = self._run(accepted, order)
        self._commit(runs=[*self.state["runs"], run], **order)
        if len(self.runs) > MOST_RUNS or sum(r["rows"] for r in self.state["runs"]) >= REKEY * max(1000, self.state["total"]):
            self._compact(every=False)
        return out

    def _known(self, rows: DataFrame, fresh: DataFrame) -> DataFrame:
        """(ck) of the classes of rows that history has, or has a similar one of."""
        at = range_of("key", RANGE_BITS)
        counts = sorted(tuple(r) for r in fresh.groupBy(at.alias("r")).count().collect())  # at most 2^RANGE_BITS rows
        t = S.floor_sim(self.similarity)
        ours = fresh.select("key", F.col("ck").alias("a"), F.col("n").alias("m"), F.col("s0").alias("t0"), F.col("s1").alias("t1"), F.ceil(F.col("n") * t).alias("low"), F.floor(F.col("n") / t).alias("high"))
        apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("t1")))
        window = (F.col("n") >= F.col("low")) & (F.col("n") <= F.col("high")) & (apart <= F.floor((1 - t) / (1 + t) * (F.col("n") + F.col("m"))))
        path = f"{shared_dir(self.spark)}/p3-met-{uuid.uuid4().hex}"
        for ranges, part, parts in _blocks(counts):
            block = ours.where(at.isin(ranges))
            if parts > 1:
                block = block.where(F.expr(f"pmod(xxhash64(a), {parts}) = {part}"))
            met = self._keys(ranges).join(F.broadcast(block), "key").where(window)  # at most about BLOCK_ROWS rows, counted above
            met.select("a", F.col("ck").alias("b")).write.mode("append").parquet(path)
        if not counts:
            return rows.select("ck").limit(0)
        met = stored(self.spark.read.schema("a long, b long").parquet(path).distinct(), "p3-pairs")
        # equal sets need no check
        same, near = met.where("a = b").select("a"), met.where("a != b")
        needed = [r[0] for r in near.select(range_of("b", RANGE_BITS).alias("r")).distinct().collect()]  # at most 2^RANGE_BITS rows
        sets = rows.select("ck", "words").unionByName(self._sets(needed))
        return same.unionByName(S.verified(near, sets, self.similarity).select("a")).distinct().withColumnRenamed("a", "ck")

    @classmethod
    def _resolve(cls, begun: DataFrame, links: DataFrame) -> DataFrame:
        """States of the classes: 1 accepted, 2 case; open ones (0) follow from links between fresh classes in their order."""
        ends = begun.select("ck", "ord")
        later = (
            links.join(ends.toDF("a", "oa"), "a").join(ends.toDF("b", "ob"), "b")
            .select(F.when(F.col("oa") > F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("ck"), F.when(F.col("oa") > F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("before"))
        )
        later = stored(later.join(begun.where("state = 0").select("ck"), "ck"), "p3-later")
        linked = later.select("ck").distinct()
        settled = begun.join(linked, "ck", "left_anti").select("ck", "ord", F.when(F.col("state") == 0, 1).otherwise(F.col("state")).alias("state"))
        # only classes at the end of a link, and those before them, take part in the rounds
        around = linked.unionByName(later.select(F.col("before").alias("ck"))).distinct()
        now = stored(begun.join(around, "ck").join(linked.withColumn("waits", F.lit(True)), "ck", "left").select("ck", "ord", F.when((F.col("state") == 0) & F.col("waits").isNull(), 1).otherwise(F.col("state")).alias("state")), "p3-state")
        now = cls._rounds(now, later, ROUNDS)
        if now.where("state = 0").limit(1).count():
            now = cls._rounds(stored(cls._in_order(now, later), "p3-state"), later, None)
        return settled.unionByName(now.join(linked, "ck").select("ck", "ord", "state"))

    @staticmethod
    def _rounds(now: DataFrame, later: DataFrame, most: int | None) -> DataFrame:
        done = 0
        while done != most and now.where("state = 0").limit(1).count():
            seen = later.join(now.select(F.col("ck").alias("before"), F.col("state").alias("s")), "before").groupBy("ck").agg(F.max((F.col("s") == 1).cast("int")).alias("hit"), F.min(F.when(F.col("s") == 0, 0).otherwise(1)).alias("closed"))
            step = F.when(F.col("state") != 0, F.col("state")).when(F.col("hit") == 1, 2).when(F.col("closed") == 1, 1).otherwise(0)
            now = stored(now.join(seen, "ck", "left").select("ck", "ord", step.alias("state")), "p3-state")
            done += 1
        return now

    @staticmethod
    def _in_order(now: DataFrame, later: DataFrame) -> DataFrame:
        """now with the open classes of each connected group of at most GROUP_LINKS links resolved one after another, a group in one task."""
        opened = now.where("state = 0").select("ck", "ord")
        states = now.select(F.col("ck").alias("before"), F.col("state").alias("s"))
        links = stored(later.join(opened, "ck").join(states, "before").where("s != 2").select("ck", "ord", "before", "s"), "p3-open")
        inner = links.where("s = 0").select(F.col("ck").alias("a"), F.col("before").alias("b"))
        labels = components(stored(inner.unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"))), "p3-both"), opened.select("ck", F.col("ck").alias("group_seq")))
        named = stored(links.join(labels, "ck"), "p3-named")
        small = named.groupBy("group_seq").count().where(F.col("count") <= GROUP_LINKS).select("group_seq")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, at, case, state = None, None, False, {}
            out: list[tuple[int, int]] = []
            for b in batches:
                for g, ck, before, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    if ck != at or g != group:
                        if at is not None:
                            state[at] = 2 if case else 1
                            out.append((at, state[at]))
                        at, case = ck, False
                        if g != group:
                            group, state = g, {}
                    case |= s == 1 or state.get(before) == 1
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32()))], names=["ck", "found"])
                out = []
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([2 if case else 1], pa.int32())], names=["ck", "found"])

        ordered = named.join(small, "group_seq").select("group_seq", "ck", "before", "s", "ord").repartition("group_seq").sortWithinPartitions("group_seq", "ord", "ck")
        done = ordered.mapInArrow(run, "ck long, found int")
        return now.join(done, "ck", "left").select("ck", "ord", F.coalesce("found", "state").alias("state"))


def _blocks(counts: list[tuple[int, int]]) -> Iterator[tuple[list[int], int, int]]:
    """(ranges, part, parts): ranges with together at most BLOCK_ROWS rows, or a part of the rows of a larger range."""
    ranges, n = [], 0
    for r, c in counts:
        if c > BLOCK_ROWS:
            parts = -(-c // BLOCK_ROWS)
            yield from (([r], i, parts) for i in range(parts))
            continue
        if n + c > BLOCK_ROWS:
            yield ranges, 0, 1
            ranges, n = [], 0
        ranges, n = [*ranges, r], n + c
    if ranges:
        yield ranges, 0, 1


def batch_items(envelopes: DataFrame) -> DataFrame:
    """(batch_no, pos, text) of envelopes(batch_no, memories)."""
    return envelopes.select("batch_no", F.posexplode("memories").alias("pos", "m")).select("batch_no", F.col("pos").cast("long").alias("pos"), F.col("m.text").alias("text"))


def found(memories: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(batch_no, pos) of the items that repeat a stored text or an earlier accepted item."""
    index = HistoryIndex(memories.sparkSession).start(memories)
    return index.ingest(batch_items(envelopes)).where("is_case").select("batch_no", "pos")
