"""Integrating candidates into the store.

Set-based forms (one shuffle each) where no order of events is needed beyond a running maximum:
first_of_text, supersession, current_facts, subject_matches. The exact, order-dependent rule (fold)
streams each scope in order through one Python state: duplicate of a live text, then trust conflict or
supersession by subject, then near-duplicate by vector, else created.

Null texts count as empty, null sources as agent-inferred, null scopes as default. Ties of order don't
arise: seq is unique. Empty inputs give empty results. Columns of the input that are named like those an
operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.normalize import DEFAULT_SCOPE, RELATED_AT, Policy, live, scope_key, subject_key, text_key, trust
from recordloom.session import stored


def first_of_text(df: DataFrame) -> DataFrame:
    """Of each text (trimmed, lower case) of a scope the first row by seq, with the number of its copies."""
    keyed = df.withColumns({"scope_key": scope_key(), "text_key": text_key()})
    # counting and choosing are aggregates, so copies are merged before the shuffle
    return keyed.groupBy("scope_key", "text_key").agg(F.min("seq").alias("seq"), F.count("*").alias("copies"))


def duplicates(candidates: DataFrame, store: DataFrame, as_of: F.Column) -> DataFrame:
    """The candidates whose text a live record of their scope has already."""
    held = store.where(live(as_of)).select(scope_key().alias("scope_key"), text_key().alias("text_key")).distinct()  # copies of a hot text are merged before the shuffle
    return candidates.withColumns({"scope_key": scope_key(), "text_key": text_key()}).join(held, ["scope_key", "text_key"], "left_semi")


def subject_matches(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """candidates with matches, max_trust and action: conflict, superseded or created by the active records (expired ones too) of their scope and subject."""
    held = (
        store.where("status = 'active'").select(scope_key().alias("scope_key"), subject_key().alias("subject_key"), trust().alias("t")).where("subject_key is not null")
        .groupBy("scope_key", "subject_key").agg(F.max("t").alias("max_trust"), F.count("*").alias("matches"))
    )
    keyed = candidates.drop("matches", "max_trust").withColumns({"scope_key": scope_key(), "subject_key": subject_key(), "trust": F.coalesce(trust(), F.lit(1))})
    action = F.when(F.col("matches").isNull(), "created").when(F.col("trust") < F.col("max_trust"), "conflict").otherwise("superseded")
    return keyed.join(held, ["scope_key", "subject_key"], "left").withColumn("action", action)


def supersession(df: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """df(seq, scope, subject, source, ...) in order: action and, for accepted rows, the seq that supersedes each.

    Exact where no text repeats within a subject and no vector interferes. A prefix scan: the rows of a key are cut into chunks of seq, windows run within a chunk, and what a chunk needs of the others comes from one row per key and chunk; a hot subject is spread over as many tasks as it has chunks."""
    keyed = df.drop("_b", "_m", "_f", "_earlier", "_later").withColumns({"scope_key": scope_key(), "subject_key": subject_key(), "trust": F.coalesce(trust(), F.lit(1))}).where("subject_key is not null").withColumn("_c", F.floor(F.col("seq") / chunk))
    key = ["scope_key", "subject_key", "_c"]
    of_key, within = Window.partitionBy("scope_key", "subject_key").orderBy("_c"), Window.partitionBy(*key).orderBy("seq")
    # a conflict never raises the maximum, so the running maximum is that of the accepted rows
    most = keyed.groupBy(*key).agg(F.max("trust").alias("_m")).withColumn("_earlier", F.max("_m").over(of_key.rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    before = F.greatest(F.max("trust").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_earlier"))
    acted = keyed.join(most, key).withColumn("_b", before).withColumn("action", F.when(F.col("_b").isNull(), "created").when(F.col("trust") < F.col("_b"), "conflict").otherwise("superseded"))
    accepted = F.when(F.col("action") != "conflict", F.col("seq"))
    first = acted.groupBy(*key).agg(F.min(accepted).alias("_f")).withColumn("_later", F.min("_f").over(of_key.rowsBetween(1, Window.unboundedFollowing))).drop("_f")
    following = F.coalesce(F.min(accepted).over(within.rowsBetween(1, Window.unboundedFollowing)), F.col("_later"))
    return acted.join(first, key).withColumn("superseded_by_seq", F.when(accepted.isNotNull(), following)).drop("_c", "_b", "_earlier", "_later")


def current_facts(df: DataFrame) -> DataFrame:
    """The accepted row of each scope and subject that nothing supersedes.

    Trust never falls along the accepted rows, so it is the last row of the greatest trust: an aggregate, merged before the shuffle. seq is from 0 to below 2^60."""
    keyed = df.withColumns({"scope_key": scope_key(), "subject_key": subject_key(), "trust": F.coalesce(trust(), F.lit(1))}).where("subject_key is not null")
    # trust and seq in one number, so that the aggregate is hashed, not sorted
    best = F.shiftleft(F.col("trust").cast("long"), 60) + F.col("seq")
    out = keyed.groupBy("scope_key", "subject_key").agg(F.max(best).alias("_best"), F.count("*").alias("candidates"))
    return out.select("scope_key", "subject_key", F.col("_best").bitwiseAND((1 << 60) - 1).alias("seq"), F.shiftright("_best", 60).cast("int").alias("trust"), "candidates")


def successors(df: DataFrame) -> DataFrame:
    """Superseded rows with the seq of their successor (the first row of that id) and whether it is active."""
    first = df.groupBy("id").agg(F.min("seq").alias("next_seq"), F.min_by("status", "seq").alias("next_status"))
    return df.where("superseded_by is not null").select("seq", "superseded_by").join(first.withColumnRenamed("id", "superseded_by"), "superseded_by", "left").select("seq", "next_seq", "next_status")


def chain_ends(df: DataFrame) -> DataFrame:
    """Superseded rows with the last row of their chain of successors and its length, by pointer doubling: as many rounds as the length has binary digits.

    A successor that isn't there ends a chain at the row before it; rows of a cycle have neither end nor length."""
    step = stored(successors(df).where("next_seq is not null").select("seq", F.col("next_seq").alias("end"), F.lit(1).cast("long").alias("length")), "chain")
    for _ in range(40):
        further = step.select(F.col("seq").alias("end"), F.col("end").alias("_e"), F.col("length").alias("_l"))
        after = stored(step.join(further, "end", "left").select("seq", F.coalesce("_e", "end").alias("end"), (F.col("length") + F.coalesce("_l", F.lit(0))).alias("length"), F.col("_e").isNotNull().alias("moved")), "chain")
        step = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return step
        if after.agg(F.max("length")).head()[0] > df.count():
            break  # longer than there are rows: a cycle
    ends = step.join(step.select(F.col("seq").alias("end")), "end", "left_anti")
    return step.join(ends.select("seq", F.lit(True).alias("_ok")), "seq", "left").select("seq", F.when(F.col("_ok"), F.col("end")).alias("end"), F.when(F.col("_ok"), F.col("length")).alias("length"))


OUTCOME = "seq long, scope_key string, subject_key string, action string, match_seq long, retired int, related int, near array<struct<seq:long,similarity:double>>"
HINTS = 3  # of the similar records that an outcome names


class Stack:
    """Vectors of one length that come one by one, and the records they are of."""

    def __init__(self, dim: int):
        self.vectors, self.records = np.empty((16, dim)), []

    def put(self, r: dict) -> None:
        n = len(self.records)
        if n == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
        self.vectors[n] = r.pop("vector")
        self.records.append(r)

    def near(self, vector: np.ndarray, least: float) -> list[tuple[float, dict]]:
        """In order of arrival; similarities to nine digits."""
        cos = np.round(self.vectors[: len(self.records)] @ vector, 9)
        return [(float(cos[i]), self.records[i]) for i in np.flatnonzero(cos >= least).tolist()]


class ScopeState:
    """The records of one scope while candidates are folded into it."""

    def __init__(self, duplicate_at: float, related_at: float):
        self.texts: dict[str, list[dict]] = {}
        self.subjects: dict[str, list[dict]] = {}
        self.vectors: dict[int, Stack] = {}
        self.duplicate_at, self.related_at = duplicate_at, related_at

    def put(self, r: dict) -> None:
        self.texts.setdefault(r["text_key"], []).append(r)
        if r["subject_key"]:
            self.subjects.setdefault(r["subject_key"], []).append(r)
        if (v := r["vector"]) is not None:
            (self.vectors.get(len(v)) or self.vectors.setdefault(len(v), Stack(len(v)))).put(r)

    @staticmethod
    def live(r: dict, now: int) -> bool:
        return r["active"] and (r["expires"] is None or r["expires"] > now)

    def near(self, vector: np.ndarray | None, now: int) -> list[tuple[float, dict]]:
        """Live records at least related, most similar first."""
        if vector is None or len(vector) not in self.vectors:
            return []
        return sorted(((c, r) for c, r in self.vectors[len(vector)].near(vector, self.related_at) if self.live(r, now)), key=lambda x: -x[0])

    def offer(self, r: dict, now: int) -> tuple[str, int | None, int, int, list[dict]]:
        """(action, seq of what it met, records retired, related records, the most similar ones)."""
        for other in self.texts.get(r["text_key"], []):
            if self.live(other, now):
                return "duplicate", other["seq"], 0, 0, []
        retired: list[dict] = []
        if r["subject_key"]:
            held = [x for x in self.subjects.get(r["subject_key"], []) if x["active"]]
            if held and r["trust"] < max(x["trust"] for x in held):
                return "conflict", held[0]["seq"], 0, 0, []
            for x in held:
                x["active"] = False
            if held:
                self.subjects[r["subject_key"]] = []
            retired = held
        near = [] if retired else self.near(r["vector"], now)
        hints = [{"seq": x["seq"], "similarity": round(c, 6)} for c, x in near[:HINTS]]
        if near and near[0][0] >= self.duplicate_at:
            return "possible_duplicate", near[0][1]["seq"], 0, 0, hints
        self.put(r)
        if retired:
            return "superseded", retired[-1]["seq"], len(retired), 0, []
        return "created", None, 0, len(near), hints


def unit(values: list | None) -> np.ndarray | None:
    """A vector of length 1, or None for what has no direction."""
    if not values or any(v is None for v in values):
        return None
    v = np.asarray(values, float)
    n = float(np.linalg.norm(v))
    return v / n if n > 0 and np.isfinite(n) else None


def fold(candidates: DataFrame, store: DataFrame | None = None, policy: Policy = Policy(), order: str = "seq") -> DataFrame:  # noqa: B008
    """OUTCOME rows of candidates(seq, text, scope, subject, source, created_at, expires_at, embedding) offered in order, after the rows of store.

    Each candidate is judged at its created_at. Of the store only active records of the candidates' scopes matter, and only those are shuffled. A scope is streamed through one task in order, holding its texts, subjects and vectors, not its rows: the rule is sequential within a scope."""
    wanted = {"seq": "long", "text": "string", "scope": "string", "subject": "string", "source": "string", "status": "string", "created_at": "timestamp", "expires_at": "timestamp", "embedding": "array<double>"}

    def shaped(df: DataFrame, held: bool) -> DataFrame:
        have = {f.name for f in df.schema}
        df = df.select(*(F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in wanted.items()), F.col(order).alias("_order"))
        return df.select(
            "seq", scope_key().alias("scope_key"), subject_key().alias("subject_key"), F.coalesce(text_key(), F.lit("")).alias("text_key"), F.coalesce(trust(), F.lit(1)).alias("trust"),
            (F.coalesce("status", F.lit("active")) == "active").alias("active"), F.unix_micros("created_at").alias("created"), F.unix_micros("expires_at").alias("expires"), "embedding", "_order", F.lit(held).alias("held"),
        )

    rows = shaped(candidates, False)
    if store is not None:
        scopes = candidates.select(scope_key().alias("scope_key") if "scope" in candidates.columns else F.lit(DEFAULT_SCOPE).alias("scope_key")).distinct()
        rows = rows.unionByName(shaped(store, True).where("active").join(scopes, "scope_key", "left_semi").select(rows.columns))
    duplicate_at = policy.duplicate_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, state = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["scope_key"] != scope or state is None:
                    scope, state = r["scope_key"], ScopeState(duplicate_at, RELATED_AT)
                r["vector"] = unit(r.pop("embedding"))
                if r["held"]:
                    state.put(r)
                else:
                    r["active"] = True
                    out.append((r["seq"], scope, r["subject_key"], *state.offer(r, r["created"] or 0)))
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("seq", pa.int64()), ("similarity", pa.float64())]))]
            names = ["seq", "scope_key", "subject_key", "action", "match_seq", "retired", "related", "near"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    return rows.repartition("scope_key").sortWithinPartitions("scope_key", F.desc("held"), "_order", "seq").mapInArrow(run, OUTCOME)


def standing(accepted: DataFrame, *order: str) -> DataFrame:
    """Accepted records with the status they have now: a later accepted one of their scope and subject retires them. `order` tells what is later."""
    keyed = accepted.withColumns({"_s": scope_key(), "_k": subject_key()})
    last = keyed.where("_k is not null").groupBy("_s", "_k").agg(F.max(F.struct(*order)).alias("_last"))
    retired = F.col("_last").isNotNull() & (F.struct(*order) < F.col("_last"))
    return keyed.join(last, ["_s", "_k"], "left").withColumn("status", F.when(retired, "superseded").otherwise("active")).select(*accepted.columns, *(["status"] if "status" not in accepted.columns else []))


def import_report(outcomes: DataFrame) -> DataFrame:
    """One row: how many candidates met each fate, and how many were imported."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return outcomes.agg(n("created"), n("superseded"), n("duplicate"), n("conflict"), n("possible_duplicate"), F.count_if(F.col("action").isin("created", "superseded")).alias("imported"), F.count("*").alias("total"))
