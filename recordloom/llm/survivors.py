"""Best representative of each duplicate group: votes per field.

The rows of a group (same scope, same sequence of words) are unpivoted to one long row per field.
Each row votes for its normalised value with source trust times recency decay; votes are summed per
value, partly before the shuffle, and the winner of each field is chosen by max_by and pivoted back
(elect). Two results come of it: survivors(), the voted values, and provenance(), the row each field
is taken from, under a strict order (trust, then recency, then smallest seq), which is the same vote
with weights that cannot add up.

Texts of fewer than `least` distinct words and null texts form no group; groups of one row are left
out. A null field gets no vote; a group without a value of a field has null (provenance: -1). Ties go
to the value of the smallest seq. Null times count as older than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.words import scope_key, words

# The trusted sources, most trusted first, and what stands for no subject.
TRUSTED = ["userexplicit", "userconfirmed", "agentinferred"]
NO_SUBJECT = ["", "none", "n/a", "unknown"]

HALF_LIFE_DAYS = 180.0


def trust(source: Column) -> Column:
    """3, 2, 1 for the known sources in any spelling; 0 for anything else."""
    key = F.regexp_replace(F.lower(source), r"[\s _\-]+", "")
    return F.when(key == TRUSTED[0], 3).when(key == TRUSTED[1], 2).when(key == TRUSTED[2], 1).otherwise(0)


def has_subject(subject: Column) -> Column:
    return subject.isNotNull() & ~F.lower(F.regexp_replace(subject, r"^[\s ]+|[\s ]+$", "")).isin(*NO_SUBJECT)


def grouped(df: DataFrame, fields: list[str], least: int = 8) -> DataFrame:
    """df's seq and fields with `g`, 16 bytes that name the scope and the sequence of words."""
    cols = ["seq", *fields]
    extra = [f.name for f in df.schema if f.name in cols]
    schema = "g binary, " + ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for i, (text, scope) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                w = words(text)
                if len(w) >= least and len(set(w)) >= least:
                    rows.append(i)
                    keys.append(xxhash.xxh3_128_digest("\0".join([scope_key(scope), *w]).encode("utf-8", "surrogatepass")))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(b.column(2 + i).take(take) for i in range(len(extra)))], names=["g", *extra])

    return df.select(F.col("text").alias("_text"), F.col("scope").alias("_scope"), *extra).mapInArrow(run, schema)


def elect(rows: DataFrame, ballots: dict[str, tuple[Column, Column]], weight: dict[str, Column] | Column, strict: bool) -> DataFrame:
    """(g, first, copies, and of each field the struct `field` (seq, value)) of rows(g, seq, ...), groups of two or more.

    ballots: of each field the normalised value a row votes for (null: it has none) and the value as it is. The rows are unpivoted to one per
    field; the weights of a normalised value's rows are summed, or, if strict, its greatest weight counts, so that no number of small votes adds
    up to a large one; of the value that wins, the row of the greatest weight, then the smallest seq, is the one taken. Ties of values go to
    the one whose best row comes first."""
    of = lambda f: weight[f] if isinstance(weight, dict) else weight
    long = rows.select("g", "seq", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), key.cast("string").alias("key"), value.cast("string").alias("value"), of(f).alias("weight")) for f, (key, value) in ballots.items()))).alias("b"))
    long = long.select("g", "seq", "b.*").withColumn("best", F.struct("weight", (-F.col("seq")).alias("s")))
    # votes of a value are merged before the shuffle, so a hot group is a few rows per task
    tally = F.max("weight") if strict else F.round(F.sum("weight"), 9)
    votes = long.groupBy("g", "field", "key").agg(F.count("*").alias("n"), F.min("seq").alias("first"), tally.alias("votes"), F.max(F.struct("best", "value")).alias("top"))
    cast = F.col("key").isNotNull()
    order = F.when(cast, F.struct("votes", F.col("top.best").alias("best")))
    winner = votes.groupBy("g", "field").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max_by(F.when(cast, F.col("top")), order).alias("top")).where("n > 1")
    taken = F.struct((-F.col("top.best.s")).alias("seq"), F.col("top.value").alias("value"))
    return winner.groupBy("g").agg(F.min("first").alias("first"), F.max("n").alias("copies"), *(F.max(F.when((F.col("field") == f) & F.col("top").isNotNull(), taken)).alias(f) for f in ballots))


def shown(c: Column) -> Column:
    """A value without regard to case, padding, and space, `_` or `-`."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "-")


def provenance(df: DataFrame, least: int = 8) -> DataFrame:
    """(group_seq, source_seq, updated_seq, subject_seq) of df(seq, text, scope, source, subject, updated_at).

    The voting of elect() with strict weights: a row's vote is its trust, then its recency; a source is voted for by its degree of trust."""
    rows = grouped(df, ["source", "subject", "updated_at"], least)
    trusted = F.struct(trust(F.col("source")).alias("trust"), F.col("updated_at").alias("at"))
    none = F.lit(None)  # only the rows are wanted, not their values
    late = F.struct(F.lit(0).alias("trust"), F.col("updated_at").alias("at"))
    ballots = {
        "source": (trust(F.col("source")), none),
        "updated": (F.coalesce(F.unix_micros("updated_at").cast("string"), F.lit("")), none),
        "subject": (F.when(has_subject(F.col("subject")), shown(F.col("subject"))), none),
    }
    wide = elect(rows, ballots, {"source": trusted, "updated": late, "subject": trusted}, strict=True)
    return wide.select(F.col("first").alias("group_seq"), *(F.coalesce(F.col(f"{f}.seq"), F.lit(-1)).cast("long").alias(f"{f}_seq") for f in ballots))


def survivors(df: DataFrame, fields: tuple[str, ...] = ("type", "subject", "source", "status"), least: int = 8, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """One row per group of two or more: group_seq, copies and the voted value of each field (strings), as the winning value's best row has it.

    A vote is (1 + trust) * 2^(-age / half life), the age counted from the latest updated_at of the table."""
    rows = grouped(df, [*dict.fromkeys([*fields, "source", "subject", "updated_at"])], least)
    latest = df.agg(F.max("updated_at").alias("latest"))  # one row
    age = F.coalesce((F.unix_micros("latest") - F.unix_micros("updated_at")) / F.lit(86_400_000_000.0), F.lit(3650.0))
    vote = F.round((1 + trust(F.col("source"))) * F.pow(F.lit(2.0), -age / half_life_days), 12)
    ballots = {f: (F.when(has_subject(F.col(f)), shown(F.col(f))) if f == "subject" else shown(F.col(f).cast("string")), F.col(f)) for f in fields}
    wide = elect(rows.crossJoin(F.broadcast(latest)), ballots, vote, strict=False)
    return wide.select(F.col("first").alias("group_seq"), "copies", *(F.col(f"{f}.value").alias(f) for f in fields))


def found(memories: DataFrame) -> DataFrame:
    return provenance(memories)
