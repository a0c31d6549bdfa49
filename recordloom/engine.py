"""A store with the gate in front of it: save, recall, forget, expired, compact, export, import.

A change appends what is new (sources.segments) under a lock that keeps writers in turn; the manifest it
ends with can be committed by one writer only. Every call takes the instant it happens at. Outcomes are DataFrames; each judged candidate goes into the decision log.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions.embed import Embedder, with_embedding
from recordloom.functions.text import blank_to_null
from recordloom.operators import age, forget, integrate, rank
from recordloom.operators import normalize as N
from recordloom.operators.derive import subject_of
from recordloom.operators.screen import logged_text, verdict
from recordloom.session import stored
from recordloom.sources import gatelog
from recordloom.sources import store as files
from recordloom.sources.manifest import writer_lock
from recordloom.sources.segments import SegmentTable

RECORD = (
    "seq long, id string, text string, type string, subject string, scope string, source string, status string, created_at timestamp, updated_at timestamp, "
    "expires_at timestamp, superseded_by string, superseded_at timestamp, client struct<name:string,version:string>, embedding array<double>"
)


def at(instant: dt.datetime) -> Column:
    """An instant as a literal; without a zone it is UTC."""
    return F.timestamp_micros(F.lit(int((instant if instant.tzinfo else instant.replace(tzinfo=dt.UTC)).timestamp() * 1_000_000)))


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, policy: N.Policy = N.Policy(), embedder: Embedder | None = None, log: str | None = None, log_bytes: int | None = None):  # noqa: B008
        """log_bytes: a log that has grown to so many bytes is set aside before the next lines, in place of the one set aside before."""
        self.spark, self.path, self.policy, self.embedder, self.log, self.log_bytes = spark, path, policy, embedder, log, log_bytes

    # ---- reading ------------------------------------------------------------------------------

    def records(self) -> DataFrame:
        """All records, superseded and expired ones too, with seq in store order."""
        return self._table().rows()

    def _table(self) -> SegmentTable:
        return SegmentTable(self.spark, self.path, RECORD)

    def recall(self, query: str, now: dt.datetime, scope: str | None = None, k: int = 5, include_retired: bool = False) -> DataFrame:
        """The k best records, best first, without their vectors."""
        vector = None
        if self.embedder is not None and query.strip():
            try:
                vector = self.embedder([query.strip()])[0]
            except Exception:  # noqa: BLE001 - recall then goes by words alone
                vector = None
        asked = self.spark.createDataFrame([(0, query, scope, vector)], "query_id long, query string, scope string, vector array<double>")
        best = rank.recall(self.records(), asked, k, at(now), include_retired)
        return best.join(self.records().drop("embedding"), "seq").orderBy("rank")

    def expired(self, now: dt.datetime, scope: str | None = None) -> DataFrame:
        """Hidden records of a scope (default: the default one) by the instant they become removable."""
        wanted = N.scope_key(F.lit(scope).cast("string"))
        return age.expired_report(self.records(), at(now), self.policy).where(F.col("scope_key") == wanted).drop("embedding").orderBy("removable_at", "seq")

    # ---- changing -----------------------------------------------------------------------------

    def _append_log(self, df: DataFrame) -> None:
        if self.log is not None:
            have = set(df.columns)
            gatelog.append(df.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in gatelog.FIELDS)), self.log, self.log_bytes)

    def save(self, candidates: DataFrame, now: dt.datetime) -> DataFrame:
        """Outcomes (n, id, action, rule, match_id, notice) of candidates(n, text[, content, memory, type, source, subject, scope, client]), offered in order of n (unique, from 0 up).

        action: invalid_argument, rejected, duplicate, conflict, possible_duplicate, superseded or created."""
        for c, t in (("type", "string"), ("source", "string"), ("subject", "string"), ("scope", "string"), ("client", "struct<name:string,version:string>")):
            if c not in candidates.columns:
                candidates = candidates.withColumn(c, F.lit(None).cast(t))
        texts = [c for c in ("text", "content", "memory") if c in candidates.columns]
        c = candidates.select("n", N.first_text(*texts).alias("text"), "type", "source", "subject", "scope", "client")
        good = N.known_type() & (F.col("source").isNull() | N.known_source()) & F.col("text").isNotNull()
        c = c.withColumn("good", good).withColumn("v", F.when(F.col("good"), verdict()))
        c = c.withColumns({"source": F.coalesce("source", F.lit(N.SOURCES[0])), "subject": N.subject_key(F.coalesce(blank_to_null("subject"), subject_of(F.col("text"))))})
        c = stored(c.withColumn("created_at", at(now)), "offered")
        passed = with_embedding(c.where("good and v.ok"), self.embedder)
        passed = passed.withColumns({"expires_at": N.expiry("created_at", "type", self.policy), "id": F.md5(F.concat_ws("|", F.lit(str(now)), F.col("n").cast("string"), "text"))})
        outcome = self._integrate(passed.withColumn("text", F.trim("text")).drop("good", "v"), now)
        short = outcome.action.isin("created", "superseded") & outcome.source.isin("user-explicit", "user-confirmed") & (F.unix_micros(outcome.expires_at) - F.unix_micros(outcome.created_at) <= N.SHORT_LIFE_DAYS * 86_400_000_000)
        judged = outcome.select("n", "id", "action", F.lit(None).cast("string").alias("rule"), "match_id", F.when(short, F.concat(F.lit("expires on "), F.date_format("expires_at", "yyyy-MM-dd"))).alias("notice"))
        none = F.lit(None).cast("string")
        refused = c.where("not good or not v.ok").select("n", none.alias("id"), F.when(F.col("good"), "rejected").otherwise("invalid_argument").alias("action"), F.col("v.rule").alias("rule"), none.alias("match_id"), none.alias("notice"))
        self._append_log(c.where("good and not v.ok").select(at(now).alias("ts"), F.lit("rejected").alias("decision"), F.col("v.rule").alias("reason"), "type", "subject", "source", "scope", F.col("client.name").alias("client"), logged_text(F.col("text"), F.col("v.redact")).alias("text")))
        return judged.unionByName(refused)

    def import_records(self, records: DataFrame, now: dt.datetime, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
        """(outcomes, report) of records of sources.store or sources.foreign: the active ones are offered in order of created_at; a dry run writes nothing."""
        have = set(records.columns)
        none = {"type": "string", "subject": "string", "scope": "string", "expires_at": "timestamp", "embedding": "array<double>", "client": "struct<name:string,version:string>", "seq": "long"}
        records = records.select(*records.columns, *(F.lit(None).cast(t).alias(c) for c, t in none.items() if c not in have))
        active = records.where(F.coalesce("status", F.lit("active")) == "active")
        # one order for the whole list: ids that rise along a range-partitioned sort
        offered = active.orderBy("created_at", "seq", "id").withColumn("n", F.monotonically_increasing_id()).select("n", "id", "text", "type", "subject", "scope", "source", "client", "created_at", "expires_at", "embedding")
        outcome = self._integrate(offered, now, write=not dry_run, reason="imported")
        report = integrate.import_report(outcome).crossJoin(records.agg((F.count("*") - F.count_if(F.coalesce("status", F.lit("active")) == "active")).alias("skipped")))  # two single rows
        return outcome.select("n", "id", "action", "match_id"), report

    def _integrate(self, offered: DataFrame, now: dt.datetime, write: bool = True, reason: str | None = None) -> DataFrame:
        """Candidates with action and match_id, after the store was changed by them."""
        if not write:
            return self._judged(self._table(), offered, now)
        with writer_lock(self.spark, self.path):
            table = self._table()
            outcome = self._judged(table, offered, now)
            accepted = outcome.where(F.col("action").isin("created", "superseded"))
            if accepted.limit(1).count():
                fresh = accepted.select(
                    "seq", "id", "text", "type", "subject", "scope", "source", F.lit("active").alias("status"), "created_at", F.col("created_at").alias("updated_at"), "expires_at",
                    F.lit(None).cast("string").alias("superseded_by"), F.lit(None).cast("timestamp").alias("superseded_at"), "client", "embedding",
                )
                table.append(fresh, self._retired(table.rows(), accepted, now), self._grace_end(now))
        decision = F.when(F.col("action") == "created", "saved").otherwise(F.col("action"))
        self._append_log(outcome.select(at(now).alias("ts"), decision.alias("decision"), F.lit(reason).cast("string").alias("reason"), "type", "subject", "source", "scope", F.col("client.name").alias("client"), "text"))
        return outcome

    def _judged(self, table: SegmentTable, offered: DataFrame, now: dt.datetime) -> DataFrame:
        rows = stored(offered.withColumns({"seq": F.col("n") + F.lit(table.state["last"] + 1), "scope": N.scope_key(), "subject": N.subject_key()}), "candidates")
        # a batch is judged at the instant of the call, whatever instants its records carry
        judged = stored(integrate.fold(rows.withColumn("created_at", at(now)), table.rows(), self.policy), "judged")
        met = judged.where("match_seq is not null").select(F.col("match_seq").alias("seq")).distinct()
        ids = table.rows().select("seq", "id").unionByName(rows.select("seq", "id")).join(met, "seq", "left_semi").toDF("match_seq", "match_id")
        return stored(rows.join(judged.select("seq", "action", "match_seq", "near"), "seq").join(ids, "match_seq", "left"), "outcome")

    @staticmethod
    def _retired(held: DataFrame, accepted: DataFrame, now: dt.datetime) -> DataFrame:
        """(seq, superseded_by, superseded_at): active records give way to the next accepted one of their scope and subject."""
        key = ["_s", "_k"]
        new = accepted.where("subject is not null").select(F.col("scope").alias("_s"), F.col("subject").alias("_k"), "seq", "id")
        first = new.groupBy(*key).agg(F.min_by("id", "seq").alias("superseded_by"))
        old = held.where("status = 'active'").select(N.scope_key().alias("_s"), N.subject_key().alias("_k"), "seq").join(first, key).select("seq", "superseded_by")
        within = new.withColumn("superseded_by", F.lead("id").over(Window.partitionBy(*key).orderBy("seq"))).where("superseded_by is not null").select("seq", "superseded_by")
        return old.unionByName(within).withColumn("superseded_at", at(now))

    def _grace_end(self, now: dt.datetime) -> int:
        """Records that expired by this instant (epoch microseconds) are past their grace."""
        now = now if now.tzinfo else now.replace(tzinfo=dt.UTC)
        return int(now.timestamp() * 1_000_000) - int(self.policy.grace_days * 86_400_000_000)

    def forget(self, ids: DataFrame, now: dt.datetime) -> DataFrame:
        """Results of ids(ask_id, id, scope); the records found are removed and logged."""
        with writer_lock(self.spark, self.path):
            table = self._table()
            results = stored(forget.resolve(table.rows(), ids), "forgotten")
            gone = results.where("result = 'ok'").select("seq").distinct()
            if gone.limit(1).count():
                lines = stored(table.rows().join(gone, "seq", "left_semi").select(at(now).alias("ts"), F.lit("forgotten").alias("decision"), "type", "subject", "source", "scope", F.col("client.name").alias("client"), "text"), "forgotten-lines")
                table.remove(gone)
                self._append_log(lines)
        return results

    def compact(self, now: dt.datetime) -> int:
        """Removes what is past its grace; returns how many records."""
        with writer_lock(self.spark, self.path):
            return self._table().remove_expired(self._grace_end(now))

    def export(self, path: str, now: dt.datetime, active_only: bool = False) -> None:
        files.write_export(self.records(), path, now.isoformat(), "recordloom", active_only)
