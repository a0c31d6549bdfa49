"""The store at rest: segments that are appended, retirements beside them, a manifest that names both.

A change writes only what is new: a segment of accepted records, and a table of the records that gave way
(seq, superseded_by, superseded_at), applied on reading. Records that go, forgotten or past their grace,
cost a rewrite of the segments they lie in. When there are more than MOST_SEGMENTS the smaller ones are
merged. The manifest is committed last (sources.manifest), so a crash at any moment leaves the old store,
and of two writers that began at the same state one fails and changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.manifest import Folder, Manifest

MOST_SEGMENTS = 16
RETIRED = "seq long, superseded_by string, superseded_at timestamp"


class SegmentTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.manifest = Manifest(spark, path)
        self.refresh()

    def refresh(self) -> None:
        self.version, state = self.manifest.latest()
        self.state = {"segments": [], "retired": [], "last": 0, "gone": []} | state

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def rows(self, segments: list[dict] | None = None) -> DataFrame:
        """The records, those that gave way as superseded."""
        segments = self.state["segments"] if segments is None else segments
        raw = self._read([s["name"] for s in segments])
        if not self.state["retired"]:
            return raw
        given = self.spark.read.schema(RETIRED).parquet(*[f"{self.path}/{n}" for n in self.state["retired"]]).toDF("seq", "_by", "_at")
        once = given.groupBy("seq").agg(F.min_by("_by", "_at").alias("_by"), F.min("_at").alias("_at"))
        yields = F.col("_at").isNotNull() & (F.col("status") == "active")
        new = {"status": F.lit("superseded"), "superseded_by": F.col("_by"), "superseded_at": F.col("_at"), "updated_at": F.col("_at")}
        joined = raw.join(once, "seq", "left")
        return joined.select(*(F.when(yields, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in raw.columns))

    def _write(self, df: DataFrame) -> dict | None:
        """A segment of df, or None if it has no rows."""
        name = f"segment-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{name}")
        first, last, soonest, n = self._read([name]).agg(F.min("seq"), F.max("seq"), F.unix_micros(F.min("expires_at")), F.count("*")).head()
        return {"name": name, "rows": n, "first": first, "last": last, "soonest": soonest} if n else None

    def _commit(self, **changes: object) -> None:
        old = {*(s["name"] for s in self.state["segments"]), *self.state["retired"]}
        delete, self_state = self.state["gone"], self.state | changes
        # a reader of the state before may still be at it: its files go with the next change
        self_state["gone"] = sorted(old - {s["name"] for s in self_state["segments"]} - set(self_state["retired"]))
        self.version = self.manifest.commit(self.version, self_state)
        self.state = self_state
        folder = Folder(self.spark, self.path)
        for n in delete:
            folder.delete(n)

    def append(self, fresh: DataFrame, retired: DataFrame | None = None, expired_micros: int | None = None) -> None:
        """Adds records and retirements; with expired_micros, records that expired by then go at the same time."""
        segment = self._write(fresh.select(*self._read([]).columns))
        segments = [*self.state["segments"], *([segment] if segment else [])]
        tables = list(self.state["retired"])
        if retired is not None:
            name = f"retired-{uuid.uuid4().hex[:12]}"
            retired.select("seq", "superseded_by", "superseded_at").write.parquet(f"{self.path}/{name}")
            tables.append(name)
        last = max([self.state["last"], *(s["last"] for s in segments)])
        before, self.state = self.state, self.state | {"segments": segments, "retired": tables, "last": last}
        after = self._without_expired(segments, expired_micros) if expired_micros is not None else segments
        after, tables = self._merged(after, tables)
        self.state = before
        self._commit(segments=after, retired=tables, last=last)

    def _without_expired(self, segments: list[dict], micros: int) -> list[dict]:
        out = []
        for s in segments:
            if s["soonest"] is not None and s["soonest"] <= micros:
                kept = self._write(self._read([s["name"]]).where(F.col("expires_at").isNull() | (F.unix_micros("expires_at") > micros)))
                out += [kept] if kept else []
            else:
                out.append(s)
        return out

    def remove_expired(self, micros: int) -> int:
        """Removes the records that expired by an instant; returns how many."""
        after = self._without_expired(self.state["segments"], micros)
        n = sum(s["rows"] for s in self.state["segments"]) - sum(s["rows"] for s in after)
        if n:
            self._commit(segments=after)
        return n

    def remove(self, gone: DataFrame) -> None:
        """Removes the records of gone(seq): the segments they lie in are written anew."""
        out = []
        for s in self.state["segments"]:
            here = gone.where(F.col("seq").between(s["first"], s["last"]))
            if here.limit(1).count():
                kept = self._write(self._read([s["name"]]).join(here.select("seq"), "seq", "left_anti").select(*self._read([]).columns))
                out += [kept] if kept else []
            else:
                out.append(s)
        self._commit(segments=out)

    def _merged(self, segments: list[dict], tables: list[str]) -> tuple[list[dict], list[str]]:
        """The smaller segments in one, if there are too many; retirements are applied for good when all are merged."""
        if len(segments) <= MOST_SEGMENTS and len(tables) <= 4 * MOST_SEGMENTS:
            return segments, tables
        order = sorted(segments, key=lambda s: s["rows"])
        chosen, size = order[:2], sum(s["rows"] for s in order[:2])
        for s in order[2:]:
            if len(tables) > 4 * MOST_SEGMENTS or s["rows"] <= 2 * size:
                chosen, size = [*chosen, s], size + s["rows"]
        whole = self._write(self.rows(chosen))
        rest = [s for s in segments if s not in chosen]
        return [*rest, *([whole] if whole else [])], (tables if rest else [])
