"""The store at rest: versions of the file, reading, atomic writing, export, import of own exports.

A store is one JSON document (a bare list, or {schemaVersion, memories}) or parquet. Missing or blank
files are empty stores; invalid JSON and records without a text fail the whole read, and nothing is
overwritten. Blank and null scopes become "default"; other scopes stay as they are. Only a bare list
(version 1) has missing expiries computed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.text import trim
from recordloom.operators.normalize import DEFAULT_SCOPE, SOURCES, STATUSES, TYPES, Policy, expiry

SCHEMA_VERSION = 3
RECORD_JSON = (
    "id string, text string, type string, subject string, scope string, source string, status string, createdAt string, updatedAt string, expiresAt string, "
    "supersededBy string, supersededAt string, client struct<name:string,version:string>, embedding array<double>"
)
ENVELOPE_JSON = f"schemaVersion int, memories array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in RECORD_JSON.split(', '))}>>"
NAMES = {"createdAt": "created_at", "updatedAt": "updated_at", "expiresAt": "expires_at", "supersededBy": "superseded_by", "supersededAt": "superseded_at"}


class StoreError(ValueError):
    """A store or import file that can't be read as a whole."""


def instant(c: Column | str) -> Column:
    """A timestamp, or null if the text is no date."""
    return F.try_to_timestamp(F.col(c) if isinstance(c, str) else c)


def iso(c: Column | str, digits: int = 3) -> Column:
    """A timestamp as ISO text in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), f"yyyy-MM-dd'T'HH:mm:ss.{'S' * digits}'Z'")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): the JSON documents of a file or folder as whole texts; none if nothing is there."""
    recover(spark, path)
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "path string, doc string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")).where("trim(doc) != ''")


def unwrapped(docs: DataFrame) -> DataFrame:
    """(path, version, pos, m): the records of documents(path, doc) of any version, raw; m is null for records that are no objects. Other objects are empty stores."""
    bare = F.from_json("doc", f"array<struct<{ENVELOPE_JSON.split('array<struct<')[1][:-2]}>>")
    kind = F.schema_of_variant(F.try_parse_json("doc"))
    listed = docs.withColumn("kind", kind)
    one = F.from_json("doc", ENVELOPE_JSON)
    is_list = F.col("kind").startswith("ARRAY")
    broken = F.raise_error(F.concat(F.lit("invalid JSON in "), F.col("path")))
    records = F.when(F.col("kind").isNull(), broken).when(is_list, bare).otherwise(one["memories"])
    version = F.when(is_list, 1).otherwise(F.coalesce(one["schemaVersion"], F.lit(SCHEMA_VERSION)))
    return listed.select("path", version.alias("version"), F.posexplode(records).alias("pos", "m"))


def migrated(raw: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Store records of unwrapped(...), brought to the present version."""
    m = raw.select("path", "version", "pos", "m.*")
    created = instant("createdAt")
    expires = F.coalesce(instant("expiresAt"), F.when(F.col("version") == 1, expiry(created, F.col("type"), policy)))
    scope = F.when(F.coalesce(trim("scope"), F.lit("")) == "", DEFAULT_SCOPE).otherwise(F.col("scope"))
    return m.select(
        F.col("pos").cast("long").alias("seq"), "id", "text", "type", "subject", scope.alias("scope"), "source", F.coalesce("status", F.lit("active")).alias("status"),
        created.alias("created_at"), instant("updatedAt").alias("updated_at"), expires.alias("expires_at"), F.col("supersededBy").alias("superseded_by"), instant("supersededAt").alias("superseded_at"), "client", "embedding",
    )


def read_store(spark: SparkSession, path: str, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    return migrated(unwrapped(documents(spark, path)), policy)


def normalised(raw: DataFrame, now: Column) -> DataFrame:
    """Records for import of (pos, m): text needed, unknown sources and statuses replaced, unknown types dropped, instants kept if they are such; the scope is not carried.

    A missing id is derived from the record's place and text; missing instants are `now`."""
    m = raw.select("pos", "m.*") if "m" in raw.columns else raw
    text = trim("text")
    checked = F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.concat(F.lit("record #"), F.col("pos").cast("string"), F.lit(" has no text"))).cast("string")).otherwise(text)
    created = F.coalesce(instant("createdAt"), now)
    one_of = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(other)
    none = F.lit(None).cast("string")
    return m.select(
        F.col("pos").cast("long").alias("seq"),
        F.coalesce(F.when(trim("id") != "", F.col("id")), F.md5(F.concat_ws("|", F.col("pos").cast("string"), "text"))).alias("id"),
        checked.alias("text"), one_of("type", TYPES, none).alias("type"), F.when(trim("subject") != "", F.col("subject")).alias("subject"),
        one_of("source", SOURCES, F.lit(SOURCES[0])).alias("source"), one_of("status", STATUSES, F.lit("active")).alias("status"),
        created.alias("created_at"), F.coalesce(instant("updatedAt"), created).alias("updated_at"), instant("expiresAt").alias("expires_at"),
        F.nullif("supersededBy", F.lit("")).alias("superseded_by"), instant("supersededAt").alias("superseded_at"),
        F.when(trim("client.name") != "", F.col("client")).alias("client"), F.when(~F.exists(F.coalesce("embedding", F.array()), lambda x: x.isNull()), F.col("embedding")).alias("embedding"),
    )


def read_import(spark: SparkSession, path: str, now: Column) -> DataFrame:
    return normalised(unwrapped(documents(spark, path)), now)


def envelope(df: DataFrame, exported_at: str, generator: str, active_only: bool = False) -> DataFrame:
    """(seq, record): each record as the JSON object of an export; superseded and expired ones too, unless active_only."""
    rows = df.where("status = 'active'") if active_only else df
    fields = [F.col(c).alias({v: k for k, v in NAMES.items()}.get(c, c)) if not isinstance(df.schema[c].dataType, T.TimestampType) else iso(c).alias({v: k for k, v in NAMES.items()}[c]) for c in df.columns if c != "seq"]
    return rows.select("seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}).alias("record"))


def recover(spark: SparkSession, path: str) -> None:
    """Ends what a crash has left of write_atomically: if nothing is at path, what was there before comes back."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path.rstrip("/"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target) and fs.exists(target.getParent()):
        old = [s.getPath() for s in fs.listStatus(target.getParent()) if s.getPath().getName().startswith(f"{target.getName()}.old-")]
        if old:
            fs.rename(old[0], target)


def write_atomically(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """df in place of what is at path: written beside it first, then renamed; a failure leaves the old data, or lets recover() bring it back."""
    spark = df.sparkSession
    path = path.rstrip("/")
    recover(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, fresh, old = (hadoop.Path(p) for p in (path, f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.format(fmt).save(fresh.toString())
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(fresh, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise StoreError(f"could not replace {path}")
    fs.delete(old, True)


def write_export(df: DataFrame, path: str, exported_at: str, generator: str, active_only: bool = False) -> None:
    """An export as JSON lines: the head in one file, the records in as many as there are partitions, in store order."""
    write_atomically(envelope(df, exported_at, generator, active_only).orderBy("seq").select("record"), f"{path}/memories", "text")
    head = json.dumps({"schemaVersion": SCHEMA_VERSION, "exportedAt": exported_at, "generator": generator})
    write_atomically(df.sparkSession.createDataFrame([(head,)], "value string"), f"{path}/head", "text")
