"""The decision log: append, retention, and reports over it.

A line has ts, decision, reason, type, subject, source, scope, client and text; the default scope and
empty fields are left out of the file. Texts are cut after MOST characters with an ellipsis; texts that
must not be kept are replaced before they get here (screen.logged_text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import cut
from recordloom.operators.normalize import DEFAULT_SCOPE, scope_key

MOST = 500
DECISIONS = ["saved", "superseded", "duplicate", "possible_duplicate", "conflict", "rejected", "forgotten", "imported"]
FIELDS = ["ts", "decision", "reason", "type", "subject", "source", "scope", "client", "text"]


def lines(df: DataFrame) -> DataFrame:
    """df(FIELDS) as it goes into the log."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    scope = F.nullif(given("scope"), F.lit(DEFAULT_SCOPE))
    return df.select("ts", "decision", *(given(c).alias(c) for c in ("reason", "type", "subject", "source")), scope.alias("scope"), given("client").alias("client"), cut(F.col("text"), MOST).alias("text"))


def rotate(spark, path: str, most_bytes: int) -> bool:  # noqa: ANN001
    """A log of at least so many bytes is set aside as path.1, in place of the one set aside before; says whether it was."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    log, aside = hadoop.Path(path.rstrip("/")), hadoop.Path(f"{path.rstrip('/')}.1")
    fs = log.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(log) or fs.getContentSummary(log).getLength() < most_bytes:
        return False
    fs.delete(aside, True)
    return fs.rename(log, aside)


def append(df: DataFrame, path: str, most_bytes: int | None = None) -> None:
    """JSON lines in folders by day, without null fields; a log that has grown to most_bytes is set aside first."""
    if most_bytes is not None:
        rotate(df.sparkSession, path, most_bytes)
    lines(df).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").option("ignoreNullFields", "true").json(path)


def drop_days_before(spark, path: str, day: str) -> int:  # noqa: ANN001
    """Retention: the folders of earlier days are removed; returns how many."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("day=") and s.getPath().getName()[4:] < day] if fs.exists(root) else []
    for p in old:
        fs.delete(p, True)
    return len(old)


def rollup(df: DataFrame) -> DataFrame:
    """Lines by decision, source and scope, with subtotals; level is 0 for single groups, 7 for the total."""
    keyed = df.select("decision", F.coalesce("source", F.lit("(none)")).alias("source"), scope_key().alias("scope"), "text")
    return keyed.rollup("decision", "source", "scope").agg(F.count("*").alias("n"), F.count("text").alias("texts"), F.grouping_id().alias("level"))


def by_window(df: DataFrame, width: str = "1 day") -> DataFrame:
    """Lines and rejections in windows of time."""
    return df.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "rejected").alias("rejected")).select(F.col("w.start").alias("start"), "n", "rejected")
