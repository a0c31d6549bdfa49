"""Streaming forms: supersession by keyed state, the exact fold by micro-batch, windows with a watermark.

supersession_stream keeps, per scope and subject, the greatest trust so far: state of a few bytes per
key, spread by key. fold_stream applies the exact rule of integrate.fold to each micro-batch against a
stored table, of which it is the only writer; a batch is written once per batch number, so a repeated
batch after a failure changes nothing. The table is only ever added to: what a later record has retired
follows from the records themselves (integrate.standing). Rows without a subject are always created.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordloom.operators.integrate import fold, standing
from recordloom.operators.normalize import Policy, scope_key, subject_key, trust
from recordloom.session import shared_dir
from recordloom.sources.manifest import Folder


def file_stream(spark: SparkSession, df: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the parquet files a table was read from, with its schema; at most so many files to a micro-batch."""
    names = df.inputFiles()
    folder, first = names[0].rsplit("/", 1)
    # a table of one file may lie beside others
    raw = spark.readStream.schema(spark.read.parquet(*names).schema).option("pathGlobFilter", first if len(names) == 1 else "*.parquet")
    raw = (raw.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else raw).parquet(folder)
    return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema))


def supersession_stream(stream: DataFrame) -> DataFrame:
    """(seq, action) of a stream of (seq, scope, subject, source) that arrives in order of seq within each micro-batch's keys."""
    keyed = stream.select("seq", scope_key().alias("scope_key"), subject_key().alias("subject_key"), F.coalesce(trust(), F.lit(1)).cast("int").alias("trust")).where("subject_key is not null")

    def judge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else 0
        # a key's rows of one micro-batch are judged in order of seq
        rows = pd.concat(list(parts), ignore_index=True).sort_values("seq")
        before = np.maximum(rows["trust"].cummax().shift(fill_value=0).to_numpy(), most)
        action = np.where(before == 0, "created", np.where(rows["trust"].to_numpy() < before, "conflict", "superseded"))
        state.update((int(max(most, rows["trust"].max())),))
        yield pd.DataFrame({"seq": rows["seq"], "action": action})

    return keyed.groupBy("scope_key", "subject_key").applyInPandasWithState(judge, "seq long, action string", "most int", "append", GroupStateTimeout.NoTimeout)


def windows_stream(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, by, n): rows per window of time and value; rows later than `late` are dropped in append mode."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all its present input, as a table."""
    spark = stream.sparkSession
    name = f"drained_{uuid.uuid4().hex}"
    if mode == "append":
        path = f"{shared_dir(spark)}/{name}"
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    # complete results are aggregates, written anew for each batch
    path = f"{shared_dir(spark)}/{name}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def fold_stream(stream: DataFrame, store_path: str, log_path: str, checkpoint: str, policy: Policy = Policy()):  # noqa: ANN201, B008
    """A started query that folds each micro-batch into the parquet table at store_path and logs every outcome at log_path."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = Folder(spark, store_path).names()
        held = None
        if any(n.startswith("batch=") and n != f"batch={number}" for n in there):
            scopes = batch.select(scope_key().alias("_scope")).distinct()
            before = spark.read.option("basePath", store_path).parquet(store_path).where(F.col("batch") < number)
            held = standing(before.withColumn("_scope", scope_key()).join(scopes, "_scope", "left_semi").drop("_scope"), "batch", "seq")
        outcomes = fold(batch, held, policy)
        outcomes.write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        kept = spark.read.parquet(f"{log_path}/batch={number}").where(F.col("action").isin("created", "superseded")).select("seq")
        batch.join(kept, "seq", "left_semi").write.mode("overwrite").parquet(f"{store_path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
