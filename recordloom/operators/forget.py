"""Finding and removing records by a copied id or prefix.

An id counts within its scope only: an exact match, else a prefix of at least LEAST_PREFIX characters
that fits one row. Blank ids and short prefixes are not found. Rows delivered twice under one id make an
exact match of the first, and an ambiguous prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.normalize import LEAST_PREFIX, id_key, scope_key


def resolve(store: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, result, seq, matches) of asked(ask_id, id, scope): result is ok, not-found or ambiguous.

    Both sides meet on scope and the first LEAST_PREFIX characters, so the join is an equi-join."""
    head = lambda c: F.substring(c, 1, LEAST_PREFIX)
    needles = asked.select("ask_id", scope_key().alias("scope"), id_key("id").alias("needle"))
    rows = store.select("seq", scope_key().alias("scope"), F.lower("id").alias("id")).withColumn("head", head(F.col("id")))
    hits = needles.withColumn("head", head(F.col("needle"))).join(rows, ["scope", "head"]).where(F.expr("id = needle or (length(needle) >= 8 and startswith(id, needle))"))
    exact = F.col("id") == F.col("needle")
    found = hits.groupBy("ask_id").agg(F.min(F.when(exact, F.col("seq"))).alias("exact"), F.count("*").alias("n"), F.min("seq").alias("first"))
    state = F.when(F.col("exact").isNotNull(), "ok").when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("not-found")
    return needles.join(found, "ask_id", "left").select("ask_id", state.alias("result"), F.when(state == "ok", F.coalesce("exact", "first")).alias("seq"), F.coalesce("n", F.lit(0)).alias("matches"))


def forget(store: DataFrame, asked: DataFrame) -> DataFrame:
    """The store without the rows that were found."""
    return store.join(resolve(store, asked).where("result = 'ok'").select("seq").distinct(), "seq", "left_anti")
