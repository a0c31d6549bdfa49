"""Ageing: soft expiry, the expiry report, removal, and what is told about short lives.

Null expiry: never. A record expires at its instant (inclusive) and is removable after the grace,
whatever its status. Every operator takes the instant it judges at; conditions compare the bare column
with a constant, so that they reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.normalize import SHORT_LIFE_DAYS, Policy, expiry, live, plus_days, removable_at, scope_key


def visible(df: DataFrame, as_of: Column, include_retired: bool = False) -> DataFrame:
    return df if include_retired else df.where(live(as_of))


def expired_report(df: DataFrame, as_of: Column, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Active but expired records with the instant they become removable, soonest first where a caller orders by it."""
    return df.where((F.col("status") == "active") & (F.col("expires_at") <= as_of)).withColumns({"scope_key": scope_key(), "removable_at": removable_at(policy)})


def hidden_by_scope(df: DataFrame, as_of: Column, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Of each scope: hidden records, those a person vouched for, and the soonest removal."""
    human = F.col("source").isin("user-explicit", "user-confirmed")
    return expired_report(df, as_of, policy).groupBy("scope_key").agg(F.count("*").alias("hidden"), F.count_if(human).alias("human"), F.min("removable_at").alias("soonest"))


def removable(df: DataFrame, as_of: Column, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    return df.where(F.col("expires_at") <= plus_days(as_of, -policy.grace_days))


def compacted(df: DataFrame, as_of: Column, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > plus_days(as_of, -policy.grace_days)))


def with_expiry(df: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """Missing expiries computed from the type."""
    return df.withColumn("expires_at", F.coalesce("expires_at", expiry("created_at", "type", policy)))


def short_lives(df: DataFrame) -> DataFrame:
    """Records a person vouched for that live at most SHORT_LIFE_DAYS."""
    life = F.unix_micros("expires_at") - F.unix_micros("created_at")
    return df.where(F.col("source").isin("user-explicit", "user-confirmed") & (life <= SHORT_LIFE_DAYS * 86_400_000_000))
