"""The pN_ queries: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bktree, history, leaks, neighbours, pii, split, survivors, tokens
from recordloom.session import dealt


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.found(_read(spark, sf_dir, "memories"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_read(spark, sf_dir, "memories"), _read(spark, sf_dir, "gate_log"), _read(spark, sf_dir, "given_names"))


def p2_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "given_names")
    both = [pii.detect(_read(spark, sf_dir, t), key, names).selectExpr(f"'{t}' as table_name", "row_key", "masked") for t, key in (("memories", "seq"), ("gate_log", "line_no"))]
    return both[0].unionByName(both[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.found(_read(spark, sf_dir, "memories"), _read(spark, sf_dir, "export_envelopes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bktree.near_pairs(_read(spark, sf_dir, "memories"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bktree.near_groups(_read(spark, sf_dir, "memories"))


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bktree.near_links(_read(spark, sf_dir, "memories"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.found(_read(spark, sf_dir, "memories"))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(_read(spark, sf_dir, "memories"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(_read(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.found(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.found(_read(spark, sf_dir, "documents"))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
