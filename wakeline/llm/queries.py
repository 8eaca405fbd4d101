"""Queries of the problems 2 to 8, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import leaks, mixing, pairs, pieces, quality, runs, splits
from wakeline.llm.sql import SQL  # noqa: F401


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(_table(spark, d, "trajectories"), _table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.groups(_table(spark, d, "trajectories")).select(F.col("id").alias("trajectory_id"), "group_id")


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split(_table(spark, d, "trajectories")).withColumnRenamed("id", "trajectory_id")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    made = splits.split(_table(spark, d, "trajectories"))
    return made.groupBy("split", "label").agg(F.count("*").alias("n"), F.countDistinct("group_id").alias("n_groups"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.step_runs(_table(spark, d, "agent_steps")).select("run_id", "first_pos", "last_pos")


def p4_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.step_runs(_table(spark, d, "agent_steps"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    made = pieces.pieces(_table(spark, d, "agent_steps"), _table(spark, d, "trajectories"), with_text=False)
    return made.groupBy("item_kind", "item_key", "item_pos").agg(F.max("forced").alias("forced"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(_table(spark, d, "agent_steps"), _table(spark, d, "trajectories"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "heldout_tasks"), "item_id", ["problem_statement", "test_patch"]).withColumnsRenamed({"doc_key": "doc_id", "item_key": "item_id"})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1].where("short").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0].withColumnRenamed("doc_key", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    made = quality.text_statistics(_table(spark, d, "documents"), "doc_id", "text")
    return made.where(F.col("form") != quality.PROSE).select("doc_id", "form")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(_table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_split, p3_shares, p4_found, p4_runs, p5_found, p5_pieces, p6_found, p6_passages, p7_found, p7_mix, p7_shares, p8_found, p8_statistics)}
