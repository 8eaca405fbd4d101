"""Sinks: run records, JSONL, JSON arrays, metrics, and writes that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def append_records(records: DataFrame, path: str, partition_by: str = "exit_status", form: str = "json") -> None:
    """Appends run records, partitioned by exit status rather than one file per run; a null status is kept as its own."""
    records.write.mode("append").partitionBy(partition_by).format(form).save(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def json_arrays(messages: DataFrame, traj: str, pos: str, *fields: str) -> DataFrame:
    """trajectory, json: the messages of each trajectory as one JSON array in their order."""
    one = F.struct(F.col(pos).alias("_p"), F.struct(*fields).alias("m"))
    listed = messages.select(traj, one.alias("_o")).groupBy(traj).agg(F.array_sort(F.collect_list(F.struct("_o._p", F.to_json("_o.m").alias("j")))).alias("l"))
    return listed.select(traj, F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def append_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """Appends one row of metrics per step."""
    metrics.withColumn("step", F.lit(step)).write.mode("append").json(path)


def observed(df: DataFrame, name: str, **aggregates) -> tuple[DataFrame, Observation]:
    """df with aggregates that are gathered while it is written, and where they can be read afterwards."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in aggregates.items())), seen


def append_missing(rows: DataFrame, key: str, path: str) -> None:
    """Appends the rows whose key is not in the parquet table yet, so that a run that was broken off can be repeated."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    (rows if there is None else rows.join(there, key, "left_anti")).write.mode("append").parquet(path)
