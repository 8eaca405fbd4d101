"""Streams of run records and steps. These go beyond a re-scan of the output folder: late and repeated rows are handled by
watermarks, state is kept by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, fields: T.StructType, form: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_trigger).format(form).load(path)


def first_deliveries(steps: DataFrame, arrived: str = "arrived_at", delay: str = "3 days", keys: tuple[str, ...] = ("run_id", "pos")) -> DataFrame:
    """Rows of a stream of which each key passes once within the delay; state older than the watermark is dropped."""
    return steps.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(list(keys))


def finished_runs(steps: DataFrame, arrived: str = "arrived_at", delay: str = "3 days", done: tuple[str, ...] = ("Submitted", "LimitsExceeded"), window: str = "1 hour") -> DataFrame:
    """Runs that ended in each window of arrival, by instance: what a driver polls to know which instances are complete."""
    ends = first_deliveries(steps, arrived, delay).where((F.col("role") == "exit") & F.col("content").isin(list(done)))
    counted = ends.groupBy(F.window(arrived, window), "instance_id").agg(F.count("*").alias("n_done"))
    return counted.select(F.col("window.start").alias("window_start"), "instance_id", "n_done")
