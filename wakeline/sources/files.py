"""File sources: trajectory JSONL, folders of JSON, message arrays, text, and named datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline import schema

#: Short names of datasets, with their paths and splits.
DATASETS = {"swe-smith": ("SWE-bench/SWE-smith-py", "train"), "swe-bench": ("SWE-bench/SWE-bench_Verified", "train")}


def read_jsonl(spark: SparkSession, path: str, fields: T.StructType, required: tuple[str, ...] = (), mode: str = "FAILFAST") -> DataFrame:
    """One record per line by an explicit schema; blank lines are skipped. A missing required field fails the read."""
    rows = spark.read.schema(fields).option("mode", mode).json(path)
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(F.col(name)))
    return rows


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """AgentTrajectory records; absent lists, ids and contents get their defaults, task and summary are required."""
    rows = read_jsonl(spark, path, schema.TRAJECTORY, ("task", "summary"))
    none = F.array().cast(T.ArrayType(schema.STEP))
    return rows.withColumns({"trajectory_id": F.coalesce("trajectory_id", F.lit("")), "steps": F.coalesce("steps", none), "continuation": F.coalesce("continuation", none)})


def read_folder(spark: SparkSession, path: str, fields: T.StructType, skip_stem: str = "collect") -> DataFrame:
    """One JSON object per file `*.json`; files that can't be parsed are left out, and so is `collect.json`."""
    with_bad = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(with_bad).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.where(F.col("_corrupt_record").isNull() & (F.col("file_name") != f"{skip_stem}.json")).drop("_corrupt_record")


def read_message_array(spark: SparkSession, path: str, fields: T.StructType = schema.MESSAGE) -> DataFrame:
    """pos and the fields of the messages of a file that is one JSON array; arguments may be objects or text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", T.ArrayType(fields))).alias("pos", "_m")).select("pos", "_m.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with its whole text as `value`."""
    return spark.read.text(path, wholetext=True)


def read_dataset(spark: SparkSession, name: str, root: str, split: str | None = None) -> DataFrame:
    """A dataset stored as `root/<path>/<split>.parquet` or `.json`; short names stand for paths, split defaults to train."""
    path, default = DATASETS.get(name, (name, "train"))
    at = f"{root.rstrip('/')}/{path}/{split or default}"
    try:
        return spark.read.parquet(f"{at}.parquet")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.read.json(f"{at}.json")


def history_messages(records: DataFrame) -> DataFrame:
    """instance_id, pos, role, content of history records."""
    return records.select("instance_id", F.posexplode("history").alias("pos", "_h")).select("instance_id", "pos", "_h.role", "_h.content")
