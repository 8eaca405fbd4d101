"""Cutting lineage so that a job survives the loss of executors.

`cut` uses reliable checkpoints. `stored` writes a table into the same folder and reads it again: unlike a checkpoint, which
computes its last stage twice, it computes it once, and the planner of what follows knows its true size. The folder is the
one the cluster names in `spark.checkpoint.dir`; only where that is unset and Spark runs in local mode (tests) a folder of our
own is made. Stored tables are deleted when the application ends.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, set on the context if it is not set yet."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wakeline-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed and written to the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once and written as a table in the checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/wakeline-{uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
