"""A folder as a relation of file names and bodies.

Spark's file readers reject names with colons, which run manifests use; this source reads them. A partition is a share of
the names; bodies are read on the executors, and only if they are wanted.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "wakeline_listing"


def register(spark: SparkSession) -> None:
    """Registers the format. The classes are made here so that they travel to executors by value."""

    class Names(InputPartition):
        def __init__(self, names: list[str]) -> None:
            self.names = names

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path, self.bodies = options["path"], str(options.get("bodies", "true")).lower() == "true"
            self.size, self.only = int(options.get("files_per_partition", 1000)), options.get("only")

        def partitions(self) -> list[InputPartition]:
            if self.only is not None:  # no need to list the folder
                return [Names([self.only] if os.path.isfile(os.path.join(self.path, self.only)) else [])]
            with os.scandir(self.path) as entries:
                names = sorted(e.name for e in entries if e.is_file())
            return [Names(names[i : i + self.size]) for i in range(0, len(names), self.size)] or [Names([])]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            for name in partition.names:
                body = None
                if self.bodies:
                    with open(os.path.join(self.path, name), encoding="utf-8", errors="replace") as f:
                        body = f.read()
                yield name, body

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return "file_name string, body string"

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    spark.dataSource.register(Listing)


def read_listing(spark: SparkSession, path: str, bodies: bool = True, files_per_partition: int = 1000) -> DataFrame:
    """file_name, body of the files in a folder that all executors see; body is null unless wanted."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).option("bodies", bodies).option("files_per_partition", files_per_partition).load()


def read_one(spark: SparkSession, path: str, uid: str) -> DataFrame:
    """The base record of a run: the file `<uid>:0.json`."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).option("only", f"{uid}:0.json").load()
