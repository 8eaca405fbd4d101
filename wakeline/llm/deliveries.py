"""Keys that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.lineage import stored


def arrival(items: DataFrame, at: str | None) -> Column:
    """When a row arrived, for `once`; null where there is no such column."""
    return (F.col(at) if at in items.columns else F.lit(None)).cast("timestamp").alias("_at")


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those whose key was delivered before, by `_at` (which is dropped), then by their place. Null keys are one key.

    Keys and times are shuffled, and joined only for keys that were delivered again; these are stored, so the planner knows how
    few they are, and moves the rows themselves only if they are many.
    """
    placed = rows.withColumn("_no", F.monotonically_increasing_id())
    again = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct("_at", "_no")).alias("_f")).where("_n > 1")
    again = stored(again.select(*(F.col(k).alias("_" + k) for k in keys), F.col("_f._no").alias("_first")))
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    return placed.join(again, same, "left").where("_first IS NULL OR _first = _no").drop("_at", "_no", "_first", *("_" + k for k in keys))
