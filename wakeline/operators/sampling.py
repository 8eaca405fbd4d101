"""Shuffles, slices, batches and augmentation.

Ranks over a whole table need an order of all rows. `ranked` gets it without a single task for all rows: rows are counted
per hash bucket (a bounded table), and ranked within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.functions.text import key_hash, matches_start
from wakeline.names import fresh

BUCKETS = 1 << 12
HASHES = 1 << 28


def shuffle_order(seed: int | str, *keys: Column) -> Column:
    """A number by which sorting shuffles rows, the same for the same seed."""
    return key_hash(F.lit(str(seed)), *keys)


def ranked(df: DataFrame, order: Column, *ties: str, name: str = "rn") -> DataFrame:
    """Adds the rank from 0 by `order` (a number in [0, HASHES)) and then by the tie columns."""
    o, b, base = fresh([*df.columns, name], "_o", "_bucket", "_base")
    rows = df.withColumn(o, order).withColumn(b, F.floor(F.col(o) / (HASHES // BUCKETS)).cast("int"))
    # at most BUCKETS rows, whatever the size of df
    counts = rows.groupBy(b).count().select(F.col(b), F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    rank = F.row_number().over(Window.partitionBy(b).orderBy(o, *ties)) - 1 + F.col(base)
    return rows.join(F.broadcast(counts), b).withColumn(name, rank.cast("long")).drop(o, b, base)


def take_slice(df: DataFrame, spec: str, rn: str = "rn") -> DataFrame:
    """The rows of a slice `a:b` or `a:b:c` of ranked rows; negative bounds count from the end, c must be positive."""
    a, b, c = ([int(x) if x.strip() else None for x in spec.split(":")] + [None, None])[:3]
    step = 1 if c is None else c
    if step <= 0:
        raise ValueError("the step must be positive")
    n = df.count() if any(x is not None and x < 0 for x in (a, b)) else None
    bound = lambda x: max(0, n + x) if x is not None and x < 0 else x
    low, high, r = bound(a) or 0, bound(b), F.col(rn)
    rows = df.where(r >= low)
    if high is not None:
        rows = rows.where(r < high)
    return rows if step == 1 else rows.where((r - low) % step == 0)


def filter_ids(df: DataFrame, id_col: str, pattern: str) -> DataFrame:
    """Rows whose id matches the pattern at its start."""
    return df.where(matches_start(F.col(id_col), pattern))


def batches(df: DataFrame, size: int, rn: str = "rn") -> DataFrame:
    """Adds batch_id to ranked rows and drops the rows of the last, incomplete batch; fails if there is no complete one."""
    n = df.count()
    if n < size:
        raise ValueError(f"{n} rows are fewer than a batch of {size}")
    return df.where(F.col(rn) < n // size * size).withColumn("batch_id", F.floor(F.col(rn) / size).cast("long"))


def augment(trajectories: DataFrame, key: str, steps: str, epoch: int, min_fraction: float, cut) -> DataFrame:
    """The rows and, for each with two steps or more, one with a random prefix of max(1, n * min_fraction) to n - 1 steps.

    cut: function (DataFrame, Column) -> DataFrame that cuts to a prefix. Adds is_prefix.
    """
    n = F.size(F.coalesce(F.col(steps), F.array().cast(trajectories.schema[steps].dataType)))
    low = F.greatest(F.lit(1), F.floor(n * F.lit(min_fraction)).cast("int"))
    able = trajectories.where(n >= 2)
    length = low + (key_hash(F.lit(str(epoch)), F.col(key)) % F.greatest(n - low, F.when(n > low, F.lit(1)).otherwise(F.raise_error(F.lit("no prefix length is left"))))).cast("int")
    return trajectories.withColumn("is_prefix", F.lit(False)).unionByName(cut(able, length).withColumn("is_prefix", F.lit(True)))


def learning_rate(batch: Column, base: float, epochs: int, n_rows: int, batch_size: int) -> Column:
    """Falls linearly to 0 over the batches of all epochs."""
    return F.lit(base) * F.greatest(F.lit(0.0), F.lit(1.0) - batch / F.lit(float(max(1, epochs * (n_rows // batch_size)))))


def progress(batch: Column, total: int) -> Column:
    return (batch + 1) / F.lit(float(total))
