"""Bookkeeping over run manifests: which runs and branches exist, and what is missing.

A manifest is a table of file names. Names carry identity: `UUID:0.json` is a base run, `UUID:0:i:before_init[:m].json`,
`UUID:0:i:before:k[:m].json` and `UUID:0:i:after:n[:m].json` are branches of its step i.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How file names are written.
BASE = r"^([a-f0-9-]+):0\.json$"
BRANCH = r"^([a-f0-9-]+):0:\d+:.+\.json$"
STEP = r"^([a-f0-9-]+:0):(\d+):(?:(after|before):(\d+)|(before_init))(?::\d+)?\.json$"
DONE = ("Submitted", "LimitsExceeded")


def parse_names(manifest: DataFrame, name: str) -> DataFrame:
    """base_uid, step, kind (after, before, before_init), k of the branch files; other names are left out."""
    n = F.col(name)
    part = lambda i: F.regexp_extract(n, STEP, i)
    rows = manifest.where(F.regexp_like(n, F.lit(STEP))).select(part(1).alias("base_uid"), part(2).cast("int").alias("step"), F.concat(part(3), part(5)).alias("kind"), F.expr(f"try_cast(regexp_extract({name}, '{_sql(STEP)}', 4) AS int)").alias("k"))
    return rows.where((F.col("kind") == "before_init") | F.col("k").isNotNull())


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


def bases_without_branches(manifest: DataFrame, name: str) -> DataFrame:
    """uid of base runs none of whose branches exists."""
    uid = lambda p: F.regexp_extract(F.col(name), p, 1)
    bases = manifest.where(F.regexp_like(F.col(name), F.lit(BASE))).select(uid(BASE).alias("uid")).distinct()
    branches = manifest.where(F.regexp_like(F.col(name), F.lit(BRANCH))).select(uid(BRANCH).alias("uid"))
    return bases.join(branches, "uid", "left_anti")


def steps_missing_before(manifest: DataFrame, name: str) -> DataFrame:
    """base_uid, step with after files but no before file."""
    rows = parse_names(manifest, name)
    after = rows.where("kind = 'after'").select("base_uid", "step").distinct()
    return after.join(rows.where("kind = 'before'"), ["base_uid", "step"], "left_anti")


def steps_incomplete(manifest: DataFrame, name: str, n_rollouts: int) -> DataFrame:
    """base_uid, step, n_existing, existing_ks, has_before_init of steps with after files but fewer than n_rollouts distinct
    before files. One shuffle: all kinds of a step are aggregated at once."""
    kind = F.col("kind")
    steps = parse_names(manifest, name).groupBy("base_uid", "step").agg(
        F.max(kind == "after").alias("a"), F.max(kind == "before_init").alias("has_before_init"), F.sort_array(F.collect_set(F.when(kind == "before", F.col("k")))).alias("existing_ks")
    )
    return steps.where(F.col("a") & (F.size("existing_ks") < n_rollouts)).select("base_uid", "step", F.size("existing_ks").cast("long").alias("n_existing"), "existing_ks", "has_before_init")


def completed(messages: DataFrame, traj: str, pos: str, role: str, instance: str, status: Column, done: tuple[str, ...] = DONE) -> DataFrame:
    """instance, n_done: runs whose last message has the role exit and one of the statuses; a missing instance counts as ''."""
    last = messages.groupBy(traj).agg(F.max_by(F.struct(F.col(role).alias("r"), status.alias("s"), F.coalesce(instance, F.lit("")).alias("i")), pos).alias("l"))
    return last.where((F.col("l.r") == "exit") & F.col("l.s").isin(list(done))).groupBy(F.col("l.i").alias(instance)).agg(F.count("*").alias("n_done"))


def open_instances(instances: DataFrame, key: str, done: DataFrame, runs_per_instance: int = 1) -> DataFrame:
    """Instances with fewer finished runs than wanted, with n_done. The filter comes before any costly work on them."""
    return instances.join(done, key, "left").withColumn("n_done", F.coalesce("n_done", F.lit(0))).where(F.col("n_done") < runs_per_instance)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by `order`."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def exit_statuses(records: DataFrame, status: str) -> DataFrame:
    """Counts of runs by exit status."""
    return records.groupBy(status).agg(F.count("*").alias("n"))
