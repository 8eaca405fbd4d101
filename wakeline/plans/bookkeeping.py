"""Queries of sampling, manifest and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import images
from wakeline.operators import manifest as M
from wakeline.operators import sampling as P
from wakeline.operators import sequence as S
from wakeline.plans.sequences import ONCE, steps
from wakeline.plans.tables import table

_H = "(('0x' || substr(md5('{seed}:' || {key}), 1, 7))::bigint)"


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "task_instances").select("instance_id").distinct()


def shuffled_ids(spark, d):
    return P.ranked(_ids(spark, d), P.shuffle_order(42, F.col("instance_id")), "instance_id").select("instance_id", "rn")


def epoch_shuffle(spark, d):
    made = [P.ranked(_ids(spark, d), P.shuffle_order(f"epoch{e}", F.col("instance_id")), "instance_id").select("instance_id", "rn", F.lit(e).alias("epoch")) for e in (0, 1)]
    return made[0].unionByName(made[1])


def slice_then_filter(spark, d):
    return P.filter_ids(P.take_slice(shuffled_ids(spark, d), "5:-5:2"), "instance_id", "[a-m]")


def drop_remainder_batches(spark, d):
    return P.batches(shuffled_ids(spark, d), 16).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("instance_id").alias("first_id"))


def prefix_augmentation(spark, d):
    t = table(spark, d, "trajectories").select("trajectory_id", "steps", "continuation").dropDuplicates(["trajectory_id"])
    out = P.augment(t, "trajectory_id", "steps", 1, 0.5, lambda df, n: S.with_prefix(df, n))
    return out.select("trajectory_id", "is_prefix", F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps"), F.coalesce(F.size("continuation"), F.lit(0)).alias("n_continuation"))


def learning_rates(spark, d):
    rows = shuffled_ids(spark, d)
    n = rows.count()
    batch = F.col("batch_id").cast("double")
    return P.batches(rows, 16).select("batch_id").distinct().select("batch_id", P.learning_rate(batch, 0.001, 3, n, 16).alias("lr"), P.progress(batch, n // 16 * 3).alias("progress"))


def completed_counts(spark, d):
    return M.completed(steps(spark, d, "content", "instance_id"), "run_id", "pos", "role", "instance_id", F.col("content"))


def open_instances(spark, d):
    return M.open_instances(_ids(spark, d), "instance_id", completed_counts(spark, d), 2)


def task_lookup(spark, d):
    rows = table(spark, d, "task_instances").select("instance_id", "repo", F.length("patch").alias("patch_chars"), "created_at")
    return M.last_wins(rows, "instance_id", "created_at").select("instance_id", "repo", "patch_chars")


def exit_status_counts(spark, d):
    return M.exit_statuses(table(spark, d, "run_records").distinct().withColumn("status", F.lower(F.trim(F.coalesce("exit_status", F.lit(""))))), "status")


def _manifest(spark, d):
    """File names made from trajectory ids: cuts stand for after files; every third base has its own file."""
    i = F.lower("trajectory_id")
    uid, cut = F.substr(i, F.lit(1), F.lit(36)), F.expr("try_cast(regexp_extract(lower(trajectory_id), '[-_]cut([0-9]+)$', 1) AS int)")
    names = F.when(cut.isNotNull(), F.array(F.concat(uid, F.lit(":0:"), cut.cast("string"), F.lit(":after:"), (cut % 3).cast("string"), F.lit(".json")), F.concat(uid, F.lit(":0.json"))))
    branch = F.array(F.concat(i, F.lit(".json")), F.concat(uid, F.lit(":0.json")), F.concat(F.regexp_replace(i, ":before(_init)?.*$", ":after:0:7"), F.lit(".json")), F.concat(F.regexp_replace(i, ":before(:[0-9]+).*$", ":before$1:3"), F.lit(".json")))
    return table(spark, d, "trajectories").select(F.explode(F.coalesce(names, branch)).alias("file_name")).distinct()


def bases_without_branches(spark, d):
    bases = table(spark, d, "run_records").select(F.concat(F.lower("uid"), F.lit(":0.json")).alias("file_name")).where("file_name IS NOT NULL")
    return M.bases_without_branches(_manifest(spark, d).unionByName(bases), "file_name")


def steps_missing_before(spark, d):
    return M.steps_missing_before(_manifest(spark, d), "file_name")


def steps_incomplete_before(spark, d):
    return M.steps_incomplete(_manifest(spark, d), "file_name", 2).withColumn("existing_ks", F.array_join("existing_ks", ","))


def image_names(spark, d):
    t = table(spark, d, "task_instances").select("instance_id", "image_name").distinct()
    source = F.element_at(F.array(F.lit("SWE-Gym"), F.lit("swe-bench"), F.lit("org/SWE-smith-py")), (F.length("instance_id") % 3 + 1).cast("int"))
    iid = F.concat("instance_id", F.lit(".0a1b2c3d4e.func__x"))
    return t.select("instance_id", images.image_name(F.col("image_name"), iid, source).alias("image"), images.image_name(F.lit(None).cast("string"), iid, source, keep_suffix=True).alias("image_old"), images.cached_image_path(iid, "/cache/", "img_62d35bb.{base}.sif").alias("cached"))


QUERIES = {f.__name__: f for f in (
    shuffled_ids, epoch_shuffle, slice_then_filter, drop_remainder_batches, prefix_augmentation, learning_rates, completed_counts, open_instances, task_lookup, exit_status_counts,
    bases_without_branches, steps_missing_before, steps_incomplete_before, image_names,
)}

_IDS = "i AS (SELECT DISTINCT instance_id FROM task_instances)"
_RN = f"{_IDS}, r AS (SELECT instance_id, row_number() OVER (ORDER BY {_H.format(seed='42', key='instance_id')}, instance_id) - 1 AS rn, count(*) OVER () AS n FROM i)"
_DONE = f"{ONCE}, l AS (SELECT run_id, max_by({{'r': role, 's': content, 'i': coalesce(instance_id, '')}}, pos) AS l FROM s GROUP BY run_id), done AS (SELECT l.i AS instance_id, count(*) AS n_done FROM l WHERE l.r = 'exit' AND l.s IN ('Submitted', 'LimitsExceeded') GROUP BY l.i)"
_MANIFEST = """WITH t AS (SELECT lower(trajectory_id) AS i, substr(lower(trajectory_id), 1, 36) AS u, try_cast(regexp_extract(lower(trajectory_id), '[-_]cut([0-9]+)$', 1) AS int) AS c FROM trajectories),
m AS (SELECT DISTINCT unnest(CASE WHEN c IS NOT NULL THEN [u || ':0:' || c || ':after:' || (c % 3) || '.json', u || ':0.json']
  ELSE [i || '.json', u || ':0.json', regexp_replace(i, ':before(_init)?.*$', ':after:0:7') || '.json', regexp_replace(i, ':before(:[0-9]+).*$', ':before\\1:3') || '.json'] END) AS file_name FROM t),
a AS (SELECT DISTINCT regexp_extract(file_name, '^([a-f0-9-]+:0):', 1) AS base_uid, regexp_extract(file_name, '^[a-f0-9-]+:0:([0-9]+):', 1)::int AS step FROM m WHERE regexp_matches(file_name, '^[a-f0-9-]+:0:[0-9]+:after:[0-9]+(:[0-9]+)?[.]json$')),
b AS (SELECT DISTINCT regexp_extract(file_name, '^([a-f0-9-]+:0):', 1) AS base_uid, regexp_extract(file_name, '^[a-f0-9-]+:0:([0-9]+):', 1)::int AS step, regexp_extract(file_name, ':before:([0-9]+)', 1)::int AS k FROM m WHERE regexp_matches(file_name, '^[a-f0-9-]+:0:[0-9]+:before:[0-9]+(:[0-9]+)?[.]json$')),
z AS (SELECT DISTINCT regexp_extract(file_name, '^([a-f0-9-]+:0):', 1) AS base_uid, regexp_extract(file_name, '^[a-f0-9-]+:0:([0-9]+):', 1)::int AS step FROM m WHERE regexp_matches(file_name, '^[a-f0-9-]+:0:[0-9]+:before_init(:[0-9]+)?[.]json$'))"""
_BASE = "coalesce(nullif(regexp_extract({x}, '^(.+?[.][a-f0-9]{{{n}}})', 1), ''), {x})"
_IID = "(instance_id || '.0a1b2c3d4e.func__x')"
_IMG = """CASE length(instance_id) % 3 WHEN 0 THEN lower('docker.io/xingyaoww/sweb.eval.x86_64.' || replace({iid}, '__', '_s_') || ':latest') WHEN 1 THEN lower('docker.io/swebench/sweb.eval.x86_64.' || replace({iid}, '__', '_1776_') || ':latest')
  ELSE lower('docker.io/jyangballin/swesmith.x86_64.' || replace({base}, '__', '_1776_') || ':latest') END"""

SQL = {
    "shuffled_ids": f"WITH {_RN} SELECT instance_id, rn FROM r",
    "epoch_shuffle": f"WITH {_IDS} SELECT instance_id, row_number() OVER (ORDER BY {_H.format(seed='epoch0', key='instance_id')}, instance_id) - 1 AS rn, 0 AS epoch FROM i UNION ALL SELECT instance_id, row_number() OVER (ORDER BY {_H.format(seed='epoch1', key='instance_id')}, instance_id) - 1, 1 FROM i",
    "slice_then_filter": f"WITH {_RN} SELECT instance_id, rn FROM r WHERE rn >= 5 AND rn < n - 5 AND (rn - 5) % 2 = 0 AND regexp_matches(instance_id, '^[a-m]')",
    "drop_remainder_batches": f"WITH {_RN} SELECT rn // 16 AS batch_id, count(*) AS n, min(instance_id) AS first_id FROM r WHERE rn < n // 16 * 16 GROUP BY batch_id",
    "prefix_augmentation": f"""WITH q AS (SELECT trajectory_id, any_value(len(steps)) AS a, any_value(len(continuation)) AS b FROM trajectories GROUP BY trajectory_id),
p AS (SELECT trajectory_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, greatest(1, floor(coalesce(a, 0) * 0.5)::int) AS low FROM q),
k AS (SELECT *, (low + {_H.format(seed='1', key='trajectory_id')} % (a - low))::int AS n FROM p WHERE a >= 2)
SELECT trajectory_id, false AS is_prefix, a::int AS n_steps, b::int AS n_continuation FROM p UNION ALL SELECT trajectory_id, true, n, (a - n + b)::int FROM k""",
    "learning_rates": f"WITH {_RN} SELECT DISTINCT rn // 16 AS batch_id, 0.001::double * greatest(0::double, 1::double - (rn // 16)::double / greatest(1, 3 * (n // 16))) AS lr, ((rn // 16)::double + 1) / (n // 16 * 3) AS progress FROM r WHERE rn < n // 16 * 16",
    "completed_counts": f"{_DONE} SELECT instance_id, n_done FROM done",
    "open_instances": f"{_DONE}, {_IDS} SELECT i.instance_id, coalesce(n_done, 0) AS n_done FROM i LEFT JOIN done ON i.instance_id = done.instance_id WHERE coalesce(n_done, 0) < 2",
    "task_lookup": "SELECT instance_id, arg_max(repo, created_at) AS repo, max_by(coalesce(length(patch), -1), created_at) AS pc, CASE WHEN pc >= 0 THEN pc::int END AS patch_chars FROM task_instances GROUP BY instance_id",
    "exit_status_counts": "SELECT lower(trim(coalesce(exit_status, ''))) AS status, count(*) AS n FROM (SELECT DISTINCT * FROM run_records) GROUP BY status",
    "bases_without_branches": _MANIFEST + ", k AS (SELECT * FROM m UNION ALL SELECT lower(uid) || ':0.json' FROM run_records) SELECT DISTINCT regexp_extract(file_name, '^([a-f0-9-]+):0[.]json$', 1) AS uid FROM k WHERE regexp_matches(file_name, '^[a-f0-9-]+:0[.]json$') EXCEPT SELECT regexp_extract(file_name, '^([a-f0-9-]+):0:', 1) FROM k WHERE regexp_matches(file_name, '^[a-f0-9-]+:0:[0-9]+:.+[.]json$')",
    "steps_missing_before": _MANIFEST + " SELECT base_uid, step FROM a EXCEPT SELECT base_uid, step FROM b",
    "steps_incomplete_before": _MANIFEST + ", g AS (SELECT base_uid, step, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ks FROM b GROUP BY ALL) SELECT a.base_uid, a.step, coalesce(n, 0) AS n_existing, coalesce(ks, '') AS existing_ks, z.step IS NOT NULL AS has_before_init FROM a LEFT JOIN g ON a.base_uid = g.base_uid AND a.step = g.step LEFT JOIN z ON a.base_uid = z.base_uid AND a.step = z.step WHERE coalesce(n, 0) < 2",
    "image_names": f"""SELECT DISTINCT instance_id, coalesce(image_name, {_IMG.format(iid=_IID, base=_BASE.format(x=_IID, n='6,8'))}) AS image, {_IMG.format(iid=_IID, base=_IID)} AS image_old,
'/cache/img_62d35bb.' || lower(replace({_BASE.format(x=_IID, n='6,')}, '__', '_1776_')) || '.sif' AS cached FROM task_instances""",
}
SQL["task_lookup"] = "SELECT instance_id, repo, length(patch)::int AS patch_chars FROM (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY created_at DESC) AS n FROM task_instances) WHERE n = 1"
