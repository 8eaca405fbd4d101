"""Queries of the scoring operators and of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeline.functions import diff, render, text
from wakeline.operators import scoring as C
from wakeline.plans.tables import table


def _trajectories(spark, d, *cols):
    return table(spark, d, "trajectories").select("trajectory_id", *cols).dropDuplicates(["trajectory_id"])


def _entities(spark, d):
    t = _trajectories(spark, d, "steps", "continuation")
    both = t.select("trajectory_id", F.explode(F.concat(*(F.coalesce(c, F.array().cast(t.schema["steps"].dataType)) for c in ("steps", "continuation")))).alias("s"))
    return C.step_entities(both.select("trajectory_id", "s.*"), "trajectory_id")


def entities(spark, d):
    return _entities(spark, d)


def coverage(spark, d):
    return C.coverage(_entities(spark, d), _trajectories(spark, d, "summary"), "trajectory_id", "summary")


def _log_probs(spark, d):
    """A map of dimension to log-probability for each vector: the log-softmax of its values."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.exp(x)))
    pairs = F.transform("v", lambda x, i: F.struct(F.lpad(i.cast("string"), 2, "0").alias("k"), (x - norm).alias("p")))
    return e.select("vec_id", C.top_k(F.map_from_entries(pairs)).alias("top"))


def top_k(spark, d):
    return _log_probs(spark, d).select("vec_id", F.explode("top").alias("token", "log_prob"))


def topk_kl(spark, d):
    t = _log_probs(spark, d)
    nxt = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("top").alias("z"))
    return t.join(nxt, "vec_id").select("vec_id", C.kl(F.col("top"), F.col("z")).alias("kl"))


def distortion(spark, d):
    t = _log_probs(spark, d)
    groups = t.groupBy(F.floor(F.col("vec_id") / 10).cast("long").alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.map_entries("top").alias("top")))).alias("l"))
    tops = groups.select("g", F.transform("l", lambda r: F.map_from_entries(r["top"])).alias("x"))
    pos = C.kl_per_position(*C.completion_positions(F.col("x"), F.slice("x", 2, 100), F.lit(1), F.size("x"), F.lit(0)))
    out = tops.select("g", C.distortion(pos).alias("distortion"), F.size(pos).cast("long").alias("n_tokens"), F.coalesce(C.distortion_error(pos), F.lit("")).alias("error"))
    return out.withColumn("reward", C.distortion_reward(F.col("distortion"), F.lit("three short words"), 0.01))


def distortion_shifted(spark, d):
    """As `distortion`, but each list is scored against that of the next vectors: x and z have another context and differ."""
    t = _log_probs(spark, d)
    both = t.join(t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("top").alias("z")), "vec_id")
    group = F.floor(F.col("vec_id") / 10).cast("long").alias("g")
    rows = both.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.map_entries("top").alias("x"), F.map_entries("z").alias("z")))).alias("l"))
    lists = rows.select("g", F.transform("l", lambda r: F.map_from_entries(r["x"])).alias("x"), F.transform("l", lambda r: F.map_from_entries(r["z"])).alias("z"))
    pos = C.kl_per_position(*C.completion_positions(F.col("x"), F.slice("z", 2, 100), F.lit(1), F.size("x"), F.lit(0)))
    out = lists.select("g", C.distortion(pos).alias("distortion"), F.size(pos).cast("long").alias("n_tokens"), F.coalesce(C.distortion_error(pos), F.lit("")).alias("error"))
    return out.withColumn("reward", C.distortion_reward(F.col("distortion"), F.lit("three short words"), 0.01))


def group_centred(spark, d):
    return C.centred(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", "mean_reward", "advantage")


def varied_groups(spark, d):
    r = table(spark, d, "run_records").distinct().groupBy("uid", "instance_id").agg(F.max(F.coalesce("is_correct", F.lit(0.0))).alias("reward"))
    return C.varied_groups(C.centred(r, "instance_id", "reward"), "instance_id").select("uid", "instance_id", "advantage")


def batch_rewards(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("batch"), "user_id", "value")
    return C.batch_rewards(e, "batch", "user_id", "value")


def datum_arrays(spark, d):
    t = _trajectories(spark, d, "task", "summary")
    words = F.filter(F.split(F.coalesce("summary", F.lit("")), " "), lambda w: w != "")
    tokens = F.transform(words, F.length)
    prompt = text.word_count(F.coalesce("task", F.lit(""))) + 1
    made = t.select("trajectory_id", C.datum(prompt, tokens, F.transform(tokens, lambda n: -n / F.lit(4.0)), F.lit(0.5)).alias("x"))
    show = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 100).cast("long").cast("string")), ",")
    return made.select("trajectory_id", F.size("x.target_tokens").cast("long").alias("n"), show("x.target_tokens").alias("targets"), show("x.logprobs").alias("log_probs"), show("x.advantages").alias("advantages"))


def loss_mask(spark, d):
    t = _trajectories(spark, d, "task", "summary")
    mask = C.loss_mask(text.word_count(F.coalesce("task", F.lit(""))), text.word_count(F.coalesce("summary", F.lit(""))), 120)
    return t.select("trajectory_id", F.array_join(F.transform(mask, lambda v: v.cast("string")), "").alias("mask"))


def batch_metrics(spark, d):
    t = _trajectories(spark, d, "steps", "summary")
    rows = t.select((F.length("trajectory_id") % 7).cast("long").alias("batch"), text.word_count(F.coalesce("summary", F.lit(""))).cast("long").alias("tokens"), F.coalesce(F.size("steps"), F.lit(0)).alias("steps"))
    return C.batch_metrics(rows, "batch", "tokens", "steps")


def _classes(spark, d):
    failed = F.col("l_returnflag") == "R"
    n = lambda c: F.sum(c.cast("long"))
    f2p = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(n(f2p & ~failed).alias("fs"), n(f2p & failed).alias("ff"), n(~f2p & ~failed).alias("ps"), n(~f2p & failed).alias("pf"))


def partial_score(spark, d):
    c = [F.col(x) for x in ("fs", "ff", "ps", "pf")]
    return _classes(spark, d).select("l_orderkey", C.partial_score(*c).alias("score"), C.partial_score(*c, empty_is_failure=True).alias("score_old"), C.resolved(F.col("ff"), F.col("pf")).alias("resolved"))


def test_report(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("test"), "l_linestatus", "l_returnflag")
    gold = li.select("k", "test", F.when(F.col("l_linestatus") == "F", "FAIL_TO_PASS").otherwise("PASS_TO_PASS").alias("kind"))
    seen = li.where("l_returnflag <> 'N'").select("k", "test", F.when(F.col("l_returnflag") == "A", "PASSED").otherwise("FAILED").alias("status"))
    out = C.test_report(gold, seen, "k", "test", "kind", "status")
    return out.select("k", "kind", F.array_join("success", ",").alias("success"), F.array_join("failure", ",").alias("failure"))


def text_functions(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(
        "doc_id", text.word_count(t).cast("long").alias("n_words"), F.length(text.strip(t)).cast("long").alias("stripped_chars"), F.length(text.truncate_middle(t, 1000)).cast("long").alias("truncated_chars"),
        text.is_blank(t).alias("blank"), text.basename(F.coalesce("repo", F.lit(""))).alias("base"), text.remove_prefix(F.coalesce("source", F.lit("")), "issue_").alias("no_prefix"),
        text.section(t, "The ", ". ").alias("between"), text.section_by_find(t, "The ", ". ").alias("between_find"), text.matches_start(t, "The|A").alias("starts"),
        text.floor_div(F.col("doc_id") - 50, F.lit(7)).alias("quotient"), text.batch_label(F.col("doc_id") % 1000).alias("label"), text.step_label((F.col("doc_id") % 1000).cast("int"), F.col("doc_id") / 4).alias("step_label"),
        text.rstrip_slashes(F.concat(F.coalesce("repo", F.lit("")), F.lit("//"))).alias("no_slash"),
    )


def reversed_patches(spark, d):
    t = table(spark, d, "task_instances").where("patch IS NOT NULL").select("instance_id", "patch").distinct()
    return t.select("instance_id", diff.reversed_diff("patch").alias("reversed"))


def json_text(spark, d):
    t = table(spark, d, "agent_steps").select("run_id", "pos", F.explode("tool_calls").alias("c")).select("run_id", "pos", "c.arguments", F.coalesce("c.name", F.lit("")).alias("name")).distinct()
    return t.select("run_id", "pos", render.json_line("arguments").alias("line"), render.quoted("name").alias("quoted"))


QUERIES = {f.__name__: f for f in (
    entities, coverage, top_k, topk_kl, distortion, distortion_shifted, group_centred, varied_groups, batch_rewards, datum_arrays, loss_mask, batch_metrics, partial_score, test_report, text_functions, reversed_patches, json_text,
)}

_ONE = "WITH q AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY ingested_at) AS _n FROM trajectories) WHERE _n = 1)"
_ENTITIES = f"""{_ONE}, s AS (SELECT trajectory_id, unnest(list_concat(coalesce(steps, []), coalesce(continuation, []))) AS s FROM q), c AS (SELECT trajectory_id, unnest(s.tool_calls) AS c FROM s),
j AS (SELECT trajectory_id, unnest(json_keys(a)) AS key, a FROM (SELECT trajectory_id, CASE WHEN json_valid(c.arguments) AND json_type(c.arguments) = 'OBJECT' THEN c.arguments::json END AS a FROM c) WHERE a IS NOT NULL),
v AS (SELECT trajectory_id, a ->> ('$."' || key || '"') AS v FROM j WHERE json_type(a, '$."' || key || '"') = 'VARCHAR'),
e AS (SELECT trajectory_id, lower(s.name) AS entity FROM s WHERE coalesce(s.name, '') <> '' UNION SELECT trajectory_id, lower(coalesce(c.name, '')) FROM c WHERE c IS NOT NULL
 UNION SELECT trajectory_id, lower(list_extract(string_split(v, '/'), -1)) FROM v WHERE contains(v, '/') OR contains(v, '.'))"""
_TOP = """WITH x AS (SELECT vec_id, unnest(embedding)::double AS v, unnest(range(len(embedding))) AS i FROM embeddings), p AS (SELECT vec_id, lpad(i::varchar, 2, '0') AS token, v - ln(sum(exp(v)) OVER (PARTITION BY vec_id)) AS log_prob FROM x),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY log_prob DESC, token) AS r FROM p) WHERE r <= 20),
kl AS (SELECT a.vec_id, sum(exp(a.log_prob) * (a.log_prob - b.log_prob)) AS kl FROM t a JOIN t b ON b.vec_id = a.vec_id + 1 AND a.token = b.token GROUP BY a.vec_id),
k AS (SELECT a.vec_id, coalesce(kl, 0) AS kl FROM (SELECT DISTINCT vec_id FROM t) a JOIN (SELECT DISTINCT vec_id FROM t) b ON b.vec_id = a.vec_id + 1 LEFT JOIN kl ON kl.vec_id = a.vec_id)"""
_WS = "\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _wc(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '[{_WS}]+'), lambda w: w <> ''))"


_SPLIT = "list_filter(string_split(coalesce(summary, ''), ' '), lambda w: w <> '')"

SQL = {
    "entities": f"{_ENTITIES} SELECT trajectory_id, entity FROM e",
    "coverage": f"{_ENTITIES} SELECT q.trajectory_id, count(entity) AS n_entities, coalesce(avg(contains(lower(coalesce(summary, '')), entity)::int), 0.5) AS coverage FROM q LEFT JOIN e ON q.trajectory_id = e.trajectory_id GROUP BY q.trajectory_id",
    "top_k": f"{_TOP} SELECT vec_id, token, log_prob FROM t",
    "topk_kl": f"{_TOP} SELECT vec_id, kl FROM k",
    "distortion": f"""{_TOP}, o AS (SELECT vec_id, vec_id // 10 AS g, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS r, count(*) OVER (PARTITION BY vec_id // 10) AS n FROM (SELECT DISTINCT vec_id FROM t)),
g AS (SELECT g, n, sum(0) AS zero FROM o GROUP BY g, n) SELECT g, CASE WHEN n > 1 THEN 0::double END AS distortion, n - 1 AS n_tokens, CASE WHEN n > 1 THEN '' ELSE 'No completion tokens scored' END AS error, CASE WHEN n > 1 THEN -0.03::double ELSE 0::double END AS reward FROM g""",
    "distortion_shifted": f"""{_TOP}, o AS (SELECT vec_id, kl, vec_id // 10 AS g, row_number() OVER (PARTITION BY vec_id // 10 ORDER BY vec_id) AS r FROM k),
g AS (SELECT g, avg(kl) FILTER (r > 1) AS distortion, count(*) - 1 AS n_tokens FROM o GROUP BY g)
SELECT g, distortion, n_tokens, CASE WHEN n_tokens > 0 THEN '' ELSE 'No completion tokens scored' END AS error, coalesce(-distortion - 0.03::double, 0) AS reward FROM g""",
    "group_centred": "SELECT event_id, avg(value) OVER (PARTITION BY user_id) AS mean_reward, value - avg(value) OVER (PARTITION BY user_id) AS advantage FROM events",
    "varied_groups": "WITH r AS (SELECT uid, instance_id, max(coalesce(is_correct, 0)) AS reward FROM (SELECT DISTINCT * FROM run_records) GROUP BY uid, instance_id), a AS (SELECT uid, instance_id, reward - avg(reward) OVER (PARTITION BY instance_id) AS advantage FROM r) SELECT * FROM a QUALIFY max(abs(advantage)) OVER (PARTITION BY instance_id) > 0",
    "batch_rewards": "WITH m AS (SELECT user_id % 8 AS batch, user_id, coalesce(avg(value), 0) AS m FROM events GROUP BY ALL) SELECT batch, avg(m) AS mean_reward, max(m) AS max_reward, count(*) AS n_groups FROM m GROUP BY batch",
    "datum_arrays": f"""{_ONE}, x AS (SELECT trajectory_id, {_wc("coalesce(task, '')")} AS ob, list_transform({_SPLIT}, lambda w: length(w)) AS t FROM q)
SELECT trajectory_id, (ob + len(t))::bigint AS n, array_to_string(list_concat(list_transform(range(ob), lambda i: '0'), list_transform(t, lambda v: (v * 100)::varchar)), ',') AS targets,
array_to_string(list_concat(list_transform(range(ob), lambda i: '0'), list_transform(t, lambda v: (v * -25)::varchar)), ',') AS log_probs, array_to_string(list_concat(list_transform(range(ob), lambda i: '0'), list_transform(t, lambda v: '50')), ',') AS advantages FROM x""",
    "loss_mask": f"""{_ONE}, x AS (SELECT trajectory_id, {_wc("coalesce(task, '')")} AS a, {_wc("coalesce(summary, '')")} AS b FROM q) SELECT trajectory_id, left(repeat('0', a) || repeat('1', b), 120) AS mask FROM x""",
    "batch_metrics": f"""{_ONE} SELECT (length(trajectory_id) % 7)::bigint AS batch, count(*) AS n_rows, sum({_wc("coalesce(summary, '')")})::bigint AS n_tokens, avg(coalesce(len(steps), 0)) AS mean_steps FROM q GROUP BY batch""",
    "partial_score": """WITH c AS (SELECT l_orderkey, sum((l_linestatus = 'F' AND l_returnflag <> 'R')::int) AS fs, sum((l_linestatus = 'F' AND l_returnflag = 'R')::int) AS ff, sum((l_linestatus <> 'F' AND l_returnflag <> 'R')::int) AS ps, sum((l_linestatus <> 'F' AND l_returnflag = 'R')::int) AS pf FROM lineitem GROUP BY l_orderkey),
s AS (SELECT l_orderkey, ff, pf, CASE WHEN fs + ff > 0 THEN fs::double / (fs + ff) END AS a, CASE WHEN ps + pf > 0 THEN ps::double / (ps + pf) END AS b FROM c)
SELECT l_orderkey, (coalesce(a, 1) + coalesce(b, 1)) / 2 AS score, coalesce((a + b) / 2, 0) AS score_old, ff = 0 AND pf = 0 AS resolved FROM s""",
    "test_report": "SELECT l_orderkey AS k, CASE WHEN l_linestatus = 'F' THEN 'FAIL_TO_PASS' ELSE 'PASS_TO_PASS' END AS kind, coalesce(string_agg(DISTINCT concat_ws('-', l_linenumber, l_partkey, l_suppkey), ',' ORDER BY concat_ws('-', l_linenumber, l_partkey, l_suppkey)) FILTER (l_returnflag = 'A'), '') AS success, coalesce(string_agg(DISTINCT concat_ws('-', l_linenumber, l_partkey, l_suppkey), ',' ORDER BY concat_ws('-', l_linenumber, l_partkey, l_suppkey)) FILTER (l_returnflag <> 'A'), '') AS failure FROM lineitem GROUP BY ALL",
    "text_functions": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(repo, '') AS repo, coalesce(source, '') AS source FROM documents), p AS (SELECT *, strpos(t, 'The ') AS a, strpos(t, '. ') AS b, length(t) AS n FROM d),
f AS (SELECT *, CASE WHEN a = 0 THEN greatest(n - 1, 0) ELSE a - 1 END AS fa, CASE WHEN b = 0 THEN greatest(n - 1, 0) ELSE b - 1 END AS fb FROM p)
SELECT doc_id, {_wc('t')}::bigint AS n_words, length(regexp_replace(t, '^[{_WS}]+|[{_WS}]+$', '', 'g'))::bigint AS stripped_chars, (CASE WHEN n > 1000 THEN 1000 + length('x...[truncated]...') + 0 ELSE n END)::bigint AS truncated_chars,
regexp_replace(t, '[{_WS}]+', '', 'g') = '' AS blank, list_extract(string_split(repo, '/'), -1) AS base, CASE WHEN starts_with(source, 'issue_') THEN substr(source, 7) ELSE source END AS no_prefix,
CASE WHEN a = 0 OR b = 0 THEN t ELSE substr(t, a + 4, greatest(b - a - 4, 0)) END AS between, substr(substr(t, fa + 1, greatest(fb - fa, 0)), 5) AS between_find, starts_with(t, 'The') OR starts_with(t, 'A') AS starts,
floor((doc_id - 50)::double / 7)::bigint AS quotient, lpad((doc_id % 1000)::varchar, 6, '0') AS label, printf('Step %3d ($%.2f)', (doc_id % 1000)::int, doc_id / 4) AS step_label, repo AS no_slash FROM f""",
}
