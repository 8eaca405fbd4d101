"""Queries of the sequence operators over agent_steps and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import render
from wakeline.functions.text import truncate_middle
from wakeline.operators import sequence as S
from wakeline.plans.tables import table

#: Each (run_id, pos) once, as `sequence.once`.
ONCE = "WITH s AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, pos ORDER BY arrived_at) AS _n FROM agent_steps) WHERE _n = 1)"
TB = "coalesce(sum((role = 'tool')::int) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
CHUNK = "coalesce(sum((role = 'assistant')::int) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int"


def steps(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return S.once(table(spark, d, "agent_steps").select("run_id", "pos", "role", "arrived_at", *cols), "arrived_at")


def chunk_by_assistant(spark, d):
    return S.chunk(steps(spark, d)).select("run_id", "pos", "chunk_id")


def last_turns(spark, d):
    return S.last_turns(steps(spark, d), 2).select("run_id", "pos", "role")


def _output():
    return truncate_middle(F.coalesce("content", F.lit("")))


def event_pairs(spark, d):
    return S.events(steps(spark, d, "content", "tool_calls"), "content", "tool_calls", _output())


def event_pairs_masked(spark, d):
    return S.events(steps(spark, d, "content", "tool_calls"), "content", "tool_calls", _output(), masked=True)


def relabel_roles(spark, d):
    rows = steps(spark, d)
    as_chat = rows.withColumn("role", F.when(F.col("role") == "tool", "user").otherwise(F.col("role")))
    return S.relabel(as_chat, cut=6).select("run_id", "pos", "side", "new_role", "tool_name")


def validate_responses(spark, d):
    out = S.validate(steps(spark, d, "tool_calls", "tool_call_id"), "tool_calls", "tool_call_id")
    return out.withColumn("missing_ids", F.array_join("missing_ids", ","))


def branch_points(spark, d):
    return S.branches(steps(spark, d), n_rollouts=2)


def branch_points_sampled(spark, d):
    return S.branches(steps(spark, d), n_rollouts=1, max_points=3, sample_limit=40)


def prefix_at_step(spark, d):
    return S.prefix_at(steps(spark, d), 2).select("run_id", "pos", "role")


def cut_sides(spark, d):
    before, after = S.cut_at(steps(spark, d), 7)
    side = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).withColumn("side", F.lit(name))
    return side(before, "prefix").unionByName(side(after, "continuation"))


def middle_range(spark, d):
    return S.middle(steps(spark, d), 2, 3).select("run_id", "pos")


def z_context(spark, d):
    summaries = table(spark, d, "run_records").groupBy(F.col("uid").alias("run_id")).agg(F.max(F.coalesce("submission", F.lit(""))).alias("summary"))
    return S.z_context(steps(spark, d, "content"), summaries, "content")


def x_context(spark, d):
    return S.x_context(steps(spark, d, "content")).select("run_id", "pos", "role", "content")


def first_task(spark, d):
    return S.task_of(steps(spark, d, "content"), "content")


def history_shape(spark, d):
    return S.describe(steps(spark, d, "content"), "content")


def _trajectories(spark, d, *cols):
    return table(spark, d, "trajectories").select("trajectory_id", *cols).dropDuplicates(["trajectory_id"])


def with_prefix(spark, d):
    out = S.with_prefix(_trajectories(spark, d, "steps", "continuation"), F.lit(-2))
    return out.select("trajectory_id", F.size("steps").alias("n_steps"), F.size("continuation").alias("n_continuation"), F.coalesce(F.try_element_at("continuation", F.lit(1))["content"], F.lit("")).alias("first_content"))


def nested_to_long(spark, d):
    return S.from_nested(_trajectories(spark, d, "steps"), "trajectory_id", "steps").select("trajectory_id", "pos", "role", F.length("content").alias("n_chars"))


def continuation_delta(spark, d):
    t = _trajectories(spark, d, "task", "summary").withColumn("full", F.concat(F.coalesce("task", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit(""))))
    return t.select("trajectory_id", S.continuation_delta(F.col("full"), F.coalesce("task", F.lit(""))).alias("delta"))


def trajectory_text(spark, d):
    return render.trajectory_text(_trajectories(spark, d, "task", "steps")).select("trajectory_id", "text")


def summary_conversation(spark, d):
    t = _trajectories(spark, d, "task", "summary").select("trajectory_id", F.posexplode(render.conversation(F.coalesce("task", F.lit("")), F.coalesce("summary", F.lit("")))).alias("turn", "m"))
    return t.select("trajectory_id", "turn", "m.role", "m.content")


def steps_to_messages(spark, d):
    t = _trajectories(spark, d, "task", "steps")
    steps = F.coalesce("steps", F.array().cast(t.schema["steps"].dataType))
    rows = t.select("trajectory_id", F.posexplode(render.messages(steps, F.coalesce("task", F.lit("")))).alias("turn", "m"))
    return rows.select("trajectory_id", "turn", "m.role", "m.content", F.array_join(F.transform("m.calls", lambda c: F.coalesce(c["name"], F.lit(""))), ",").alias("call_names"))


def summary_prompt(spark, d):
    pairs = S.events(steps(spark, d, "content", "tool_calls"), "content", "tool_calls", _output())
    listed = pairs.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("event_no", "event"))).alias("e"))
    tasks = S.task_of(steps(spark, d, "content"), "content")
    return listed.join(tasks, "run_id").select("run_id", render.summary_prompt(F.col("task"), F.transform("e", lambda x: x["event"])).alias("prompt"))


QUERIES = {f.__name__: f for f in (
    chunk_by_assistant, last_turns, event_pairs, event_pairs_masked, relabel_roles, validate_responses, branch_points, branch_points_sampled, prefix_at_step, cut_sides,
    middle_range, z_context, x_context, first_task, history_shape, with_prefix, nested_to_long, continuation_delta, trajectory_text, summary_conversation, steps_to_messages, summary_prompt,
)}

_OUT = "(CASE WHEN length(coalesce(content, '')) > 5000 THEN left(content, 2500) || chr(10) || '...[truncated]...' || right(content, 2500) ELSE coalesce(content, '') END)"
_EVENTS = f"""{ONCE}, b AS (SELECT run_id, pos, role, content, tool_calls, {TB} AS tb, sum((role = 'tool')::int) OVER (PARTITION BY run_id) AS t FROM s WHERE role IN ('assistant', 'tool')),
p AS (SELECT run_id, tb::int AS event_no, pos, CASE WHEN role = 'tool' THEN chr(10) || 'Environment:' || chr(10) || {_OUT}
  WHEN len(tool_calls) > 0 THEN coalesce(content, '') || chr(10) || 'Tool(' || coalesce(tool_calls[1].name, 'tool') || '): ' || coalesce(tool_calls[1].arguments, '{{}}') ELSE coalesce(content, '') END AS x FROM b WHERE tb < t),
e AS (SELECT run_id, event_no, string_agg(x, '' ORDER BY pos) AS event FROM p GROUP BY ALL)"""
_TASK = """t AS (SELECT run_id, coalesce(min_by(coalesce(content, ''), pos) FILTER (role = 'user'), '') AS x FROM s GROUP BY run_id)"""
_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_TASKED = "CASE WHEN regexp_matches(x, '(?s)<pr_description>(.*?)</pr_description>') THEN regexp_extract(x, '(?s)<pr_description>(.*?)</pr_description>', 1) ELSE x END"
_ENDS = f"""{ONCE}, c AS (SELECT run_id, {CHUNK} AS chunk_id, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n FROM s),
e0 AS (SELECT run_id, chunk_id, max(n) AS end_len FROM c GROUP BY ALL),
e AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS n_chunks, lead(end_len) OVER (PARTITION BY run_id ORDER BY chunk_id) AS next_len FROM e0)"""
_ONE = "WITH q AS (SELECT * EXCLUDE (_n) FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY ingested_at) AS _n FROM trajectories) WHERE _n = 1)"
_E = "'" + render.SYSTEM_PROMPT.replace("'", "''") + "'"
_TAIL = "'" + render.PROMPT_TAIL.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

SQL = {
    "chunk_by_assistant": f"{ONCE} SELECT run_id, pos, {CHUNK} AS chunk_id FROM s",
    "last_turns": f"{ONCE}, b AS (SELECT run_id, pos, role, {TB} AS tb, sum((role = 'tool')::int) OVER (PARTITION BY run_id) AS t FROM s) SELECT run_id, pos, role FROM b WHERE tb >= t - 2",
    "event_pairs": f"{_EVENTS} SELECT run_id, event_no, event FROM e",
    "event_pairs_masked": f"""{ONCE}, b AS (SELECT run_id, pos, role, content, {TB} AS tb, sum((role = 'tool')::int) OVER (PARTITION BY run_id) AS t,
  last_value(CASE WHEN role = 'assistant' THEN tool_calls[1].arguments END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM s WHERE role IN ('assistant', 'tool')),
p AS (SELECT run_id, tb::int AS event_no, pos, CASE WHEN role = 'tool' THEN chr(10) || 'Environment:' || chr(10) || '[ENVIRONMENT OUTPUT MASKED]' ELSE coalesce(content, '') || chr(10) || 'Tool: ' || a END AS x FROM b WHERE tb < t)
SELECT run_id, event_no, CASE WHEN count(*) = count(x) THEN string_agg(x, '' ORDER BY pos) END AS event FROM p GROUP BY run_id, event_no""",
    "relabel_roles": f"""{ONCE}, r AS (SELECT run_id, pos, CASE WHEN role = 'tool' THEN 'user' ELSE role END AS r0, CASE WHEN pos < 6 THEN 'prefix' ELSE 'continuation' END AS side FROM s),
l AS (SELECT run_id, pos, side, coalesce(r0, 'user') AS r1, lag(coalesce(r0, 'user')) OVER (PARTITION BY run_id, side ORDER BY pos) AS b FROM r WHERE coalesce(r0, 'user') <> 'system')
SELECT run_id, pos, side, CASE WHEN r1 = 'user' AND b = 'assistant' THEN 'tool' ELSE r1 END AS new_role, CASE WHEN r1 = 'user' AND b = 'assistant' THEN 'bash' ELSE '' END AS tool_name FROM l""",
    "validate_responses": f"""{ONCE}, g AS (SELECT *, sum((role <> 'tool')::int) OVER (PARTITION BY run_id ORDER BY pos) AS g FROM s),
call AS (SELECT run_id, g, pos, unnest(tool_calls).id AS id FROM g WHERE role = 'assistant'), got AS (SELECT run_id, g, tool_call_id AS id FROM g WHERE role = 'tool'),
m AS (SELECT DISTINCT run_id, pos, id FROM call WHERE id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM got WHERE got.run_id = call.run_id AND got.g = call.g AND got.id = call.id)),
f AS (SELECT run_id, min(pos) AS bad_pos FROM m GROUP BY run_id), l AS (SELECT m.run_id, any_value(bad_pos) AS bad_pos, string_agg(id, ',' ORDER BY id) AS missing_ids FROM m JOIN f ON m.run_id = f.run_id AND m.pos = f.bad_pos GROUP BY m.run_id)
SELECT r.run_id, l.run_id IS NULL AS ok, bad_pos, missing_ids FROM (SELECT DISTINCT run_id FROM s) r LEFT JOIN l ON r.run_id = l.run_id""",
    "branch_points": f"""{_ENDS}, p AS (SELECT * FROM e WHERE chunk_id >= 5 AND chunk_id < n_chunks - 5)
SELECT run_id, chunk_id, 'before_init' AS kind, 0 AS rollout, chunk_id AS start_index, (end_len - 1)::int AS n_messages FROM p
UNION ALL SELECT run_id, chunk_id, 'after', r::int, chunk_id + 1, (next_len - 1)::int FROM p, range(2) x(r) WHERE next_len IS NOT NULL""",
    "branch_points_sampled": f"""{_ENDS}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY md5(run_id || ':' || chunk_id), chunk_id) AS r FROM e WHERE chunk_id >= 5 AND chunk_id < 35)
SELECT run_id, chunk_id, 'before_init' AS kind, 0 AS rollout, chunk_id AS start_index, (end_len - 1)::int AS n_messages FROM p WHERE r <= 3
UNION ALL SELECT run_id, chunk_id, 'after', 0, chunk_id + 1, (next_len - 1)::int FROM p WHERE r <= 3 AND next_len IS NOT NULL""",
    "prefix_at_step": f"""{ONCE}, c AS (SELECT run_id, pos, role, {CHUNK} AS chunk_id FROM s), n AS (SELECT *, max(chunk_id) OVER (PARTITION BY run_id) + 1 AS n FROM c),
k AS (SELECT *, max(pos) OVER (PARTITION BY run_id) AS last FROM n WHERE chunk_id <= 2 AND n > 2) SELECT run_id, pos, role FROM k WHERE pos < last""",
    "cut_sides": f"{ONCE} SELECT run_id, count(*) AS n, min(pos) AS first_pos, CASE WHEN pos < 7 THEN 'prefix' ELSE 'continuation' END AS side FROM s GROUP BY run_id, side",
    "middle_range": f"{ONCE}, b AS (SELECT run_id, pos, row_number() OVER (PARTITION BY run_id ORDER BY pos) - 1 AS n, {TB} AS tb, sum((role = 'tool')::int) OVER (PARTITION BY run_id) AS t FROM s) SELECT run_id, pos FROM b WHERE n >= 2 AND tb < t - 3",
    "z_context": f"""{ONCE}, b AS (SELECT run_id, pos, role, content, row_number() OVER (PARTITION BY run_id ORDER BY pos) AS n, {TB} AS tb, sum((role = 'tool')::int) OVER (PARTITION BY run_id) AS t FROM s)
SELECT 0 AS part, run_id, pos, role, content FROM b WHERE n <= 4
UNION ALL SELECT 1, uid, 0, 'user', '<summary>' || chr(10) || max(coalesce(submission, '')) || chr(10) || '</summary>' FROM run_records GROUP BY uid
UNION ALL SELECT 2, run_id, pos, role, content FROM b WHERE tb >= t - 3""",
    "x_context": f"{ONCE} SELECT run_id, pos, role, content FROM s",
    "first_task": f"{ONCE}, {_TASK} SELECT run_id, {_TRIM.format(x=_TASKED)} AS task FROM t",
    "history_shape": f"""{ONCE}, c AS (SELECT *, {CHUNK} AS chunk_id FROM s) SELECT run_id, count(*) AS n_messages, (max(chunk_id) + 1)::bigint AS n_chunks, sum((role = 'tool')::int)::bigint AS n_turns,
sum(length(coalesce(content, '')) - length(replace(coalesce(content, ''), chr(10), '')) + 1)::bigint AS n_lines, sum(length(coalesce(content, '')))::bigint AS n_chars FROM c GROUP BY run_id""",
    "with_prefix": f"""{_ONE}, x AS (SELECT trajectory_id, coalesce(steps, []) AS a, coalesce(continuation, []) AS b FROM q), y AS (SELECT *, greatest(0, len(a) - 2) AS n FROM x)
SELECT trajectory_id, n::int AS n_steps, (len(a) - n + len(b))::int AS n_continuation, coalesce((CASE WHEN n < len(a) THEN a[n + 1] ELSE b[1] END).content, '') AS first_content FROM y""",
    "nested_to_long": f"{_ONE}, x AS (SELECT trajectory_id, steps, unnest(range(len(steps)))::int AS pos FROM q) SELECT trajectory_id, pos, steps[pos + 1].role AS role, length(steps[pos + 1].content)::int AS n_chars FROM x",
    "continuation_delta": f"{_ONE} SELECT trajectory_id, chr(10) || coalesce(summary, '') AS delta FROM q",
    "summary_conversation": f"{_ONE} SELECT trajectory_id, 0 AS turn, 'system' AS role, {_E} AS content FROM q UNION ALL SELECT trajectory_id, 1, 'user', coalesce(task, '') FROM q UNION ALL SELECT trajectory_id, 2, 'assistant', coalesce(summary, '') FROM q",
    "steps_to_messages": f"""{_ONE}, x AS (SELECT trajectory_id, steps, unnest(range(len(steps)))::int AS i FROM q), y AS (SELECT trajectory_id, i, steps[i + 1] AS s FROM x)
SELECT trajectory_id, 0 AS turn, 'system' AS role, {_E} AS content, '' AS call_names FROM q UNION ALL SELECT trajectory_id, 1, 'user', coalesce(task, ''), '' FROM q
UNION ALL SELECT trajectory_id, i + 2, s.role, coalesce(s.content, ''), CASE WHEN s.role = 'assistant' THEN coalesce(array_to_string(list_transform(s.tool_calls, lambda c: coalesce(c.name, '')), ','), '') ELSE '' END FROM y""",
    "summary_prompt": f"""{_EVENTS}, {_TASK}, k AS (SELECT run_id, {_TRIM.format(x=_TASKED)} AS task FROM t), j AS (SELECT run_id, string_agg(chr(10) || '<EVENT>' || chr(10) || event || chr(10) || '</EVENT>' || chr(10), '' ORDER BY event_no) AS es FROM e GROUP BY run_id)
SELECT j.run_id, 'Here are the past events so far.' || chr(10) || '<TASK>' || chr(10) || task || chr(10) || '</TASK>' || chr(10) || es || {_TAIL} AS prompt FROM j JOIN k ON j.run_id = k.run_id""",
}
