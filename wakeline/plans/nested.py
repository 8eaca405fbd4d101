"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators import nested
from wakeline.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = nested.arguments(nested.shred(table(spark, d, "trajectory_lines"), "raw_id", "line", nested.ARGUMENT_GROUPS), distinct=True)
    return found.select(F.col("record_key").alias("raw_id"), "side", "step_pos", "call_pos", "arg_path")  # raw_id is unique


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.records(nested.shred(table(spark, d, "trajectory_lines"), "raw_id", "line", ("",))).withColumnRenamed("record_key", "raw_id")


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    return nested.steps(nested.shred(table(spark, d, "trajectory_lines"), "raw_id", "line", tuple(f"{s}[]" for s in nested.SIDES))).withColumnRenamed("record_key", "raw_id")


def p1_calls(spark: SparkSession, d: str) -> DataFrame:
    return nested.calls(nested.shred(table(spark, d, "trajectory_lines"), "raw_id", "line", tuple(f"{s}[].tool_calls[]" for s in nested.SIDES))).withColumnRenamed("record_key", "raw_id")


def p1_further(spark: SparkSession, d: str) -> DataFrame:
    return nested.further(nested.shred(table(spark, d, "trajectory_lines"), "raw_id", "line", nested.FURTHER_GROUPS)).withColumnRenamed("record_key", "raw_id")


def p1_repeated(spark: SparkSession, d: str) -> DataFrame:
    return nested.repeated(nested.shred(table(spark, d, "trajectory_lines"), "raw_id", "line")).withColumnRenamed("record_key", "raw_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_steps, p1_calls, p1_further, p1_repeated)}

#: Elements of the step lists (e) and the tool calls in them (c) of every complete record.
_CALLS = """WITH l AS (SELECT raw_id, TRY_CAST(line AS JSON) AS j FROM trajectory_lines WHERE json_valid(line)),
r AS (SELECT raw_id, CASE WHEN json_type(j, '$.record') = 'OBJECT' AND json_type(j, '$.steps') IS NULL AND json_type(j, '$.continuation') IS NULL THEN j -> '$.record' ELSE j END AS r FROM l),
s AS (SELECT raw_id, side, r -> ('$.' || side) AS a FROM r, (VALUES ('steps'), ('continuation')) v(side) WHERE json_type(r, '$.' || side) = 'ARRAY'),
e AS (SELECT raw_id, side, a, unnest(range(json_array_length(a)::bigint))::int AS step_pos FROM s),
t AS (SELECT raw_id, side, step_pos, a -> ('$[' || step_pos || '].tool_calls') AS tc FROM e),
c0 AS (SELECT *, unnest(range(CASE json_type(tc) WHEN 'ARRAY' THEN json_array_length(tc)::bigint WHEN 'OBJECT' THEN 1 ELSE 0 END))::int AS call_pos FROM t WHERE tc IS NOT NULL),
c AS (SELECT raw_id, side, step_pos, call_pos, CASE json_type(tc) WHEN 'ARRAY' THEN tc -> ('$[' || call_pos || ']') ELSE tc END AS c FROM c0)"""
_ELEMENT = "a -> ('$[' || step_pos || ']')"


def _without(*keys: str) -> str:
    """That a leaf x of json_tree is under none of the keys of the root."""
    return f"NOT regexp_matches(x.fullkey, '^[$][.]({'|'.join(keys)})([.]|[[]|$)')"


_LEAF = "(x.type NOT IN ('OBJECT', 'ARRAY') OR x.value::varchar IN ('{}', '[]')) AND (x.fullkey <> '$' OR x.type <> 'OBJECT')"
_PATH = """regexp_replace(regexp_replace(x.fullkey, '^[$][.]?', ''), '"([^"]*)"', '\\1', 'g') AS path,
CASE x.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN x.type <> 'NULL' THEN x.value ->> '$' END AS value"""

SQL: dict[str, str] = {
    "p1_found": f"""{_CALLS},
a AS (SELECT raw_id, side, step_pos, call_pos, coalesce(CASE WHEN json_type(c, '$.function') = 'OBJECT' THEN c -> '$.function.arguments' END, c -> '$.arguments') AS a FROM c WHERE json_type(c) = 'OBJECT'),
v AS (SELECT raw_id, side, step_pos, call_pos, CASE WHEN json_type(a) IN ('OBJECT', 'ARRAY') THEN a WHEN json_type(a) = 'VARCHAR' AND json_valid(a ->> '$') THEN TRY_CAST(a ->> '$' AS JSON) END AS v FROM a),
w AS (SELECT raw_id, side, step_pos, call_pos, CASE WHEN json_type(v) IN ('OBJECT', 'ARRAY') THEN v ELSE '{{}}'::JSON END AS v FROM v)
SELECT DISTINCT raw_id, side, step_pos, call_pos, regexp_replace(x.fullkey, '^[$][.]?', '') AS arg_path FROM w, json_tree(w.v) x WHERE x.type NOT IN ('OBJECT', 'ARRAY') OR x.value::varchar IN ('{{}}', '[]')""",
    "p1_records": f"{_CALLS} SELECT raw_id, r ->> '$.trajectory_id' AS trajectory_id, r ->> '$.task' AS task, r ->> '$.summary' AS summary, r ->> '$.metadata' AS metadata FROM r WHERE json_type(r) = 'OBJECT'",
    "p1_steps": f"{_CALLS} SELECT raw_id, side, step_pos, {_ELEMENT} ->> '$.role' AS role, {_ELEMENT} ->> '$.content' AS content, {_ELEMENT} ->> '$.tool_call_id' AS tool_call_id, {_ELEMENT} ->> '$.name' AS name FROM e",
    "p1_calls": f"{_CALLS} SELECT raw_id, side, step_pos, call_pos, coalesce(c ->> '$.function.name', c ->> '$.name') AS name, c ->> '$.id' AS id FROM c WHERE json_type(c) = 'OBJECT'",
    "p1_further": f"""{_CALLS},
o AS (SELECT raw_id, side, step_pos, call_pos, c, json_type(c, '$.function') = 'OBJECT' IS TRUE AS f, json_type(c, '$.function.arguments') IS NOT NULL AS fa FROM c WHERE json_type(c) = 'OBJECT'),
y AS (SELECT e.raw_id, e.side, e.step_pos, x.*, CASE WHEN regexp_matches(x.fullkey, '^[$][.]tool_calls[[]') THEN regexp_extract(x.fullkey, '^[$][.]tool_calls[[]([0-9]+)', 1)::int WHEN regexp_matches(x.fullkey, '^[$][.]tool_calls([.]|$)') THEN 0 END AS n
 FROM (SELECT raw_id, side, step_pos, {_ELEMENT} AS v FROM e) e, json_tree(e.v) x)
SELECT l.raw_id, 'envelope' AS part, NULL::varchar AS side, NULL::int AS step_pos, NULL::int AS call_pos, {_PATH} FROM l, json_tree(l.j) x
 WHERE json_type(j, '$.record') = 'OBJECT' AND json_type(j, '$.steps') IS NULL AND json_type(j, '$.continuation') IS NULL AND {_without('record')} AND {_LEAF}
UNION ALL SELECT r.raw_id, 'record', NULL, NULL, NULL, {_PATH} FROM r, json_tree(r.r) x WHERE json_type(r.r) = 'OBJECT' AND {_without('trajectory_id', 'task', 'summary', 'metadata')} AND NOT regexp_matches(x.fullkey, '^[$][.](steps|continuation)[[]') AND {_LEAF}
UNION ALL SELECT x.raw_id, 'step', x.side, x.step_pos, NULL, {_PATH} FROM y x LEFT JOIN o ON o.raw_id = x.raw_id AND o.side = x.side AND o.step_pos = x.step_pos AND o.call_pos = x.n WHERE o.raw_id IS NULL AND {_without('role', 'content', 'tool_call_id', 'name')} AND {_LEAF}
UNION ALL SELECT o.raw_id, 'call', o.side, o.step_pos, o.call_pos, {_PATH} FROM o, json_tree(o.c) x
 WHERE CASE WHEN f THEN {_without('id', 'function[.]name', 'function[.]arguments')} AND (fa OR {_without('arguments')}) ELSE {_without('name', 'id', 'arguments')} END AND {_LEAF}""",
    "p1_repeated": f"""{_CALLS},
w AS (SELECT raw_id, '' AS above, r AS v FROM r WHERE json_type(r) = 'OBJECT' UNION ALL SELECT raw_id, '(envelope).', j FROM l WHERE json_type(j, '$.record') = 'OBJECT' AND json_type(j, '$.steps') IS NULL AND json_type(j, '$.continuation') IS NULL),
x AS (SELECT raw_id, above, regexp_replace(fullkey, '^([$][.](?:steps|continuation)[[][0-9]+[]][.]tool_calls)[.]', '\\1[0].') AS full_path, x.type, x.value FROM w, json_tree(w.v) x WHERE above = '' OR {_without('record')}),
k AS (SELECT raw_id, above || regexp_replace(regexp_replace(full_path, '^[$][.]?', ''), '"([^"]*)"', '\\1', 'g') AS k, CASE WHEN type <> 'NULL' THEN value ->> '$' END AS value FROM x WHERE contains(full_path, '[') AND (type NOT IN ('OBJECT', 'ARRAY') OR value::varchar IN ('{{}}', '[]'))
 AND NOT regexp_matches(full_path, '^[$][.](steps|continuation)[[][0-9]+[]][.]tool_calls[[][0-9]+[]][.](function[.])?arguments([.[]|$)')),
g AS (SELECT raw_id, regexp_extract(k, '^.*[]]') AS place, regexp_replace(regexp_extract(k, '[^]]*$'), '^[.]', '') AS path, value FROM k)
SELECT raw_id, regexp_replace(place, '[[][0-9]+[]]', '[]', 'g') AS grp, array_to_string(regexp_extract_all(place, '[[]([0-9]+)[]]', 1), ',') AS ordinals, path, value FROM g
 WHERE NOT regexp_matches(place, '^(steps|continuation)[[][0-9]+[]]([.]tool_calls[[][0-9]+[]])?$')""",
}
