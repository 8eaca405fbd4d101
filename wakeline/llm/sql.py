"""SQL for the queries that it can express over whole tables."""

_WS = "\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"



def _outer(x: str) -> str:
    """x without white space around it."""
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_HANDLE = _outer(f"regexp_replace({_outer('lower(v)')}, '^@', '')")

SQL: dict[str, str] = {
    "p3_found": f"""WITH RECURSIVE t AS (SELECT DISTINCT trajectory_id AS id, CASE WHEN json_valid(metadata) THEN TRY_CAST(metadata AS JSON) END AS j FROM trajectories),
x AS (SELECT t.id, n.key, n.path, n.fullkey, n.value ->> '$' AS v FROM t, json_tree(t.j) n WHERE n.type = 'VARCHAR'),
h AS (SELECT id, {_HANDLE} AS h FROM x WHERE key IN ('author', 'handle') OR regexp_matches(path, '^[$][.]author$') AND fullkey LIKE '%]'),
k AS (SELECT id, 'r:' || CASE WHEN regexp_matches(lower(id), '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') THEN lower(left(id, 36)) ELSE id END AS key FROM t
 UNION SELECT id, 'a:' || h FROM h WHERE h NOT IN ('unknown', 'anonymous', 'n/a', '-', '') UNION SELECT id, 'i:' || {_outer("v")} FROM x WHERE key = 'instance_id' AND {_outer("v")} <> ''),
e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b ON a.key = b.key), g(x, y) AS (SELECT x, y FROM e UNION SELECT g.x, e.y FROM g JOIN e ON g.y = e.x)
SELECT x AS trajectory_id, min(y) AS group_id FROM g GROUP BY x""",
    "p5_found": f"""WITH c AS (SELECT DISTINCT run_id, pos, content FROM agent_steps WHERE length(content) > 4000),
t AS (SELECT trajectory_id, any_value(steps) AS steps FROM trajectories GROUP BY trajectory_id), i AS (SELECT trajectory_id, steps, unnest(range(len(steps))) AS i FROM t),
s AS (SELECT trajectory_id, i, steps[i + 1].role AS role, coalesce(length(steps[i + 1].content), 0) AS n FROM i), u AS (SELECT *, sum((role = 'assistant')::int) OVER (PARTITION BY trajectory_id ORDER BY i) AS turn FROM s),
g AS (SELECT trajectory_id, turn, sum(n) AS n FROM u GROUP BY ALL)
SELECT 'content' AS item_kind, run_id AS item_key, pos AS item_pos, (list_max(list_transform(regexp_split_to_array(content, '[{_WS}。！？]'), lambda x: length(x))) > 4000)::int AS forced FROM c
UNION ALL SELECT 'steps', trajectory_id, -1, max((turn > 0 AND n > 12000)::int)::int FROM g GROUP BY trajectory_id HAVING sum(n) > 12000""",
}
