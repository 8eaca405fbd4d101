"""The sequence operators against list-based models on random lists."""

import random

import pytest
from pyspark.sql import functions as F

from wakeline.operators import sequence as S

ROLES = ["assistant", "tool", "user", "system", None]


@pytest.fixture(scope="module")
def lists():
    rnd = random.Random(7)
    return {f"t{i}": [rnd.choice(ROLES[: rnd.choice([2, 3, 5])]) for _ in range(rnd.randint(1, 25))] for i in range(120)}


@pytest.fixture(scope="module")
def long(spark, lists):
    rows = [(t, p, r, f"c{p}", [(f"n{p}", "{}", f"id{p}")] if r == "assistant" and p % 2 else [], f"id{p - 1}" if r == "tool" else None) for t, rs in lists.items() for p, r in enumerate(rs)]
    return spark.createDataFrame(rows, "run_id string, pos int, role string, content string, tool_calls array<struct<name:string,arguments:string,id:string>>, tool_call_id string").persist()


def by_traj(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r.run_id, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return {k: sorted(v) for k, v in out.items()}


def chunks(roles):
    out, now = [], 0
    for r in roles:
        out.append(now)
        now += r == "assistant"
    return out


def test_chunk(lists, long):
    got = by_traj(S.chunk(long), "pos", "chunk_id")
    assert got == {t: list(enumerate(chunks(rs))) for t, rs in lists.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_last_turns(lists, long, n):
    want = {}
    for t, rs in lists.items():
        tools = [p for p, r in enumerate(rs) if r == "tool"]
        start = len(rs) if n <= 0 else 0 if len(tools) <= n else tools[-n - 1] + 1
        if rs[start:]:
            want[t] = list(range(start, len(rs)))
    assert by_traj(S.last_turns(long, n), "pos") == want


def test_events(lists, long):
    want = {}
    for t, rs in lists.items():
        text, made = "", []
        for p, r in enumerate(rs):
            if r == "assistant":
                text += f"c{p}\nTool(n{p}): {{}}" if p % 2 else f"c{p}"
            elif r == "tool":
                made.append(text + f"\nEnvironment:\nc{p}")
                text = ""
        if made:
            want[t] = list(enumerate(made))
    assert by_traj(S.events(long, "content", "tool_calls", F.col("content")), "event_no", "event") == want


@pytest.mark.parametrize("cut", [None, 4])
def test_relabel(lists, long, cut):
    want = {}
    for t, rs in lists.items():
        rows = []
        for part in ([range(len(rs))] if cut is None else [range(min(cut, len(rs))), range(min(cut, len(rs)), len(rs))]):
            before = None
            for p in part:
                r = rs[p] or "user"
                if r == "system":
                    continue
                rows.append((p, "tool" if r == "user" and before == "assistant" else r))
                before = r
        if rows:
            want[t] = sorted(rows)
    assert by_traj(S.relabel(long, cut), "pos", "new_role") == want


def test_validate(lists, long):
    got = {r.run_id: (r.ok, r.bad_pos) for r in S.validate(long, "tool_calls", "tool_call_id").collect()}
    for t, rs in lists.items():
        bad = None
        for p, r in enumerate(rs):
            if r == "assistant" and p % 2:
                answered, q = set(), p + 1
                while q < len(rs) and rs[q] == "tool":
                    answered.add(f"id{q - 1}")
                    q += 1
                if f"id{p}" not in answered:
                    bad = p
                    break
        assert got[t] == (bad is None, bad)


@pytest.mark.parametrize(("limit", "rollouts"), [(None, 2), (9, 1), (60, 0)])
def test_branches(lists, long, limit, rollouts):
    want = set()
    for t, rs in lists.items():
        c = chunks(rs)
        n = max(c) + 1
        end = {i: max(p for p in range(len(rs)) if c[p] == i) + 1 for i in range(n)}
        for i in range(5, min(n, (limit - 5) if limit is not None else n - 5)):
            want.add((t, i, "before_init", 0, i, end[i] - 1))
            if i + 1 < n:
                want |= {(t, i, "after", k, i + 1, end[i + 1] - 1) for k in range(rollouts)}
    assert {tuple(r) for r in S.branches(long, rollouts, None, limit).collect()} == want
    some = S.branches(long, 0, 1, limit).collect()
    assert len({r.run_id for r in some}) == len(some) == len({w[0] for w in want})


def test_prefix_and_middle(lists, long):
    want, mid = {}, {}
    for t, rs in lists.items():
        c = chunks(rs)
        kept = [p for p in range(len(rs)) if c[p] <= 2] if max(c) >= 2 else []
        if kept[:-1]:
            want[t] = kept[:-1]
        tools = [p for p, r in enumerate(rs) if r == "tool"]
        start = 0 if len(tools) <= 2 else tools[-3] + 1
        if range(2, start):
            mid[t] = list(range(2, start))
    assert by_traj(S.prefix_at(long, 2), "pos") == want
    assert by_traj(S.middle(long, 2, 2), "pos") == mid
    assert S.middle(long, 3, 0).count() == sum(max(0, len(r) - 3) for r in lists.values())


def test_z_context(spark, lists, long):
    summaries = spark.createDataFrame([("t0", "sum"), ("t1", None)], "run_id string, summary string")
    rows = S.z_context(long, summaries, "content", max_size=20, keep_first=4).where("run_id = 't0'").orderBy("part", "pos").collect()
    assert [r.pos for r in rows if r.part == 0] == list(range(min(4, len(lists["t0"]))))
    assert [r.content for r in rows if r.part == 1] == ["<summary>\nsum\n</summary>"]
    assert {r.pos for r in rows if r.part == 2} == {r.pos for r in S.last_turns(long, 3).where("run_id = 't0'").collect()}


@pytest.mark.parametrize("n", [-30, -2, 0, 3, 99])
def test_with_prefix(spark, n):
    t = spark.createDataFrame([("a", [("x",), ("y",), ("z",)], [("w",)]), ("b", None, None)], "id string, steps array<struct<content:string>>, continuation array<struct<content:string>>")
    a, b = S.with_prefix(t, F.lit(n)).orderBy("id").collect()
    s, c = list("xyz")[:n], list("xyz")[n:] + ["w"]
    assert [x.content for x in a.steps] == s
    assert [x.content for x in a.continuation] == c
    assert b.steps == b.continuation == []


def test_task_and_delta(spark):
    rows = [("a", 0, "system", "s"), ("a", 1, "user", "x <pr_description>\n t \n</pr_description> y"), ("a", 2, "user", "z"), ("b", 0, "user", "  q　"), ("c", 0, "tool", "t"), ("d", 0, "user", None)]
    got = {r.run_id: r.task for r in S.task_of(spark.createDataFrame(rows, "run_id string, pos int, role string, content string"), "content").collect()}
    assert got == {"a": "t", "b": "q", "c": "", "d": ""}
    d = spark.createDataFrame([("abcdef", "abc"), ("ab", "abc")], "f string, c string").select(S.continuation_delta(F.col("f"), F.col("c")).alias("d")).collect()
    assert [r.d for r in d] == ["def", ""]


def test_deliveries_count_once_and_empty(spark):
    rows = [("a", 0, "user", 2), ("a", 0, "user", 1), ("a", 1, "tool", None)]
    df = spark.createDataFrame(rows, "run_id string, pos int, role string, arrived int")
    assert S.once(df, "arrived").count() == 2
    empty = df.limit(0)
    assert S.chunk(empty).count() == S.last_turns(empty, 2).count() == S.branches(empty).count() == 0
