import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline.llm import pieces as P
from wakeline.llm import runs as R

STEP = "run_id string, pos int, role string, content string, tool_calls array<struct<name:string,arguments:string,id:string>>, happened_at timestamp, arrived_at timestamp, entity string, part int"
T0 = datetime(2031, 1, 1)


def stretches(keys):
    out, i = [], 0
    while i < len(keys):
        j = i
        while j + 1 < len(keys) and keys[j + 1][1] == keys[i][1]:
            j += 1
        if j > i:
            out.append((keys[i][0], keys[j][0], j - i + 1))
        i = j + 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 16])
def test_runs_against_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    rows, want = [], set()
    for e in ("hot", "b", "c", "d"):
        own = sorted(rnd.sample(range(120), 90 if e == "hot" else rnd.randint(1, 30)))
        keys = [(p, rnd.choice("ab")) for p in own]
        want |= {(e, *s) for s in stretches(keys)}
        rows += [(e, p, k, T0 + timedelta(seconds=p), 1) for p, k in keys] + [(e, p, "late", T0, 2) for p, _ in rnd.sample(keys, min(3, len(keys)))]
    rows += [(None, 1, "a", T0, 1), ("b", None, "a", T0, 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "e string, p int, k string, t timestamp, arr int").withColumn("arr", F.timestamp_seconds("arr"))
    got = R.runs(df, "e", "p", F.col("k"), "t", "arr", chunk=chunk).collect()
    assert {(r.entity, r.first_pos, r.last_pos, r.n) for r in got} == want
    assert all(r.duration_s == r.last_pos - r.first_pos for r in got)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ('{"command": "ls -la  x"}', '{"command":"LS -la\\tx\\n"}', True),
        ('{"a": 1, "b": {"c": 2, "d": 3}}', '{"b": {"d": 3, "c": 2}, "a": 1}', True),
        ('{"command": "find . -name \'x*\'"}', '{"command": "find . -name \\"x*\\""}', True),
        ('{"p": "x", "request_id": "2f0daddf-eac5-4429-a732-17e24fd4af53"}', '{"p": "x", "request_id": "a7f00f75-aa2d-469b-a52b-9f47d5d84e28"}', True),
        ('{"command": "echo \'2031-04-04T05:00:45Z\' && make"}', '{"command": "echo \'2031-03-10T13:06:25Z\' && make"}', True),
        ('{"command": "make x  # attempt 1"}', '{"command": "make x  # attempt 2"}', True),
        ('{"command": "RETRY=1 make"}', '{"command": "RETRY=2 make"}', True),
        ('{"command": "make | tee /tmp/tmp06d004d2/out.txt"}', '{"command": "make | tee /tmp/tmpf4625952/out.txt"}', True),
        ('{"command": "make > logs/run_20310414_032317.txt"}', '{"command": "make > logs/run_20310710_213742.txt"}', True),
        ('{"command": "make --nonce 1933356647810"}', '{"command": "make --nonce 1937077513710"}', True),
        (None, "{}", True),
        ('{"command": "sed -n \'32,111p\' a"}', '{"command": "sed -n \'112,191p\' a"}', False),
        ('{"path": "a", "start_line": 1}', '{"path": "a", "start_line": 101}', False),
        ('{"path": "a.py"}', '{"path": "b.py"}', False),
        ('{"command": "pytest t.py::test_a"}', '{"command": "pytest t.py::test_b"}', False),
        ('{"a": 1', '{"a": 2', False),
    ],
)
def test_keys_of_calls(spark, a, b, same):
    rows = [("r", i, "assistant", f"text {i}", [("f", x, f"id{i}")], T0, T0, "x", 1) for i, x in enumerate((a, b))]
    assert (R.step_runs(spark.createDataFrame(rows, STEP)).count() == 1) == same


def test_steps_nulls_and_clashing_names(spark):
    rows = [
        ("r", 0, "assistant", "Waiting (10s elapsed).", None, T0, T0, "e", 1), ("r", 1, "tool", "x", None, None, T0, "e", 1), ("r", 2, "assistant", "waiting  (12s elapsed).", [], T0 + timedelta(seconds=5), T0, "e", 1),
        ("r", 3, "assistant", "still polling, check 4 of 60", [], None, T0, "e", 1), ("r", 4, "assistant", "Still polling, check 9 of 60", [None], None, T0, "e", 1),
        ("q", 0, "assistant", None, [], None, T0, None, 2), ("q", 1, "assistant", "", None, None, T0, None, 2), ("q", 2, "assistant", "z" * 100_000, None, None, T0, None, 2), ("q", 3, "assistant", "z" * 100_000, None, None, T0, None, 2),
        ("q", 4, "assistant", "read lines 1 to 100", None, None, T0, None, 2), ("q", 5, "assistant", "read lines 101 to 200", None, None, T0, None, 2),
    ]
    got = {(r.run_id, r.first_pos, r.last_pos, r.n, r.duration_s) for r in R.step_runs(spark.createDataFrame(rows, STEP)).collect()}
    assert got == {("r", 0, 2, 2, 5.0), ("r", 3, 4, 2, None), ("q", 0, 1, 2, None), ("q", 2, 3, 2, None)}
    assert R.step_runs(spark.createDataFrame([], STEP)).count() == 0


def check_spans(text, limit, overlap):
    got = P.spans(text, limit, overlap)
    assert got[0][0] == 0
    assert got[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in got)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert a < c <= b < d
        assert c >= b - overlap
    return got


def test_spans_cover_the_text():
    rnd = random.Random(5)
    for _ in range(400):
        text = "".join(rnd.choice("aaab \n.。") if rnd.random() < 0.5 else "x" for _ in range(rnd.randint(0, 900)))
        check_spans(text, rnd.randint(40, 120), rnd.randint(0, 39))
        check_spans("x" * rnd.randint(0, 300) + text, 50, 10)
    with pytest.raises(ValueError, match="overlap"):
        P.spans("x", 10, 10)


def test_topic_boundary_is_chosen():
    a, b = "the cat sat on a warm mat near cats. ", "stock prices fell as markets traded bonds. "
    text = a * 30 + b * 30
    cut = P.spans(text, len(a) * 30 + 300, 50)[0][1]
    assert abs(cut - len(a) * 30) <= len(b)


def test_no_boundary_is_forced():
    assert [k for _, _, k in check_spans("x" * 250, 100, 10)] == ["forced", "forced", "end"]
    assert "forced" not in {k for _, _, k in check_spans("x" * 99 + " " + "y" * 98 + " z", 100, 20)}


def test_step_spans():
    rnd = random.Random(6)
    for _ in range(500):
        n = rnd.randint(0, 14)
        roles = [rnd.choice(["assistant", "tool", "user", None]) for _ in range(n)]
        contents = [None if rnd.random() < 0.1 else "ab. " * rnd.randint(0, 20) for _ in range(n)]
        got, seen = P.step_spans(roles, contents, 60, 5), set()
        starts = {a for a, _ in P.turns(roles)} | {n}
        for a, b, x, y, how in got:
            seen |= set(range(a, b))
            assert (sum(len(c or "") for c in contents[a:b]) if x is None else y - x) <= 60
            assert how == "forced" or a in starts and b in starts
        assert seen == set(range(n))


def test_turn_overlap():
    roles, contents = ["assistant", "tool"] * 4, ["aaaa", "bbbb"] * 4
    got = P.step_spans(roles, contents, 20, 0)
    assert [(a, b) for a, b, *_ in got] == [(0, 4), (2, 6), (4, 8)]


def test_pieces(spark):
    long = "word " * 900 + "x" * 4001 + "。" + "字" * 3000
    steps = [("r", 1, long, "n"), ("r", 1, long, "n"), ("r", 2, "short", None), ("r", 3, None, "n"), (None, None, "y " * 3000, "n"), ("r", 4, "a" * 4000, "n"), ("r", 5, "字。" * 2100, "n")]
    a = spark.createDataFrame(steps, "run_id string, pos int, content string, item_key string")
    kind = "trajectory_id string, steps array<struct<role:string,content:string>>, k string"
    t = spark.createDataFrame([("t", [("user", "u" * 13000), ("assistant", "a" * 100)], "k"), ("t", [("user", "u" * 13000), ("assistant", "a" * 100)], "k"), ("s", [("assistant", "w " * 3500), None, ("assistant", None), ("tool", "v " * 3500)], "k"), ("f", [("assistant", "w " * 3500), ("tool", "v " * 3500)], "k"), ("n", None, "k")], kind)
    rows = P.pieces(a, t).collect()
    flags = {(r.item_kind, r.item_key, r.item_pos): r.forced for r in rows}
    assert flags == {("content", "r", 1): 1, ("content", None, None): 0, ("content", "r", 5): 0, ("steps", "t", -1): 0, ("steps", "s", -1): 0, ("steps", "f", -1): 1}
    one = sorted((r for r in rows if r.item_key == "r" and r.item_pos == 1), key=lambda r: r.piece_no)
    assert [r.piece_no for r in one] == list(range(len(one)))
    assert all(r.text == long[r.first : r.until] and r.n_chars == len(r.text) <= 4000 for r in one)
    assert all(re.search(r"\S", r.text) for r in rows)
    assert P.pieces(a.limit(0), t.limit(0)).count() == 0


def test_forced_cuts_are_those_of_unbroken_stretches():
    rnd = random.Random(7)
    for _ in range(1500):
        text = "".join(rnd.choice(["x" * rnd.randint(1, 60), " ", "\n", "  ", "。", "y. ", "\n\n", "\t"]) for _ in range(rnd.randint(1, 60)))
        limit = rnd.randint(30, 60)
        got = check_spans(text, limit, rnd.randint(0, limit - 1))
        assert any(k == "forced" for _, _, k in got) == (re.search(rf"[^\s。！？]{{{limit + 1},}}", text) is not None)


def test_depth_is_up_to_the_nearest_peaks(monkeypatch):
    assert P._peaks([0.1, 0.9, 0.5, 0.6, 0.2, 0.3]) == [0.1, 0.9, 0.9, 0.6, 0.6, 0.3]
    rnd = random.Random(8)
    units = [" ".join(rnd.choice("alpha beta gamma delta eps zeta".split()) for _ in range(rnd.randint(0, 8))) for _ in range(60)]
    whole = P.similarities(units)
    for i in (1, 9, 30, 59):  # by words counted one by one
        a, b = (P.Counter(" ".join(u).split()) for u in (units[max(0, i - P.BLOCK) : i], units[i : i + P.BLOCK]))
        assert whole[i - 1] == pytest.approx(P._cosine(a, b), abs=1e-6)
    for cells in (1, 300):
        monkeypatch.setattr(P, "CELLS", cells)
        assert P.similarities(units) == pytest.approx(whole, abs=1e-6)


def test_later_deliveries_do_not_count(spark):
    old, new = "first. " * 800, "second. " * 900
    a = spark.createDataFrame([("r", 1, new, 9), ("r", 1, old, 5), ("r", 1, new, 7), ("r", 2, old, 9), (None, None, old, 1), (None, None, old, 1)], "run_id string, pos int, content string, t int").withColumn("arrived_at", F.timestamp_seconds("t"))
    t = spark.createDataFrame([], "trajectory_id string, steps array<struct<role:string,content:string>>")
    rows = P.pieces(a, t).collect()
    assert {(r.item_key, r.item_pos) for r in rows} == {("r", 1), ("r", 2), (None, None)}
    assert len(rows) == 3 * len(P.spans(old))
    assert all("second" not in r.text for r in rows)
