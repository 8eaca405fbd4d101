import pytest
from pyspark.sql import functions as F

from wakeline import api, config
from wakeline.operators import sequence as S

STEP = "run_id string, pos int, role string, content string, tool_calls array<struct<name:string,arguments:string,id:string>>, tool_call_id string, name string, arrived int"
ROWS = [
    ("a", 0, "user", "Fix it", [], None, None, 1), ("a", 1, "assistant", "look", [("read", '{"path": "x/y.py"}', "1")], None, None, 1), ("a", 2, "tool", "text", [], "1", "read", 1),
    ("a", 2, "tool", "text", [], "1", "read", 2), ("a", 3, "assistant", "done", [("sub", "{}", "2")], None, None, 1), ("b", 0, "tool", None, None, None, None, 1), (None, 0, "assistant", "x", None, None, None, 1),
]


def test_chain(spark):
    t = api.Trajectories(spark.createDataFrame(ROWS, STEP)).once("arrived")
    assert t.describe().where("run_id = 'a'").first().n_messages == 4
    assert {(r.run_id, r.event) for r in t.events().collect()} == {("a", 'look\nTool(read): {"path": "x/y.py"}\nEnvironment:\ntext'), ("b", "\nEnvironment:\n")}
    assert {(r.run_id, r.ok, r.bad_pos) for r in t.validate().collect()} == {("a", False, 3), ("b", True, None), (None, True, None)}
    assert {r.pos for r in t.where("run_id = 'a'").last_turns(1).messages.collect()} == {0, 1, 2, 3}
    assert {tuple(r) for r in t.entities().where("run_id = 'a'").collect()} == {("a", "read"), ("a", "y.py"), ("a", "sub")}
    assert "<TASK>\nFix it\n</TASK>" in t.prompts().where("run_id = 'a'").first().prompt
    assert "_block" not in t.chunks().columns


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_give_the_same(spark, monkeypatch, block):
    import random

    rnd = random.Random(3)
    rows = [(t, p, rnd.choice(["assistant", "tool", "user", "system", None]), f"c{p}", [("n", f"a{p}", f"i{p}")] if rnd.random() < 0.5 else [], f"i{p - 1}", None, 1) for t in "abcd" for p in rnd.sample(range(60), 30)]
    df = spark.createDataFrame(rows, STEP)

    def everything():
        return [
            sorted(map(repr, x.collect()))
            for x in (S.chunk(df).drop("tool_calls"), S.last_turns(df, 3), S.events(df, "content", "tool_calls", F.col("content")), S.events(df, "content", "tool_calls", F.col("content"), masked=True), S.relabel(df, 20), S.validate(df, "tool_calls", "tool_call_id"), S.branches(df, 2), S.prefix_at(df, 2), S.middle(df, 2, 2))
        ]

    want = everything()
    monkeypatch.setattr(S, "BLOCK", block)
    assert everything() == want


def test_registered_functions(spark):
    api.register_functions(spark)
    assert spark.sql("SELECT json_line('{\"a\":1}') AS x, reverse_diff('@@ -1 +1 @@\\n-a\\n+b') AS d").first().x == '{"a": 1}'
    assert api.reward("distortion") is api.REWARDS["distortion"]
    with pytest.raises(KeyError, match="unknown reward"):
        api.reward("none")


def test_config(monkeypatch):
    assert config.merge({"a": {"b": 1, "c": 2}}, {"a": {"b": config.UNSET, "c": 3}, "d": 4}, config.parse_assignments(["a.e=5"])) == {"a": {"b": 1, "c": 3, "e": "5"}, "d": 4}
    monkeypatch.setenv("CACHE_DIR", "/x")
    assert config.from_environment(CACHE_DIR="", TAG="t") == {"CACHE_DIR": "/x", "TAG": "t"}
