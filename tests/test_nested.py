import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.operators import nested

JSON = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(JSON)
def test_both_parsers_agree(value):
    text = json.dumps(value)
    assert nested.parse(text) == nested._parse_deep(text) == (True, value)


@pytest.mark.parametrize("bad", ["[1,]", '{"a":}', "{,}", "[1 2]", "1 2", '{"a" 1}', "[}", "", " ", '"a', "nul", '{"a":1,}', "[,1]", '{"a":1]', "NaN", "[]]", None])
def test_incomplete_texts_are_no_json(bad):
    assert nested.parse(bad) == (False, None)
    assert bad is None or nested._parse_deep(bad) == (False, None)


@settings(max_examples=100, deadline=None)
@given(JSON)
def test_leaves_rebuild_the_value(value):
    def count(v):
        return sum(map(count, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) and v else 1

    assert len(list(nested.leaves(value))) == count(value)


def test_leaf_paths():
    assert [p for p, _ in nested.leaves({"a": {"b": [{"c": 1}, []], "d": {}}, "e": None})] == ["a.b[0].c", "a.b[1]", "a.d", "e"]
    assert [p for p, _ in nested.leaves([{"a": 1}])] == ["[0].a"]


def test_very_deep_text():
    ok, value = nested.parse("[" * 30000 + "1" + "]" * 30000)
    assert ok
    assert len(list(nested.leaves(value))) == 1


def record(calls, **more):
    return {"trajectory_id": "t", "steps": [None, {"role": "assistant", "content": "x", "tool_calls": calls}], **more}


@pytest.mark.parametrize(
    ("arguments", "paths"),
    [({"a": 1}, ["a"]), ('{"a": [1, {"b": null}]}', ["a[0]", "a[1].b"]), ("plain", [""]), ("5", [""]), (5, [""]), (None, [""]), ({}, [""]), ([], [""]), ("[]", [""]), ("", [""]), ("{broken", [""]), ('"{}"', [""])],
)
def test_shapes_of_arguments(arguments, paths):
    for call in ({"name": "f", "arguments": arguments}, {"type": "function", "function": {"name": "f", "arguments": arguments}}):
        rows = [(o, f) for g, o, f in nested.triples(json.dumps(record([call]))) if g.endswith("arguments")]
        assert [f["path"] for _, f in rows] == paths
        assert all(o[:2] == [1, 0] for o, _ in rows)


def test_envelope_lone_call_and_absent_arguments():
    text = json.dumps({"version": "2", "record": record({"name": "f"}, continuation=None)})
    groups = [(g, o) for g, o, _ in nested.triples(text)]
    assert ("steps[].tool_calls[]", [1, 0]) in groups
    assert ("steps[].tool_calls[].arguments", [1, 0, 0]) in groups
    assert ("steps[]", [0]) in groups


def test_tables_and_links(spark):
    lines = [(1, json.dumps(record([{"name": "f", "arguments": {"a": 1}, "id": "c"}, None]))), (2, "{"), (3, None), (None, json.dumps(record([]))), (1, json.dumps(record([{"name": "f", "arguments": {"a": 1}, "id": "c"}])))]
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in lines], "raw_id long, line string, grp string, record_key int")
    made = nested.shred(df, "raw_id", "line").persist()
    assert nested.records(made).count() == 3
    calls = {tuple(r) for r in nested.calls(made).collect()}
    assert calls == {(1, "steps", 1, 0, "f", "c")}
    steps = nested.steps(made)
    assert steps.count() == 6
    parents = {(r.record_key, r.side, r.step_pos) for r in steps.collect()}
    assert {(r.record_key, r.side, r.step_pos) for r in nested.arguments(made).collect()} <= parents
    wide = nested.pivot(made, "steps[].tool_calls[]", ["name", "pos"])
    assert wide.columns == ["record_key", "parent", "pos", "name", "_pos", "other"]
    assert {tuple(r.parent) for r in wide.collect()} == {(1,)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw_id long, line string")
    assert nested.arguments(nested.shred(df, "raw_id", "line")).count() == 0


def test_long_values_and_lone_surrogates(spark):
    text = '{"steps":[{"role":"assistant","tool_calls":[{"name":"f","arguments":{"\\ud800":"' + "x" * 300_000 + '"}}]}]}'
    rows = nested.arguments(nested.shred(spark.createDataFrame([("k", text)], "id string, line string"), "id", "line")).collect()
    assert [(r.arg_path, len(r.arg_value)) for r in rows] == [("?", 300_000)]


def test_no_leaf_of_a_record_is_lost():
    calls = [{"name": "f", "arguments": {}, "id": "c", "type": "x"}, None, 7, {"id": "d", "name": "outer", "arguments": 1, "function": {"name": "g", "arguments": {}, "strict": True}}, {"function": "h"}]
    step = {"role": "assistant", "tool_calls": calls, "usage": {"tokens": {"in": 1}}, "extra": [{"exit.code": None}]}
    text = json.dumps({"version": "2", "record": {"trajectory_id": "t", "task": "x", "steps": [step, "loose", {"tool_calls": "none"}], "continuation": {"a": []}, "cost": 1.5}})
    got = {(g, *o[:-1], f["path"]): (f["kind"], f["value"]) for g, o, f in nested.triples(text) if g.endswith(nested.FURTHER)}
    assert got == {
        ("envelope+", "version"): ("string", "2"), ("+", "cost"): ("number", "1.5"), ("+", "continuation.a"): ("list", "[]"),
        ("steps[]+", 0, "usage.tokens.in"): ("number", "1"), ("steps[]+", 0, "extra[0].exit.code"): ("null", None), ("steps[]+", 0, "tool_calls[1]"): ("null", None), ("steps[]+", 0, "tool_calls[2]"): ("number", "7"),
        ("steps[]+", 1, ""): ("string", "loose"), ("steps[]+", 2, "tool_calls"): ("string", "none"), ("steps[].tool_calls[]+", 0, 0, "type"): ("string", "x"),
        ("steps[].tool_calls[]+", 0, 3, "name"): ("string", "outer"), ("steps[].tool_calls[]+", 0, 3, "arguments"): ("number", "1"), ("steps[].tool_calls[]+", 0, 3, "function.strict"): ("boolean", "true"),
        ("steps[].tool_calls[]+", 0, 4, "function"): ("string", "h"),
    }


def test_further_table_names_parents(spark):
    text = json.dumps({"version": 2, "record": record([{"name": "f", "type": "x"}], cost=None)})
    made = nested.further(nested.shred(spark.createDataFrame([(1, text)], "raw_id long, line string"), "raw_id", "line"))
    assert {tuple(r) for r in made.collect()} == {
        (1, "envelope", None, None, None, "version", "number", "2"), (1, "record", None, None, None, "cost", "null", None), (1, "step", "steps", 0, None, "", "null", None), (1, "call", "steps", 1, 0, "type", "string", "x"),
    }


def test_lists_anywhere_make_groups(spark):
    step = {"role": "tool", "content": [{"type": "text", "text": "x"}, "y"], "tool_calls": [{"name": "f", "arguments": {"l": [1]}, "tags": ["u"]}]}
    text = json.dumps({"labels": ["v"], "record": {"metadata": {"authors": [{"name": "a", "roles": ["r", "s"]}, {"name": "b"}]}, "grid": [[1], [2, {}]], "steps": [step]}})
    made = nested.shred(spark.createDataFrame([(1, text)], "raw_id long, line string"), "raw_id", "line").persist()
    assert {tuple(r)[1:] for r in nested.repeated(made).collect()} == {
        ("(envelope).labels[]", "0", "", "v"), ("metadata.authors[]", "0", "name", "a"), ("metadata.authors[].roles[]", "0,0", "", "r"), ("metadata.authors[].roles[]", "0,1", "", "s"), ("metadata.authors[]", "1", "name", "b"),
        ("grid[][]", "0,0", "", "1"), ("grid[][]", "1,0", "", "2"), ("grid[][]", "1,1", "", "{}"), ("steps[].content[]", "0,0", "type", "text"), ("steps[].content[]", "0,0", "text", "x"), ("steps[].content[]", "0,1", "", "y"),
        ("steps[].tool_calls[].tags[]", "0,0,0", "", "u"),
    }
    authors = nested.pivot(made, "metadata.authors[]", ["name"])
    assert [(r.parent, r.pos, r.name) for r in authors.orderBy("pos").collect()] == [([], 0, "a"), ([], 1, "b")]


@settings(max_examples=300, deadline=None)
@given(JSON, st.sampled_from([None, 1, "\t"]))
def test_stream_finds_the_leaves_of_the_tree(value, indent):
    text = json.dumps(value, indent=indent)
    want = [(p, None if v is None else v if isinstance(v, str) else json.dumps(v)) for p, v in nested.leaves(value)]
    assert [(p, v) for p, _, v in nested.leaf_triples(text)] == want
    assert nested.leaf_triples(text[:-1]) is None or isinstance(value, int)


@pytest.mark.parametrize("bad", ["[1,]", '{"a":}', "{,}", "[1 2]", "1 2", '{"a" 1}', "[}", "", " ", '"a', "nul", '{"a":1,}', "[,1]", '{"a":1]', "NaN", "[]]", None, '"' + "a" * 50_000, '{"a":"' + "\\n" * 50_000, '["a":1]', '{"a":1 "b":2}', "01", "-"])
def test_stream_takes_no_incomplete_texts(bad):
    assert nested.scan(bad) is None


def test_last_of_repeated_keys_counts():
    assert nested.leaf_triples('{"a":{"x":1},"b":2,"a":[3],"c":{"d":1,"d":null}}') == [("b", "number", "2"), ("a[0]", "number", "3"), ("c.d", "null", None)]
    rows = {g: f for g, _, f in nested.triples('{"record":{"task":"x"},"version":1,"version":2,"record":{"task":"y","task":"z"}}')}
    assert rows[""]["task"] == "z"
    assert rows["envelope+"]["value"] == "2"


def test_deep_values_are_kept_whole(spark):
    deep = "[" * 200_000 + "7" + "]" * 200_000
    rows = {g: f for g, _, f in nested.triples('{"task":"t","metadata":' + deep + ',"extra":1}')}
    assert rows[""]["metadata"] == deep
    assert rows["+"]["path"] == "extra"


def test_any_schema_is_shredded_by_its_lists(spark):
    texts = [(1, '{"id":"x","orders":[{"items":[{"sku":1,"tags":["a"]},{"sku":2.50}],"at":{"day":3}},{"items":[]}]}'), (2, "[{}, 5]"), (3, "{"), (None, None)]
    made = nested.shred(spark.createDataFrame(texts, "k int, t string"), "k", "t", trajectories=False).persist()
    orders = {(r.record_key, tuple(r.parent), r.pos, r["at.day"]) for r in nested.pivot(made, "orders[]", ["at.day"]).collect()}
    assert orders == {(1, (), 0, "3"), (1, (), 1, None)}
    items = {(r.record_key, tuple(r.parent), r.pos, r.sku) for r in nested.pivot(made, "orders[].items[]", ["sku"]).collect()}
    assert items == {(1, (0,), 0, "1"), (1, (0,), 1, "2.5")}
    assert {(tuple(r.parent), r.other[""]) for r in nested.pivot(made, "orders[].items[].tags[]", []).collect()} == {((0, 0), "a")}
    assert {(r.record_key, r.pos) for r in nested.pivot(made, "[]", []).collect()} == {(2, 0), (2, 1)}


def test_equal_paths_in_a_call_come_once(spark):
    text = json.dumps({"steps": [{"tool_calls": {"name": "f", "arguments": {"a.b": 1, "a": {"b": 2}}}}]})
    made = nested.shred(spark.createDataFrame([(1, text)], "raw_id long, line string"), "raw_id", "line")
    assert [r.arg_path for r in nested.arguments(made).collect()] == ["a.b", "a.b"]
    assert [(r.call_pos, r.arg_path) for r in nested.arguments(made, distinct=True).collect()] == [(0, "a.b")]
