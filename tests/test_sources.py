import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline import lineage, providers, schema
from wakeline.operators import manifest as M
from wakeline.operators import sampling as P
from wakeline.sources import files, listing, sinks
from wakeline.streaming import runs


def test_jsonl(spark, tmp_path):
    rows = [{"task": "t", "summary": "s", "steps": [{"role": "assistant", "tool_calls": [{"name": "f", "arguments": {"n": 1.5}}]}], "more": 1}, {"task": "u", "summary": "", "metadata": {"a": [1]}}]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join([json.dumps(rows[0]), "", "   ", json.dumps(rows[1])]))
    t = files.read_trajectories(spark, str(path))
    assert t.count() == 2
    kind = t.select(F.expr("schema_of_variant(variant_get(steps[0].tool_calls[0].arguments, '$.n'))").alias("k")).where("k <> 'VOID'").first().k
    assert kind.startswith("DECIMAL") or kind == "DOUBLE"
    path.write_text(json.dumps({"task": "t"}))
    with pytest.raises(Exception, match="summary is missing"):
        files.read_trajectories(spark, str(path)).collect()
    path.write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_trajectories(spark, str(path)).collect()


def test_folder_array_text_and_dataset(spark, tmp_path):
    fields = T.StructType([T.StructField("uid", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text(json.dumps({"uid": "a", "n": 1}, indent=4))
    (tmp_path / "d/b.json").write_text("{broken")
    (tmp_path / "d/collect.json").write_text(json.dumps({"uid": "c", "n": 1}))
    assert [r.uid for r in files.read_folder(spark, str(tmp_path / "d"), fields).collect()] == ["a"]
    (tmp_path / "m.json").write_text(json.dumps([{"role": "user", "content": "x"}, {"role": "tool", "content": "y", "extra": {"raw_output": "z"}}], indent=1))
    m = files.read_message_array(spark, str(tmp_path / "m.json")).orderBy("pos")
    assert [r.role for r in m.collect()] == ["user", "tool"]
    assert m.select(F.expr("variant_get(extra, '$.raw_output', 'string') o")).collect()[1].o == "z"
    assert files.read_text(spark, str(tmp_path / "d/b.json")).first().value == "{broken"
    root = tmp_path / "hub"
    spark.range(3).write.parquet(str(root / "SWE-bench/SWE-bench_Verified/train.parquet"))
    (root / "o").mkdir(parents=True)
    (root / "o/dev.json").write_text('{"a": 1}\n')
    assert files.read_dataset(spark, "swe-bench", str(root)).count() == 3
    assert files.read_dataset(spark, "o", str(root), "dev").count() == 1


def test_listing_reads_names_with_colons(spark, tmp_path):
    for n in ("ab:0.json", "ab:0:3:after:1.json", "ab:0:3:before:0:2.json", "ab:0:4:after:0.json", "cd:0.json", "ab:0:4:before_init.json", "note.txt"):
        (tmp_path / n).write_text(json.dumps({"n": n}))
    rows = listing.read_listing(spark, str(tmp_path), bodies=False, files_per_partition=2)
    assert rows.count() == 7
    assert rows.where("body IS NOT NULL").count() == 0
    assert [r.uid for r in M.bases_without_branches(rows, "file_name").collect()] == ["cd"]
    assert [tuple(r) for r in M.steps_missing_before(rows, "file_name").collect()] == [("ab:0", 4)]
    got = {r.step: (r.n_existing, r.existing_ks, r.has_before_init) for r in M.steps_incomplete(rows, "file_name", 2).collect()}
    assert got == {3: (1, [0], False), 4: (0, [], True)}
    assert json.loads(listing.read_one(spark, str(tmp_path), "cd").first().body) == {"n": "cd:0.json"}


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("a", "Submitted", 1), ("b", None, 2)], "uid string, exit_status string, n int")
    sinks.append_records(r, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    sinks.append_missing(r, "uid", str(tmp_path / "p"))
    sinks.append_missing(r.unionByName(spark.createDataFrame([("c", "x", 3)], r.schema)), "uid", str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    sinks.append_metrics(r.agg(F.count("*").alias("n")), str(tmp_path / "m"), 4)
    sinks.append_jsonl(r, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "m")).first().step == 4
    m = spark.createDataFrame([("t", 1, "b"), ("t", 0, 'a"')], "run string, pos int, content string")
    assert json.loads(sinks.json_arrays(m, "run", "pos", "content").first().json) == [{"content": 'a"'}, {"content": "b"}]
    df, seen = sinks.observed(r, "o", n=F.count("*"))
    df.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"n": 2}


def test_providers(spark):
    r = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k long, prompt string")

    def sample(rows):
        if any(x["prompt"] == "bad" for x in rows):
            raise ValueError("refused")
        return [{"k": x["k"], "sample_idx": i, "tokens": [1, 2], "logprobs": [-1.0, -2.0], "text": x["prompt"] * (i + 1)} for x in rows for i in range(2)]

    got = providers.ask(r, "k", ["prompt"], sample, providers.SAMPLES, batch=1).collect()
    assert {(x.k, x.text) for x in got} == {(1, "a"), (1, "aa"), (2, None), (3, "c"), (3, "cc")}
    assert [x.error for x in got if x.k == 2] == ["ValueError: refused"]
    t = providers.from_table(r, spark.createDataFrame([(1, "x")], "k long, text string"), "k")
    assert {(x.k, x.text) for x in t.collect()} == {(1, "x"), (2, None), (3, None)}


def test_ranks_and_slices(spark):
    ids = [f"i{n}" for n in range(53)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    ranked = P.ranked(df, P.shuffle_order(1, F.col("id")), "id").persist()
    order = [r.id for r in ranked.orderBy("rn").collect()]
    assert [r.rn for r in ranked.orderBy("rn").collect()] == list(range(53))
    assert order != sorted(ids)
    assert sorted(order) == sorted(ids)
    for spec in ("5:20", ":10", "40:", "-7:", ":-50", "3:50:4", "::10", "60:"):
        a, b, c = ([int(x) if x else None for x in spec.split(":")] + [None])[:3]
        assert [r.id for r in P.take_slice(ranked, spec).orderBy("rn").collect()] == order[a:b:c]
    assert P.batches(ranked, 10).groupBy("batch_id").count().where("count = 10").count() == 5
    with pytest.raises(ValueError, match="fewer"):
        P.batches(ranked, 54)
    assert P.ranked(df.limit(0), P.shuffle_order(1, F.col("id")), "id").count() == 0
    assert P.filter_ids(df, "id", "i1|i2$").count() == 12


def test_last_wins_and_completion(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, at int, v string")
    assert {tuple(r) for r in M.last_wins(t, "k", "at").select("k", "v").collect()} == {("a", None), ("b", "y")}
    m = spark.createDataFrame([("r1", 0, "user", None, "i"), ("r1", 1, "exit", "Submitted", "i"), ("r2", 0, "exit", "Submitted", "i"), ("r2", 1, "tool", "x", "i"), ("r3", 0, "exit", "LimitsExceeded", None)], "run string, pos int, role string, content string, inst string")
    done = M.completed(m, "run", "pos", "role", "inst", F.col("content"))
    assert {tuple(r) for r in done.collect()} == {("i", 1), ("", 1)}
    inst = spark.createDataFrame([("i",), ("j",)], "inst string")
    assert [r.inst for r in M.open_instances(inst, "inst", done).collect()] == ["j"]


def test_stream(spark, tmp_path):
    s = spark.createDataFrame([("r", 0, "exit", "Submitted", "i", "2031-01-01 00:00:00"), ("r", 0, "exit", "Submitted", "i", "2031-01-01 00:10:00"), ("q", 0, "exit", "RuntimeError", "i", "2031-01-01 00:00:00"), ("z", 0, "tool", "", "i", "2031-02-01 00:00:00")], "run_id string, pos int, role string, content string, instance_id string, arrived_at string").withColumn("arrived_at", F.to_timestamp("arrived_at"))
    s.repartition(1).write.parquet(str(tmp_path / "in"))
    out = runs.finished_runs(runs.read_stream(spark, str(tmp_path / "in"), s.schema))
    q = out.writeStream.format("memory").queryName("finished").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.instance_id, r.n_done) for r in spark.table("finished").collect()] == [("i", 1)]


def test_checkpoints_cut_lineage(spark):
    df = lineage.cut(spark.range(10).selectExpr("id * 2 AS x"))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 10


def test_schema_of_history(spark):
    df = spark.createDataFrame([("i", "p", [("system", "s"), ("user", "u")])], schema.HISTORY)
    assert [tuple(r) for r in files.history_messages(df).collect()] == [("i", 0, "system", "s"), ("i", 1, "user", "u")]


def test_stored_tables_cut_lineage(spark):
    df = lineage.stored(spark.range(10).selectExpr("id * 2 AS x", "array(id, null) AS y"))
    assert "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.x, r.y) for r in df.collect()) == [(2 * i, [i, None]) for i in range(10)]
    assert lineage.stored(df.limit(0)).count() == 0
