import json
import math
import random

import pytest
from pyspark.sql import functions as F

from wakeline.functions import diff, images, render, text
from wakeline.operators import scoring as C


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_kl_worked_case(spark):
    x = F.array(F.create_map(F.lit("a"), F.lit(-0.5), F.lit("b"), F.lit(-1.0)), F.lit(None).cast("map<string,double>"))
    z = F.array(F.create_map(F.lit("a"), F.lit(-0.7), F.lit("c"), F.lit(-2.0)), F.create_map(F.lit("a"), F.lit(-1.0)), F.create_map(F.lit("z"), F.lit(-1.0)))
    per = C.kl_per_position(x, z)
    r = one(spark, per.alias("p"), C.distortion(per).alias("d"), C.distortion_reward(C.distortion(per), F.lit("a b"), 0.1).alias("r"))
    assert r.p == pytest.approx([0.121306, 0.0], abs=1e-6)
    assert r.d == pytest.approx(0.060653, abs=1e-6)
    assert r.r == pytest.approx(-0.260653, abs=1e-6)


def test_self_score_is_zero_and_empty_is_an_error(spark):
    x = F.array(F.create_map(F.lit("a"), F.lit(-0.5)))
    none = F.slice(x, 2, 0)
    r = one(spark, C.distortion(C.kl_per_position(x, x)).alias("d"), C.distortion(C.kl_per_position(none, x)).alias("n"), C.distortion_error(C.kl_per_position(none, x)).alias("e"), C.distortion_reward(F.lit(None).cast("double"), F.lit("x")).alias("z"))
    assert (r.d, r.n, r.e, r.z) == (0.0, None, "No completion tokens scored", 0.0)


def test_random_kl(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        maps = [[{k: -rnd.random() * 5 for k in rnd.sample("abcdefgh", 4)} if rnd.random() > 0.1 else None for _ in range(rnd.randint(0, 5))] for _ in range(2)]
        rows.append((i, *maps))
    df = spark.createDataFrame(rows, "i int, x array<map<string,double>>, z array<map<string,double>>")
    for r in df.select("x", "z", C.kl_per_position(F.col("x"), F.col("z")).alias("k")).collect():
        want = [sum(math.exp(p) * (p - b[t]) for t, p in a.items() if t in b) if a and b else 0.0 for a, b in zip(r.x, r.z)]
        assert r.k == pytest.approx(want, abs=1e-9)


def test_entities_and_coverage(spark):
    rows = [("a", "read_file", [("Edit", '{"path": "src/Main.py", "n": 1.5, "deep": {"p": "x/y"}, "cmd": "ls dir/"}', "1")]), ("a", "", [("", None, "2")]), ("b", None, None)]
    steps = spark.createDataFrame(rows, "id string, name string, tool_calls array<struct<name:string,arguments:string,id:string>>")
    e = C.step_entities(steps, "id")
    assert {tuple(r) for r in e.collect()} == {("a", "read_file"), ("a", "edit"), ("a", "main.py"), ("a", ""), }
    s = spark.createDataFrame([("a", "Edited MAIN.py"), ("b", "x"), ("c", None)], "id string, summary string")
    got = {r.id: (r.n_entities, r.coverage) for r in C.coverage(e, s, "id", "summary").collect()}
    assert got == {"a": (4, 0.75), "b": (0, 0.5), "c": (0, 0.5)}


def test_partial_scores(spark):
    col = lambda *v: [F.lit(x).cast("long") for x in v]
    r = one(spark, C.partial_score(*col(0, 0, 0, 0)).alias("a"), C.partial_score(*col(0, 0, 0, 0), empty_is_failure=True).alias("b"), C.partial_score(*col(1, 1, 3, 1)).alias("c"), C.partial_score(*col(1, None, 3, 1)).alias("d"))
    assert tuple(r) == (1.0, 0.0, 0.625, 0.0)


def test_datum_lengths(spark):
    r = one(spark, C.datum(F.lit(3), F.array(F.lit(7), F.lit(8)), F.array(F.lit(-1.0), F.lit(-2.0)), F.lit(0.5)).alias("d")).d
    assert (r.target_tokens, r.logprobs, r.advantages) == ([0, 0, 7, 8], [0, 0, -1, -2], [0, 0, 0.5, 0.5])
    assert one(spark, C.loss_mask(F.lit(2), F.lit(3), 4).alias("m")).m == [0, 0, 1, 1]
    nll = one(spark, C.mean_nll(F.array(F.lit(0), F.lit(1), F.lit(1)), F.array(F.lit(-9.0), F.lit(-1.0), F.lit(-2.0))).alias("n")).n
    assert nll == 1.5


def test_text_functions(spark):
    s = "　 a b c \x85"
    r = one(spark, text.word_count(F.lit(s)).alias("w"), text.strip(F.lit(s)).alias("s"), text.truncate_middle(F.lit("x" * 5000)).alias("t0"), text.truncate_middle(F.lit("x" * 5001)).alias("t1"), text.floor_div(F.lit(-1), F.lit(2)).alias("f"), text.section(F.lit("a[b]c"), "[", "]").alias("sec"), text.section(F.lit("a[b"), "[", "]").alias("no"), text.section_by_find(F.lit("xx<yyz"), "<", ">").alias("find"), text.section_by_find(F.lit("abc"), "<", ">").alias("none"))
    assert (r.w, r.s, len(r.t0), len(r.t1), r.f, r.sec, r.no) == (3, "a b c", 5000, 5000 + len("\n...[truncated]..."), -1, "b", "a[b")
    assert (r.find, r.none) == ("xx<yyz"[2:-1][1:], "abc"[-1:-1][1:])


def test_images(spark):
    iid, none = F.lit("Own__Repo.0a1b2c3d4e.f__1"), F.lit(None).cast("string")
    r = one(spark, images.image_name(F.lit("x"), iid, F.lit("swe-bench")).alias("a"), images.image_name(none, iid, F.lit("SWE-smith")).alias("b"), images.image_name(none, iid, F.lit("other")).alias("c"), images.cached_image_path(iid, "/c/", "p.{base}.sif").alias("d"), images.image_name(none, iid, F.lit("swe-gym")).alias("e"))
    assert (r.a, r.c, r.d) == ("x", None, "/c/p.own_1776_repo.0a1b2c3d4e.sif")
    assert r.b.endswith("swesmith.x86_64.own_1776_repo.0a1b2c3d:latest")
    assert r.e.endswith("own_s_repo.0a1b2c3d4e.f_s_1:latest")


def test_reverse_diff():
    d = "diff --git a/x b/x\nindex ab1..cd2 100644\n--- a/x\n+++ b/x\n@@ -1,3 +1,2 @@ f\n a\n-b\n-c\n+d\n\\ No newline at end of file\n@@ -9 +8,2 @@\n-x\n+y\n+z"
    back = diff.reverse_diff(d)
    assert "index cd2..ab1 100644" in back
    assert "@@ -1,2 +1,3 @@ f\n a\n-d\n\\ No newline at end of file\n+b\n+c" in back
    assert "@@ -8,2 +9 @@\n-y\n-z\n+x" in back
    assert diff.reverse_diff(back) == d
    assert diff.reverse_diff(d.replace("\n", "\\n")) == back
    assert diff.reverse_diff("") == ""


def test_render(spark):
    kind = "id string, task string, steps array<struct<role:string,content:string,tool_calls:array<struct<name:string,arguments:string,id:string>>,tool_call_id:string,name:string>>"
    steps = [("assistant", "hi", [("f", '{"a": {"b": "é"}}', "1"), ("g", None, "2")], None, None), ("tool", "out", [], "1", "f"), ("tool", "o", None, None, ""), ("user", "u", None, None, None), ("assistant", None, [], None, None)]
    df = spark.createDataFrame([("x", "T", steps), ("y", None, None)], kind)
    got = {r.id: r.text for r in render.trajectory_text(df).collect()}
    call = "<tool_call name='f'>\n" + json.dumps({"a": {"b": "é"}}, indent=2) + "\n</tool_call>\n<tool_call name='g'>\n{}\n</tool_call>"
    assert got["x"] == "\n\n".join(["[Task]\nT", "[Partial Trajectory — 5 step(s) so far]", "[Step 1 — assistant]\nhi\n" + call, "[Step 2 — f result]\nout", "[Step 3 — tool result]\no", "[Step 4 — user]\nu", "[Step 5 — assistant]"])
    assert got["y"] == "[Task]\n\n\n[Partial Trajectory — 0 step(s) so far]"
    assert one(spark, render.json_line(F.lit('{"a":1,"b":"é"}')).alias("j")).j == json.dumps({"a": 1, "b": "é"})
    assert one(spark, render.quoted(F.lit("it's")).alias("q")).q == '"it\'s"'


def test_a_registered_query_has_distortion(spark, tmp_path):
    spark.createDataFrame([(i, [float((i * j) % 5) for j in range(64)]) for i in range(4)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    from wakeline.plans import registry

    made = [registry.QUERIES[n](spark, str(tmp_path)).first() for n in ("distortion", "distortion_shifted") if n in registry.QUERIES]
    assert any(r.distortion != 0 for r in made)


def test_diffs_with_escapes_and_several_changes():
    assert diff.reverse_diff("'@@ -1 +1 @@\\n-é \\\\ a\\n+\\u00fc\\tb'") == "@@ -1 +1 @@\n-ü\tb\n+é \\ a"
    assert diff.reverse_diff("@@ -1,2 +1,2 @@\n-x\n+y\n-z\n+w") == "@@ -1,2 +1,2 @@\n-y\n+x\n-w\n+z"
    assert diff.reverse_diff("@@ -1 +1 @@\n-x\n\\ No newline at end of file\n+y") == "@@ -1 +1 @@\n-y\n+x\n\\ No newline at end of file"
    assert diff.reverse_diff(None) is None


def test_command_that_applies_a_patch(spark):
    r = one(spark, diff.apply_command(F.lit("a\nb")).alias("c"), diff.apply_command(F.lit(None).cast("string")).alias("n"))
    mark = "PATCH_" + __import__("hashlib").md5(b"a\nb").hexdigest()
    assert r.c == f"git apply --verbose <<'{mark}'\na\nb\n{mark}"
    assert r.n is None


def test_image_errors(spark):
    none = F.lit(None).cast("string")
    r = one(spark, images.image_error(none, F.lit("other")).alias("a"), images.image_error(none, F.lit("SWE-bench")).alias("b"), images.image_error(F.lit("x"), none).alias("c"))
    assert (r.a, r.b, r.c) == ("Data source: other is not supported", None, None)


def test_groups_are_centred_with_nulls(spark):
    from wakeline.operators import scoring

    df = spark.createDataFrame([("a", 1.0, 9.0), ("a", 3.0, 9.0), ("b", 2.0, 9.0), (None, 1.0, 9.0), (None, 2.0, 9.0)], "g string, r double, advantage double")
    made = scoring.centred(df, "g", "r")
    assert sorted((r.g or "", r.r, r.mean_reward, r.advantage) for r in made.collect()) == [("", 1.0, 1.5, -0.5), ("", 2.0, 1.5, 0.5), ("a", 1.0, 2.0, -1.0), ("a", 3.0, 2.0, 1.0), ("b", 2.0, 2.0, 0.0)]
    assert {r.g for r in scoring.varied_groups(made, "g").collect()} == {"a", None}


def test_completions_are_scored(spark):
    from wakeline.operators import scoring

    top = [{"a": -0.5, "b": -1.0}, {"a": -0.5}, {"z": -1.0}]
    other = [{"c": -1.0}, {"a": -0.7, "c": -2.0}, {"a": -1.0}]
    rows = [("x", top, other, 1, 1, 3), (" ", top, other, 1, 1, 3), (None, top, other, 1, 1, 3), ("failed", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, x_top array<map<string,double>>, z_top array<map<string,double>>, n_x_context int, n_z_context int, n_x_full int")
    got = {r.text: r for r in scoring.score_completion(df, "text").withColumn("d", scoring.distortion(F.col("per_position"))).withColumn("e", scoring.distortion_error(F.col("per_position"))).collect()}
    assert got["x"].per_position == pytest.approx([0.121306, 0.0], abs=1e-6)
    assert got["x"].d == pytest.approx(0.060653, abs=1e-6)
    assert got[" "].per_position == got[None].per_position == []
    assert got[" "].e == "No completion tokens scored"
    assert got["failed"].e == "score_completion failed"
