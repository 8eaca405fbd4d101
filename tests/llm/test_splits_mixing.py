import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import mixing as M
from wakeline.llm import splits as S

U = [f"0000000{i}-1111-2222-3333-444444444444" for i in range(9)]


def test_keys_of_metadata():
    assert S.keys_of('{"instance_id": "a__b-1", "author": " @Ann "}') == (["a:ann", "i:a__b-1"], "")
    assert S.keys_of('{"origin": {"instance_id": "x"}, "author": ["A", {"handle": "@b", "team": "t"}, null], "source": " S ", "repo": "r"}') == (["a:a", "a:b", "i:x"], "s")
    assert S.keys_of('{"author": {"handle": "C", "team": "mapper"}}') == (["a:c"], "")
    for m in (None, "", "{}", "null", '{"author": "un', '{"author": "Unknown"}', '{"author": "N/A"}', '{"author": " - "}', '{"author": ["anonymous", ""]}', "[1, 2]"):
        assert S.keys_of(m)[0] == []


def test_components_on_random_graphs(spark):
    rnd = random.Random(4)
    for n, m in ((30, 15), (60, 50), (40, 200)):
        edges = [(f"n{rnd.randrange(n):03}", f"n{rnd.randrange(n):03}") for _ in range(m)] + [(f"z{i:03}", f"z{i + 1:03}") for i in range(40)] + [("n000", None)]
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            if b is not None:
                a, b = sorted((find(a), find(b)))
                parent[b] = a
        want = {(x, find(x)) for x in parent if find(x) != x}
        got = {tuple(r) for r in S.components(spark.createDataFrame(edges, "u string, v string")).collect()}
        assert got == want


def records(spark):
    rows = [
        (f"{U[0]}-cut1", '{"author": "ann", "source": "a"}'), (f"{U[0].upper()}:0:1:before_init", "{}"), (f"{U[1]}_cut2", '{"author": ["@ANN ", "bob"]}'), (f"{U[2]}-cut1", '{"origin": {"instance_id": "i1"}, "author": {"handle": "Bob"}}'),
        (f"{U[3]}-cut1", '{"instance_id": "i1", "author": "unknown"}'), (f"{U[4]}-cut1", '{"author": "unknown"}'), (f"{U[5]}-cut1", None), (f"{U[6]}-cut1", '{"author": "ann'), (f"{U[5]}-cut1", None), (None, "{}"), ("odd", '{"author": "zed"}'),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "trajectory_id string, metadata string, id string, group_id string")


def test_groups(spark):
    got = {r.id: r.group_id for r in S.groups(records(spark)).collect()}
    first = f"{U[0]}-cut1"
    assert got == {f"{U[0]}-cut1": first, f"{U[0].upper()}:0:1:before_init": first, f"{U[1]}_cut2": first, f"{U[2]}-cut1": first, f"{U[3]}-cut1": first, f"{U[4]}-cut1": f"{U[4]}-cut1", f"{U[5]}-cut1": f"{U[5]}-cut1", f"{U[6]}-cut1": f"{U[6]}-cut1", "odd": "odd"}
    assert S.groups(records(spark).limit(0)).count() == 0


def test_split_keeps_groups_and_quotas(spark):
    rnd = random.Random(9)
    rows = [(f"r{i}", f'{{"author": "a{rnd.randrange(150)}", "source": "{"xyz"[i % 3]}"}}') for i in range(600)]
    df = spark.createDataFrame(rows, "trajectory_id string, metadata string")
    made = S.split(df).collect()
    assert len(made) == 600
    by_group = {}
    for r in made:
        by_group.setdefault(r.group_id, set()).add(r.split)
    assert all(len(v) == 1 for v in by_group.values())
    share = {s: sum(r.split == s for r in made) / 600 for s in S.SHARES}
    assert all(abs(share[s] - p) < 0.01 for s, p in S.SHARES.items())
    assert {(r.id, r.split) for r in S.split(df).collect()} == {(r.id, r.split) for r in made}
    assert S.split(df.limit(0)).count() == 0


def test_flow_is_optimal_on_small_cases():
    import itertools

    rnd = random.Random(2)
    for _ in range(40):
        supply = [rnd.randint(0, 2) for _ in range(rnd.randint(1, 3))]
        total = sum(supply)
        link = [[sorted(rnd.uniform(-3, 3) for _ in range(n)) for _ in range(2)] for n in supply]
        out = [sorted(rnd.uniform(-3, 3) for _ in range(total + 1)) for _ in range(2)]
        cost = lambda f: sum(sum(link[b][s][: f[b][s]]) for b in range(len(supply)) for s in range(2)) + sum(sum(out[s][: sum(r[s] for r in f)]) for s in range(2))  # noqa: B023, E731
        best = min(cost([[k, n - k] for k, n in zip(ks, supply)]) for ks in itertools.product(*(range(n + 1) for n in supply)))
        got = S.min_cost_flow(supply, link, out)
        assert [sum(r) for r in got] == supply
        assert cost(got) == pytest.approx(best)


def test_allocation_of_one_giant_group():
    got = S.allocate([(1000, 0, 1), (1, 0, 200), (1, 1, 50)])
    assert got[1000, 0] == [1, 0, 0]
    assert sum(got[1, 0]) == 200
    assert got[1, 0][0] < 60


def test_poisson_means():
    rng = np.random.default_rng(1)
    for rate, cap in ((0.3, 1), (1.7, 2), (2.9, 3), (0.05, 5), (3.0, 3)):
        steps = M.steps_of(rate, cap)
        assert len(steps) == cap
        assert np.mean((rng.random(200_000)[:, None] >= np.array(steps)).sum(1)) == pytest.approx(rate, rel=0.03)
    assert M.steps_of(0.0, 3) == M.steps_of(1.0, 0) == []


def test_tokens_match_the_tokenizer(spark):
    import base64
    import os

    import tiktoken

    if not os.path.exists(M.TOKENIZER):
        pytest.skip("no tokenizer files")
    with open(M.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("x", pat_str=M.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello  world\n", "", None, "naïve 数据 <|endoftext|>", "x" * 5000]
    df = spark.createDataFrame([(i, t, "A b") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_key: r.n_tokens for r in M.token_sizes(df, "doc_id", "text", "source").collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_mix(spark):
    n = 3000
    sizes = spark.range(n).select(F.col("id").alias("doc_key"), F.when(F.col("id") % 3 < 2, "big_one").when(F.col("id") % 30 == 2, "small").alias("source"), F.lit(10).cast("long").alias("n_tokens"))
    targets = spark.createDataFrame([("Big One", 0.5, 1), (" SMALL ", 0.3, 4), ("absent", 0.1, 2), ("Big-One", 0.1, 1), (None, 0.1, 1), ("nul", None, None)], "source string, target_share double, max_repeats int")
    plan = M.mix_plan(sizes, targets)
    got = {r.key: (r.source, r.short, round(r.rate, 6)) for r in plan.collect()}
    assert got == {"big_one": ("Big One", False, 0.75), "small": (" SMALL ", True, 4.0), "absent": ("absent", True, 0.0), "nul": ("nul", False, 0.0)}
    mixed = M.replicate(sizes, plan)
    rows = mixed.collect()
    used = {}
    for r in rows:
        used.setdefault(r.source, []).append((r.doc_key, r.copy))
    assert len(used[" SMALL "]) == 4 * 100
    assert len(set(used["Big One"])) == len(used["Big One"]) == pytest.approx(1500, rel=0.07)
    assert {k for k, _ in used["Big One"]} <= {i for i in range(n) if i % 3 < 2}
    assert [tuple(r) for r in M.replicate(sizes, plan).collect()] == [tuple(r) for r in rows]
    sh = {r.source: r for r in M.shares(plan, mixed).collect()}
    assert sum(r.actual_share for r in sh.values()) == pytest.approx(1)
    assert sh["absent"].n_used == 0
    assert M.mix_plan(sizes.limit(0), targets).where("short").count() == 0
    assert M.replicate(sizes.limit(0), M.mix_plan(sizes.limit(0), targets)).count() == 0


def test_size_of_the_mix_and_its_deviation(spark):
    n = 6000
    sizes = spark.range(n).select(F.col("id").alias("doc_key"), F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("source"), (F.lit(5) + F.col("id") % 20).alias("n_tokens"))
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3), ("none", 0.0, 1), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    plan = M.mix_plan(sizes, targets, total_tokens=40_000)
    sh = {r.source: r for r in M.shares(plan, M.replicate(sizes, plan)).collect()}
    for s in "ab":
        assert sh[s].wanted == 20_000
        assert 0 < sh[s].sd_tokens < 1000
        assert abs(sh[s].used_tokens - sh[s].wanted) < 4 * sh[s].sd_tokens
    assert {s for s, r in sh.items() if r.short} == {"gone"}
    assert M.variance_of(M.steps_of(1.0, 1)) == M.variance_of([]) == 0
    rng = np.random.default_rng(3)
    for rate, cap in ((0.4, 1), (1.3, 4)):
        steps = M.steps_of(rate, cap)
        assert np.var((rng.random(200_000)[:, None] >= np.array(steps)).sum(1)) == pytest.approx(M.variance_of(steps), rel=0.03)


def test_flow_within_a_size():
    rnd = random.Random(5)
    for _ in range(60):
        counts = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 12))]
        want = S.quotas([(1, sum(counts))])[1]
        sent = S.share_out(counts, want)
        assert [sum(r) for r in sent] == counts
        assert [sum(c) for c in zip(*sent)] == want
        assert all(abs(x - n * w / sum(counts)) < 2 for row, n in zip(sent, counts) for x, w in zip(row, want))
        blocks = S.in_blocks(counts, want)
        assert [sum(r) for r in blocks] == counts
        assert [sum(c) for c in zip(*blocks)] == want


def test_profiles_and_sizes_are_exact(spark, monkeypatch):
    rows = [(f"r{a}-{i}", f'{{"author": "a{a}", "source": "s{a % 90}"}}') for a, n in enumerate([1503, 1501, *[2] * 400]) for i in range(n)]
    df = spark.createDataFrame(rows, "trajectory_id string, metadata string")
    for block in (S.BLOCK, 16):
        monkeypatch.setattr(S, "BLOCK", block)
        made = S.split(df).collect()
        assert len(made) == len(rows)
        share = {s: sum(r.split == s for r in made) / len(rows) for s in S.SHARES}
        assert all(abs(share[s] - p) < 0.01 for s, p in S.SHARES.items() if p < 0.5)
        small = [r for r in made if int(r.group_id[1:].split("-")[0]) >= 2]
        per_label = {}
        for r in small:
            per_label.setdefault(r.label, []).append(r.split)
        assert len(per_label) == 90
    sizes = S.allocate([(1503, 1, 1), (1501, 2, 1), *((2, x, 4) for x in range(90))])
    assert sum(sum(v) for v in sizes.values()) == 362
