"""Problem 3: train, validation and test splits that keep related records together.

Records are related through keys (run, task instance, authors). Runs are numbered in the byte order of their smallest record id,
and every run with a key is linked to the key's first run, so keys need no nodes of their own. Groups are the connected
components, found by alternating large and small stars over these numbers: every round replaces each node's neighbours by links
to the smallest of them, until only stars are left, which takes a number of rounds logarithmic in the longest chain. The
centre of a star has the group's smallest id.

Groups go to splits by min-cost flow. Groups of identical size and label profile (how many records of each label) form a
bundle. First each size gets its quota of every split: from the largest size on, groups are shared out in proportion to what is
left of the quotas, and what rounding leaves goes where the deviation from the quotas costs least. Then the groups of one
size, which are units of the same worth, flow from their bundles to the splits: the capacity of a split is the size's quota,
and the cost of a link is the deviation from the bundle's own proportional share, as labels are in proportion if the bundles
are. The flow is integral. Which groups of a bundle go where is decided by hash.

The driver sees one row per size and block of at most about BLOCK bundles; as n different sizes need n * (n + 1) / 2 records,
sizes are few. Flows are solved on the executors, one block at a time; in tables of up to BLOCK bundles a size, a block is the
whole size. Hot keys: minima are combined before the shuffle, links to them are salted, and stars are split by adaptive execution.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from wakeline.lineage import stored

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
BLOCK, BUCKETS, SALT = 1024, 1 << 14, 8
MAX_ROUNDS = 60
#: Handles that name nobody.
PLACEHOLDERS = frozenset({"unknown", "anonymous", "n/a", "-", ""})
_RUN = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)


def handle(name: object) -> str | None:
    """A handle in the form in which handles are compared, None for placeholders."""
    h = str(name).strip().lower()
    h = h.removeprefix("@").strip()
    return None if h in PLACEHOLDERS else h


def keys_of(metadata: str | None) -> tuple[list[str], str]:
    """(keys that relate, label) of a record's metadata: `i:` task instances and `a:` authors wherever they stand; the label
    is its source. Metadata that is no JSON relates nothing."""
    try:
        value = json.loads(metadata or "null")
    except (ValueError, RecursionError):
        return [], ""
    found, label, stack = set(), "", [("", value)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            if key in ("author", "authors"):
                stack += [("handle" if k.lower() in ("handle", "name", "login", "id") else k.lower(), x) for k, x in v.items()]
            else:
                stack += [(k.lower(), x) for k, x in v.items()]
        elif isinstance(v, list):
            stack += [(key, x) for x in v]
        elif key in ("author", "authors", "handle", "handles") and isinstance(v, str):
            if h := handle(v):
                found.add("a:" + h)
        elif key in ("instance_id", "instance_ids") and isinstance(v, str):
            if v.strip():
                found.add("i:" + v.strip())
        elif key == "source" and isinstance(v, str):
            label = v.strip().lower()
    return sorted(x.encode("utf-8", "replace").decode() for x in found), label.encode("utf-8", "replace").decode()


def run_of(record_id: str) -> str:
    """The leading UUID in lower case, or the id itself."""
    m = _RUN.match(record_id)
    return m[0].lower() if m else record_id


def relations(records: DataFrame, key: str, metadata: str) -> DataFrame:
    """id, run, keys, label of each distinct record; null ids are left out. Only the two columns are read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [keys_of(m) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(map(run_of, ids), pa.string()), pa.array([k for k, _ in made], pa.list_(pa.string())), pa.array([x for _, x in made], pa.string())], names=["id", "run", "keys", "label"])

    rows = records.select(F.col(key).cast("string").alias("id"), F.col(metadata).cast("string").alias("m")).where("id IS NOT NULL")
    return rows.mapInArrow(parse, "id string, run string, keys array<string>, label string").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """u, v of every node u that has a smaller one in its connected component, v being the smallest. edges: u, v numbers.

    Each round is stored; the driver sees two numbers, which are taken while the round is written.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        seen = Observation()
        now = stored(_small_star(_large_star(now)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        state = (seen.get["n"], seen.get["h"])
        if state == before or not state[0]:
            return now
        before = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def numbered(names: DataFrame, name: str) -> DataFrame:
    """`names`, which are distinct, with numbers `no` in their order; stored."""
    return stored(names.orderBy(name).withColumn("no", F.monotonically_increasing_id()))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root of every node that has a smaller one in its connected component; a root is the smallest node.

    Loops, repeated and null edges do no harm.
    """
    a, b = F.col(u), F.col(v)
    held = stored(edges.select(a.alias("a"), b.alias("b")).where(a.isNotNull() & b.isNotNull()).distinct())
    nodes = numbered(held.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    first, second = (nodes.select(F.col("node").alias(x), F.col("no").alias(y)) for x, y in (("a", "u"), ("b", "v")))
    found = stars(held.join(first, "a").join(second, "b").select("u", "v"))
    named = found.join(nodes.select(F.col("no").alias("u"), "node"), "u")
    return named.join(nodes.select(F.col("no").alias("v"), F.col("node").alias("root")), "v").select("node", "root")


def grouped(related: DataFrame) -> DataFrame:
    """run, group_id of every run in `relations`-like rows; group_id is the smallest id of the group in byte order."""
    runs = numbered(related.groupBy("run").agg(F.min("id").alias("name")), "name")
    held = stored(related.select("run", F.explode("keys").alias("k")).distinct().join(runs, "run").select("k", F.col("no").alias("u")))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s")
    first = held.groupBy("k").agg(F.min("u").alias("v")).select("k", "v", salts)
    edges = held.select("k", "u", F.pmod("u", F.lit(SALT)).cast("int").alias("s")).join(first, ["k", "s"]).select("u", "v")
    roots = stars(edges).select(F.col("u").alias("no"), F.col("v").alias("first"))
    known = runs.join(roots, "no", "left").select("run", F.coalesce("first", "no").alias("no"))
    return known.join(runs.select("no", F.col("name").alias("group_id")), "no").select("run", "group_id")


def groups(records: DataFrame, key: str = "trajectory_id", metadata: str = "metadata") -> DataFrame:
    """id, group_id, label of every distinct record."""
    related = stored(relations(records, key, metadata))
    return related.groupBy("id", "run").agg(F.max("label").alias("label")).join(grouped(related), "run").select("id", "group_id", "label")


def min_cost_flow(supply: list[int], marginal_link: list[list[list[float]]], marginal_out: list[list[float]]) -> list[list[int]]:
    """Units sent from each bundle to each split at least total cost.

    marginal_link[b][s][k]: cost of the k-th unit from b to s; marginal_out[s][k]: of the k-th unit into s; both must not
    fall with k. Successive shortest paths: as costs are convex, the cheapest augmenting path is always right. A path goes from
    its bundle to a split and from there on to others, where a bundle that has units in the one sends one to the other.
    """
    nb, ns = len(supply), len(marginal_out)
    flow, into = np.zeros((nb, ns), np.int64), [0] * ns
    more = np.array([[costs[0] if costs else np.inf for costs in row] for row in marginal_link]).reshape(nb, ns)
    less = np.full((nb, ns), -np.inf)  # what the last unit cost

    def add(b: int, s: int, units: int) -> None:
        flow[b, s] += units
        costs, k = marginal_link[b][s], int(flow[b, s])
        more[b, s] = costs[k] if k < len(costs) else np.inf
        less[b, s] = costs[k - 1] if k else -np.inf

    for b in range(nb):
        for _ in range(supply[b]):
            dist, via = more[b].tolist(), [(-1, b)] * ns
            moves = [[(s, t, x := int(np.argmin(more[:, t] - less[:, s])), float(more[x, t] - less[x, s])) for t in range(ns) if t != s] for s in range(ns)]
            for _ in range(ns):
                for s, t, x, cost in (m for row in moves for m in row):
                    if dist[s] + cost < dist[t] - 1e-9:
                        dist[t], via[t] = dist[s] + cost, (s, x)
            last = min(range(ns), key=lambda s: dist[s] + (marginal_out[s][into[s]] if into[s] < len(marginal_out[s]) else np.inf))  # noqa: B023
            into[last] += 1
            while last >= 0:
                s, x = via[last]
                add(x, last, 1)
                if s >= 0:
                    add(x, s, -1)
                last = s
    return flow.tolist()


def share_out(counts: list[int], want: list[int]) -> list[list[int]]:
    """How many of each bundle's groups, all of one size, go to each split; columns sum to `want`. The cost is the deviation from
    the bundle's proportional share. The whole part of that share costs nothing; the rest is sent as a flow."""
    total = max(1, sum(counts))
    due = [[n * w / total for w in want] for n in counts]
    whole = [[floor(x + 1e-9) for x in row] for row in due]
    left = [n - sum(row) for n, row in zip(counts, whole)]
    room = [w - sum(row[s] for row in whole) for s, w in enumerate(want)]
    links = [[[abs(w + k + 1 - d) - abs(w + k - d) for k in range(u)] for w, d in zip(row, ds)] for row, ds, u in zip(whole, due, left)]
    sent = min_cost_flow(left, links, [[0.0 if k < r else 1e6 for k in range(sum(left))] for r in room])
    return [[w + x for w, x in zip(a, b)] for a, b in zip(whole, sent)]


def quotas(sizes: list[tuple[int, int]], shares: dict[str, float] = SHARES) -> dict[int, list[int]]:
    """How many groups of each size go to each split. sizes: (size, number of groups)."""
    total = sum(shares.values())
    part = [x / total for x in shares.values()]
    due = [sum(size * n for size, n in sizes) * p for p in part]
    out = {}
    for size, n in sorted(sizes, reverse=True):
        open_due = [max(0.0, d) for d in due]  # what larger groups have left of the quotas
        share = [d / sum(open_due) for d in open_due] if sum(open_due) > 0 else part
        sent = [int(n * p + 1e-9) for p in share]
        due = [d - size * k for d, k in zip(due, sent)]
        for _ in range(n - sum(sent)):
            s = min(range(len(part)), key=lambda s: abs(due[s] - size) - abs(due[s]))  # noqa: B023
            sent[s] += 1
            due[s] -= size
        out[size] = sent
    return out


def in_blocks(counts: list[int], want: list[int]) -> list[list[int]]:
    """`want` spread over blocks of `counts` groups, each in proportion but for less than one group a split, which the next block
    makes up for."""
    total, owed, out = max(1, sum(counts)), [0.0] * len(want), []
    for n in counts:
        owed = [o + n * w / total for o, w in zip(owed, want)]
        mine = [max(0, floor(o + 1e-9)) for o in owed]
        while sum(mine) > n:
            mine[mine.index(max(mine))] -= 1
        for _ in range(n - sum(mine)):
            mine[max(range(len(want)), key=lambda s: owed[s] - mine[s])] += 1  # noqa: B023
        owed = [o - m for o, m in zip(owed, mine)]
        out.append(mine)
    return out


def allocate(bundles: list[tuple[int, int, int]], shares: dict[str, float] = SHARES) -> dict[tuple[int, int], list[int]]:
    """Groups of each bundle that go to each split, by the steps that `split` takes in Spark. bundles: (size, profile, groups)."""
    sizes: dict[int, list[tuple[int, int]]] = {}
    for size, profile, n in bundles:
        sizes.setdefault(size, []).append((profile, n))
    want = quotas([(size, sum(n for _, n in own)) for size, own in sizes.items()], shares)
    return {(size, profile): row for size, own in sizes.items() for (profile, _), row in zip(own, share_out([n for _, n in own], want[size]))}


def split(records: DataFrame, key: str = "trajectory_id", metadata: str = "metadata", shares: dict[str, float] = SHARES, seed: int = 42) -> DataFrame:
    """id, group_id, label, split of every distinct record. Records of a group share a split.

    A group larger than a split's share makes the shares miss the quotas; the flow keeps the miss as small as it can. Empty
    input gives an empty result.
    """
    spark, names = records.sparkSession, list(shares)
    members = stored(groups(records, key, metadata))
    labels = members.groupBy("group_id", "label").count().groupBy("group_id").agg(F.sum("count").alias("size"), F.array_sort(F.collect_list(F.struct("label", "count"))).alias("p"))
    sized = stored(labels.select("group_id", "size", F.xxhash64(F.to_json("p")).alias("profile"), F.xxhash64(F.lit(seed), "group_id").alias("h")).withColumn("q", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    bundles = sized.groupBy("size", "profile").agg(F.count("*").alias("n"))
    per_size = bundles.groupBy("size").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocked = stored(bundles.join(per_size, "size").select("size", "profile", "n", F.pmod("profile", "blocks").alias("block")))
    rows: dict[int, list[tuple[int, int]]] = {}
    for size, block, n in blocked.groupBy("size", "block").agg(F.sum("n")).orderBy("size", "block").collect():
        rows.setdefault(size, []).append((block, n))
    want = quotas([(size, sum(n for _, n in own)) for size, own in rows.items()], shares)
    plan = [(size, block, w) for size, own in rows.items() for (block, _), w in zip(own, in_blocks([n for _, n in own], want[size]))]
    wanted = spark.createDataFrame(plan, "size long, block long, want array<long>")

    def solve(table: pa.Table) -> pa.Table:
        until = np.cumsum(share_out(table.column("n").to_pylist(), table.column("want")[0].as_py()), axis=1)
        return pa.table({"size": table.column("size"), "profile": table.column("profile"), "until": pa.array(until.tolist(), pa.list_(pa.int64()))})

    solved = blocked.join(wanted, ["size", "block"]).groupBy("size", "block").applyInArrow(solve, "size long, profile long, until array<long>")
    offset = sized.groupBy("size", "profile", "q").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("size", "profile").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("size", "profile", "q").orderBy("h", "group_id")) + F.col("before")
    ranked = sized.join(offset, ["size", "profile", "q"]).withColumn("r", rank).join(solved, ["size", "profile"])
    named = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        named = F.when(F.col("r") <= F.get("until", F.lit(i)), names[i]).otherwise(named)
    return members.join(ranked.select("group_id", named.alias("split")), "group_id").select("id", "group_id", "label", "split")
