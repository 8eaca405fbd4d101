"""Operators on ordered messages.

The canonical form is long: one row per message with a trajectory key, a position and a role. What these operators need of
the rows before a row (counts, the last value) is computed in two levels, so that a trajectory with a third of all rows is
spread over tasks: a trajectory's positions are cut into blocks of BLOCK, rows see those before them in their block, and
blocks see the sums of the blocks before them. Rows are shuffled once, by trajectory and block, and everything below works
on that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 14
_B = "_block"


@dataclass(frozen=True)
class Keys:
    """Names of the key columns of a long table."""

    traj: str = "run_id"
    pos: str = "pos"
    role: str = "role"

    def is_role(self, role: str) -> Column:
        return F.coalesce(F.col(self.role) == role, F.lit(False))


K = Keys()


def blocked(messages: DataFrame, k: Keys = K) -> DataFrame:
    """Adds the block of each row and shuffles by trajectory and block, unless that has been done."""
    if _B in messages.columns:
        return messages
    return messages.withColumn(_B, F.floor(F.col(k.pos) / BLOCK)).repartition(k.traj, _B)


def unblocked(messages: DataFrame) -> DataFrame:
    return messages.drop(_B)


def once(messages: DataFrame, arrived: str, k: Keys = K) -> DataFrame:
    """Messages of which each (trajectory, position) counts once, by the earliest arrival. The result is `blocked`."""
    w = Window.partitionBy(k.traj, _B, k.pos).orderBy(arrived)
    return blocked(messages, k).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_before(messages: DataFrame, k: Keys, counts: dict[str, Column], lasts: dict[str, Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, of the rows of the trajectory (and the columns `by`) before a row, each count's number of true rows, and each
    last's last value that is not null; and the counts over the whole trajectory as `<name>_total`. The result is `blocked`."""
    lasts = lasts or {}
    rows = blocked(messages, k).withColumns({f"_c_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in counts.items()} | {f"_l_{n}": c for n, c in lasts.items()})
    keys = [k.traj, *by]
    block = rows.groupBy(*keys, _B).agg(*(F.sum(f"_c_{n}").alias(f"_s_{n}") for n in counts), *(F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col(k.pos))).alias(f"_m_{n}") for n in lasts))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carried = block.select(
        *(F.col(c).alias(f"_k_{c}") for c in (*keys, _B)), *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in counts),
        *(F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in counts), *(F.last(f"_m_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}") for n in lasts),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, _B)]
    near = Window.partitionBy(*keys, _B).orderBy(k.pos).rowsBetween(Window.unboundedPreceding, -1)
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = rows.join(carried, on)
    out = out.withColumns(
        {n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_c_{n}").over(near), F.lit(0)) for n in counts} | {n: F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(near), F.col(f"_p_{n}")) for n in lasts}
    )
    return out.drop(*(f"_k_{c}" for c in (*keys, _B)), *(f"_c_{n}" for n in counts), *(f"_o_{n}" for n in counts), *(f"_l_{n}" for n in lasts), *(f"_p_{n}" for n in lasts))


def from_nested(trajectories: DataFrame, key: str, steps: str) -> DataFrame:
    """Long form of an array of steps: key, pos (from 0), and the step's fields."""
    return trajectories.select(key, F.posexplode(steps).alias("pos", "_s")).select(key, "pos", "_s.*")


def _chunked(messages: DataFrame, k: Keys) -> DataFrame:
    rows = with_before(messages, k, {"_a": k.is_role("assistant")})
    return rows.withColumn("chunk_id", F.col("_a").cast("int")).drop("_a", "_a_total")


def chunk(messages: DataFrame, k: Keys = K) -> DataFrame:
    """Adds chunk_id: a chunk ends with an assistant message; what follows the last one is a chunk too."""
    return unblocked(_chunked(messages, k))


def _with_tools(messages: DataFrame, k: Keys, **lasts: Column) -> DataFrame:
    """Adds _t, the tool messages before a row, and _t_total."""
    return with_before(messages, k, {"_t": k.is_role("tool")}, lasts)


def last_turns(messages: DataFrame, n: int, k: Keys = K) -> DataFrame:
    """The last n turns and whatever follows them. A turn ends with a tool message; with fewer than n all messages stay."""
    if n <= 0:
        return unblocked(messages.limit(0))
    return unblocked(_with_tools(messages, k).where(F.col("_t") >= F.col("_t_total") - n).drop("_t", "_t_total"))


def events(messages: DataFrame, content: str, calls: str, output: Column, k: Keys = K, masked: bool = False) -> DataFrame:
    """trajectory, event_no, event: the text of an assistant's action and the tool result after it.

    Text gathers over assistant messages until a tool message ends the event; other roles don't count, and a rest without a
    tool message is dropped. masked: the output is hidden and the last known arguments are shown, also of an earlier
    message; null where none are known yet.
    """
    call = F.try_element_at(F.col(calls), F.lit(1))
    text = F.coalesce(F.col(content), F.lit(""))
    rows = messages.where(k.is_role("assistant") | k.is_role("tool"))
    if masked:
        own = F.when(k.is_role("assistant"), call["arguments"])
        rows = _with_tools(rows, k, _known=own)
        action = F.concat(text, F.lit("\nTool: "), F.coalesce(own, F.col("_known")))
        shown = F.lit("\nEnvironment:\n[ENVIRONMENT OUTPUT MASKED]")
    else:
        rows = _with_tools(rows, k)
        action = F.when(F.size(calls) > 0, F.concat(text, F.lit("\nTool("), F.coalesce(call["name"], F.lit("tool")), F.lit("): "), F.coalesce(call["arguments"], F.lit("{}")))).otherwise(text)
        shown = F.concat(F.lit("\nEnvironment:\n"), output)
    piece = F.when(k.is_role("assistant"), action).otherwise(shown)
    parts = rows.where("_t < _t_total").select(k.traj, F.col("_t").cast("int").alias("event_no"), F.struct(F.col(k.pos).alias("p"), piece.alias("x")).alias("_p"))
    gathered = parts.groupBy(k.traj, "event_no").agg(F.array_sort(F.collect_list("_p")).alias("_l"))
    return gathered.select(k.traj, "event_no", F.aggregate("_l", F.lit(""), lambda a, p: F.concat(a, p["x"])).alias("event"))


def relabel(messages: DataFrame, cut: int | None = None, k: Keys = K) -> DataFrame:
    """Drops system messages; a user message right after an assistant one becomes a tool message named bash.

    With a cut, the messages before and from that raw position are relabelled apart: adds side (prefix or continuation) and
    new_role, tool_name. A missing role counts as user.
    """
    side = F.lit("prefix") if cut is None else F.when(F.col(k.pos) < cut, "prefix").otherwise("continuation")
    rows = messages.withColumn("side", side).withColumn("new_role", F.coalesce(F.col(k.role), F.lit("user"))).where("new_role <> 'system'")
    rows = with_before(rows, k, {}, {"_before": F.col("new_role")}, by=("side",))
    answer = (F.col("new_role") == "user") & (F.coalesce("_before", F.lit("")) == "assistant")
    rows = rows.withColumn("_a", answer)
    return unblocked(rows.withColumns({"new_role": F.when(F.col("_a"), "tool").otherwise(F.col("new_role")), "tool_name": F.when(F.col("_a"), "bash").otherwise("")}).drop("_a", "_before"))


def validate(messages: DataFrame, calls: str, call_id: str, k: Keys = K) -> DataFrame:
    """trajectory, ok, bad_pos, missing_ids: the first assistant message of which a call is not answered by the tool messages
    that follow it without a gap; bad_pos and missing_ids are null where all are answered."""
    ids = F.array_distinct(F.transform(F.filter(calls, lambda c: c.isNotNull() & c["id"].isNotNull()), lambda c: c["id"]))
    other = ~k.is_role("tool")
    rows = with_before(messages, k, {"_g": other}).withColumn("_g", F.col("_g") + other.cast("int"))
    per = rows.groupBy(k.traj, "_g").agg(
        F.max(F.when(k.is_role("assistant"), F.struct(F.col(k.pos).alias("p"), ids.alias("ids")))).alias("a"), F.collect_set(F.when(k.is_role("tool"), F.col(call_id))).alias("got")
    )
    wrong = per.select(k.traj, F.col("a.p").alias("p"), F.array_sort(F.array_except("a.ids", "got")).alias("m"))
    first = F.min(F.when(F.size("m") > 0, F.struct("p", "m")))
    return wrong.groupBy(k.traj).agg(first.alias("f")).select(k.traj, F.col("f").isNull().alias("ok"), F.col("f.p").alias("bad_pos"), F.col("f.m").alias("missing_ids"))


def chunk_ends(messages: DataFrame, k: Keys = K) -> DataFrame:
    """trajectory, chunk_id, end_len (messages up to the chunk's end), n_chunks, next_len (up to the next chunk's end, null at
    the last). The next chunk's end is brought by its own row, so that no trajectory is ordered in one task."""
    rows = with_before(messages, k, {"_a": k.is_role("assistant"), "_n": F.lit(1)})
    ends = rows.groupBy(k.traj, F.col("_a").cast("int").alias("chunk_id")).agg((F.max("_n") + 1).cast("int").alias("_e"))
    both = ends.select(k.traj, "chunk_id", F.col("_e").alias("end_len"), F.lit(None).cast("int").alias("next_len")).unionByName(ends.select(k.traj, (F.col("chunk_id") - 1).alias("chunk_id"), F.lit(None).cast("int").alias("end_len"), F.col("_e").alias("next_len")))
    met = both.groupBy(k.traj, "chunk_id").agg(F.max("end_len").alias("end_len"), F.max("next_len").alias("next_len")).where("chunk_id >= 0")
    total = met.groupBy(F.col(k.traj).alias("_t")).agg((F.max("chunk_id") + 1).cast("long").alias("n_chunks"))
    return met.join(total, F.col(k.traj).eqNullSafe(F.col("_t"))).drop("_t")


def branches(messages: DataFrame, n_rollouts: int = 1, max_points: int | None = None, sample_limit: int | None = None, seed_order: Column | None = None, k: Keys = K, margin: int = 5) -> DataFrame:
    """Branch points: trajectory, chunk_id, kind (before_init or after), rollout, start_index, n_messages.

    A chunk is eligible from `margin` on and below the sample limit less the margin (or the number of chunks less it). Each
    gives the messages up to its end without the last one, and per rollout those up to the next chunk's end without the
    last. max_points: so many per trajectory, those that come first in `seed_order`. Messages are not copied: a branch is a
    prefix length, to be sliced when it is needed.
    """
    upper = F.lit(sample_limit - margin) if sample_limit is not None else F.col("n_chunks") - margin
    points = chunk_ends(messages, k).where((F.col("chunk_id") >= margin) & (F.col("chunk_id") < upper))
    if max_points is not None:
        order = seed_order if seed_order is not None else F.md5(F.concat_ws(":", k.traj, "chunk_id"))
        points = points.withColumn("_r", F.row_number().over(Window.partitionBy(k.traj).orderBy(order, "chunk_id"))).where(F.col("_r") <= max_points).drop("_r")
    init = points.select(k.traj, "chunk_id", F.lit("before_init").alias("kind"), F.lit(0).alias("rollout"), F.col("chunk_id").alias("start_index"), (F.col("end_len") - 1).alias("n_messages"))
    if n_rollouts <= 0:
        return init
    after = points.where("next_len IS NOT NULL").select(
        k.traj, "chunk_id", F.lit("after").alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(n_rollouts - 1))).alias("rollout"), (F.col("chunk_id") + 1).alias("start_index"), (F.col("next_len") - 1).alias("n_messages")
    )
    return init.unionByName(after)


def prefix_at(messages: DataFrame, step: int, k: Keys = K) -> DataFrame:
    """The messages of the chunks up to `step` without the last one; none of trajectories with too few chunks."""
    rows = _chunked(messages, k)
    last = rows.groupBy(F.col(k.traj).alias("_t")).agg(F.max(F.when(F.col("chunk_id") <= step, F.col(k.pos))).alias("_last"), F.max("chunk_id").alias("_m")).where(F.col("_m") >= step)
    kept = rows.where(F.col("chunk_id") <= step).join(last, F.col(k.traj).eqNullSafe(F.col("_t"))).where(F.col(k.pos) < F.col("_last"))
    return unblocked(kept.drop("_t", "_last", "_m", "chunk_id"))


def cut_at(messages: DataFrame, at: int, k: Keys = K) -> tuple[DataFrame, DataFrame]:
    """(before, from) the position."""
    rows = unblocked(messages)
    return rows.where(F.col(k.pos) < at), rows.where(F.col(k.pos) >= at)


def middle(messages: DataFrame, keep_first: int, n_turns: int, k: Keys = K) -> DataFrame:
    """The messages between the first `keep_first` and the last n turns (everything after the first where n is 0)."""
    rows = with_before(messages, k, {"_n": F.lit(1), "_t": k.is_role("tool")}).where(F.col("_n") >= keep_first)
    if n_turns > 0:
        rows = rows.where(F.col("_t") < F.col("_t_total") - n_turns)
    return unblocked(rows.drop("_n", "_t", "_n_total", "_t_total"))


def z_context(messages: DataFrame, summaries: DataFrame, content: str, max_size: int = 20, keep_first: int = 4, k: Keys = K) -> DataFrame:
    """trajectory, part, pos, role, content: the first messages, the summary as a user message, and the last turns.

    The parts may overlap; a message in both is there twice. summaries: trajectory, summary.
    """
    n_turns = (max_size // 2 - keep_first) // 2
    cols = [k.traj, k.pos, k.role, content]
    first = messages.withColumn("_n", F.row_number().over(Window.partitionBy(k.traj).orderBy(k.pos))).where(F.col("_n") <= keep_first).select(F.lit(0).alias("part"), *cols)  # cut to so many before the shuffle
    told = summaries.select(F.lit(1).alias("part"), k.traj, F.lit(0).alias(k.pos), F.lit("user").alias(k.role), F.concat(F.lit("<summary>\n"), F.coalesce("summary", F.lit("")), F.lit("\n</summary>")).alias(content))
    last = last_turns(messages, n_turns, k).select(F.lit(2).alias("part"), *cols)
    return first.unionByName(told).unionByName(last)


def x_context(messages: DataFrame) -> DataFrame:
    """The context a summary is measured against: the messages as they are."""
    return unblocked(messages)


def task_of(messages: DataFrame, content: str, k: Keys = K) -> DataFrame:
    """trajectory, task: of the first user message what stands in <pr_description>, else the whole; '' without one."""
    first = messages.groupBy(k.traj).agg(F.min_by(F.when(k.is_role("user"), F.coalesce(content, F.lit(""))), F.when(k.is_role("user"), F.col(k.pos))).alias("t"))
    from wakeline.functions.text import strip

    inner = r"(?s)<pr_description>(.*?)</pr_description>"
    t = F.coalesce("t", F.lit(""))
    return first.select(k.traj, strip(F.when(F.regexp_like(t, F.lit(inner)), F.regexp_extract(t, inner, 1)).otherwise(t)).alias("task"))


def with_prefix(trajectories: DataFrame, n: Column, steps: str = "steps", continuation: str = "continuation") -> DataFrame:
    """Moves the steps from n on to the front of the continuation. Negative n count from the end; null lists count as empty."""
    kind = trajectories.schema[steps].dataType
    s, c = (F.coalesce(F.col(x), F.array().cast(kind)) for x in (steps, continuation))
    size = F.size(s)
    at = F.least(size, F.greatest(F.lit(0), F.when(n < 0, size + n).otherwise(n)))
    return trajectories.withColumns({steps: F.slice(s, F.lit(1), at), continuation: F.concat(F.slice(s, at + 1, F.greatest(size - at, F.lit(0))), c)})


def continuation_delta(full: Column, context: Column) -> Column:
    """What the full text has beyond the length of the context's text."""
    return F.substr(full, F.length(context) + 1, F.greatest(F.length(full) - F.length(context), F.lit(0)))


def describe(messages: DataFrame, content: str, k: Keys = K) -> DataFrame:
    """trajectory, n_messages, n_chunks, n_turns, n_lines, n_chars."""
    c = F.coalesce(F.col(content), F.lit(""))
    return _chunked(messages, k).groupBy(k.traj).agg(
        F.count("*").alias("n_messages"), (F.max("chunk_id") + 1).cast("long").alias("n_chunks"), F.sum(k.is_role("tool").cast("long")).alias("n_turns"),
        F.sum((F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")).alias("n_lines"), F.sum(F.length(c).cast("long")).alias("n_chars"),
    )
