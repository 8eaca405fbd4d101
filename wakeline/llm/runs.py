"""Problem 4: runs of repeated consecutive events.

Boundary interval lookup: an event whose key differs from the one before starts a run; the sorted starts of a chunk of an
entity are looked up by binary search to give each event its run, and runs are aggregated.

An entity's positions are cut into chunks of CHUNK, so that an entity with a third of all rows is spread over tasks. A
chunk is sorted by the shuffle and streamed through Arrow, one open run being carried from batch to batch. Runs inside a
chunk are final; the first and last run of each chunk go on to a second pass per entity (at most two rows a chunk), where
runs that cross chunks are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
_EMPTY_LOW, _EMPTY_HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_PIECES = "entity string, part long, f long, l long, n long, t0 long, t1 long, h1 long, h2 long, done boolean"

#: Parts of an event that change from try to try: generated names and ids, clock stamps, running counters (group 1 stays).
VOLATILE = "|".join([
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"\b\d{4}-\d\d-\d\d(?:[t _]\d\d[:.-]?\d\d(?:[:.-]?\d\d)?(?:[.,]\d+)?(?:z|[+-]\d\d:?\d\d)?)?(?![\d-])",
    r"(?<![0-9])\d{8}[_t-]\d{4}(?:\d\d)?z?(?![0-9])",
    r"(?<![0-9:])\d{1,2}:\d\d:\d\d(?:[.,]\d+)?(?![0-9:])",
    r"\btmp[._-]?(?:[0-9a-f]{6,}|(?=[a-z_]*\d)[0-9a-z_]{6,})\b",
    r"\b\d{10,}\b",
    r"(\b(?:request|trace|span|session|correlation)[_-]?id\W{0,6})[\w-]+",
    r"((?<![a-z0-9])(?:retry|retries|attempt|try|check|poll|pid|iteration|round|tick|heartbeat|nonce)(?:[ \t=:_-]|no\.|number){0,8}#?)\d+",
    r"\b\d+(?:\.\d+)?(?=\s*(?:ms|s|secs?|seconds?|m|mins?|minutes?|h|hours?)\s+(?:elapsed|passed|gone|so far)\b)",
])
_QUIET = r"""\\[nrtfbv]|[\s"'`\\\u200b\u2018\u2019\u201c\u201d\u00ab\u00bb\u00a0\u3000]"""


def canonical_text(text: Column) -> Column:
    """Text without letter case, spacing, quote style and volatile parts; null counts as empty."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), VOLATILE, "$1$2\u00a4")
    return F.regexp_replace(t, _QUIET, "")


def canonical_json(text: Column) -> Column:
    """`canonical_text` of JSON with its keys sorted at every level; text that is not JSON counts as it stands, null as {}."""
    low = F.lower(F.coalesce(text, F.lit("{}")))
    return canonical_text(F.coalesce(F.to_json(F.try_parse_json(low)), low))


def event_key(content: Column, calls: Column) -> Column:
    """What has to agree for two steps to repeat each other: with calls their names and arguments, without the content."""
    there = F.filter(calls, lambda c: c.isNotNull())
    shown = F.transform(there, lambda c: F.concat(F.lower(F.trim(F.coalesce(c["name"], F.lit("")))), F.lit("("), canonical_json(c["arguments"]), F.lit(")")))
    return F.when(F.size(there) > 0, F.concat(F.lit("c:"), F.array_join(shown, "\n"))).otherwise(F.concat(F.lit("t:"), canonical_text(content)))


def _rows(table: pa.Table) -> dict[str, np.ndarray | pa.Array]:
    cols = {c: table.column(c).combine_chunks() for c in table.column_names}
    return {c: v if c == "entity" else v.to_numpy(zero_copy_only=False) for c, v in cols.items()}


def _collapse(last_pass: bool, chunk: int):
    """Streams pieces sorted by (entity, part, f) and joins neighbours of one part with equal keys; in the last pass only those
    of different chunks, as between two of the same chunk others were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, carried, carried_first = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or batch.schema
            table = pa.Table.from_batches([batch])
            if carried is not None:
                table = pa.concat_tables([carried, table])
            out, carried, carried_first = _step(table, carried is not None, carried_first, last_pass, chunk)
            if out is not None and out.num_rows:
                yield from out.combine_chunks().to_batches()
        if carried is not None:
            done = True if last_pass else carried.column("done")[0].as_py()
            yield from carried.set_column(carried.schema.get_field_index("done"), schema.field("done"), pa.array([done])).to_batches()

    return run


def _step(table: pa.Table, goes_on: bool, first_open: bool, last_pass: bool, chunk: int):
    x = _rows(table)
    n = table.num_rows
    entity = x["entity"]
    group = np.ones(n, bool)
    group[1:] = pc.fill_null(pc.not_equal(entity[1:], entity[:-1]), True).to_numpy(zero_copy_only=False) | (x["part"][1:] != x["part"][:-1])
    again = np.zeros(n, bool)  # a position delivered again; the first delivery counts
    again[1:] = ~group[1:] & (x["f"][1:] <= x["l"][:-1])
    if again.any():
        keep = np.flatnonzero(~again)
        return _step(table.take(pa.array(keep)), goes_on, first_open, last_pass, chunk)
    start = group.copy()
    start[1:] |= (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1]) | x["done"][1:]
    if last_pass:
        start[1:] |= x["f"][1:] // chunk == x["l"][:-1] // chunk
    starts = np.flatnonzero(start)
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]), n - 1)
    first = group[starts]
    if goes_on:
        first[0] = first_open
    last = np.append(first[1:], False)
    if goes_on and len(first) > 1:
        last[:-1] = group[starts][1:]
    done = x["done"][starts] | ((~first & ~last) if not last_pass else True)
    made = {
        "entity": entity.take(pa.array(starts)), "part": x["part"][starts], "f": x["f"][starts], "l": np.maximum.reduceat(x["l"], starts),
        "n": np.add.reduceat(x["n"], starts), "t0": np.minimum.reduceat(x["t0"], starts), "t1": np.maximum.reduceat(x["t1"], starts),
        "h1": x["h1"][ends], "h2": x["h2"][ends], "done": done,
    }
    pieces = pa.table([pa.array(made[f.name], f.type) for f in table.schema], schema=table.schema)
    k = len(starts) - 1
    closed = pieces.slice(0, k)
    closed = closed.filter(pa.array((~done[:k]) | (made["n"][:k] > 1)))
    carried = pieces.slice(k).set_column(pieces.schema.get_field_index("done"), table.schema.field("done"), pa.array([bool(x["done"][starts[k]])]))
    return closed, carried, bool(first[k])


def runs(events: DataFrame, entity: str, pos: str, key: Column, at: str | None = None, arrived: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The longest stretches of two or more consecutive events of an entity with equal keys.

    Result: entity string, first_pos, last_pos, n (events), started, ended (timestamps), duration_s (null where no event
    has a time). Rows of a null entity, position or key are left out. A position delivered again counts once, by the
    earliest `arrived`. Empty input gives an empty result. Other columns are not read.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(None).cast("long")
    p = F.col(pos).cast("long")
    rows = events.select(
        F.col(entity).cast("string").alias("entity"), F.floor(p / chunk).cast("long").alias("part"), p.alias("f"), p.alias("l"), F.lit(1).cast("long").alias("n"),
        F.coalesce(micros, F.lit(int(_EMPTY_LOW))).alias("t0"), F.coalesce(micros, F.lit(int(_EMPTY_HIGH))).alias("t1"),
        key.alias("_key"), (F.unix_micros(F.col(arrived).cast("timestamp")) if arrived else F.lit(0).cast("long")).alias("_arrived"),
    ).where(F.col("entity").isNotNull() & F.col("f").isNotNull() & F.col("_key").isNotNull())
    rows = rows.select("entity", "part", "f", "l", "n", "t0", "t1", F.xxhash64(F.lit(1), "_key").alias("h1"), F.xxhash64(F.lit(2), "_key").alias("h2"), F.lit(False).alias("done"), "_arrived")
    once = rows.repartition("entity", "part").sortWithinPartitions("entity", "part", "f", F.col("_arrived").asc_nulls_last()).drop("_arrived")
    inside = once.mapInArrow(_collapse(False, chunk), _PIECES)
    inside = inside.withColumn("part", F.when(F.col("done"), F.col("part")).otherwise(F.lit(-1).cast("long")))
    joined = inside.repartition("entity", "part").sortWithinPartitions("entity", "part", "f").mapInArrow(_collapse(True, chunk), _PIECES)
    timed = F.col("t0") != int(_EMPTY_LOW)
    return joined.where(F.col("n") > 1).select(
        "entity", F.col("f").alias("first_pos"), F.col("l").alias("last_pos"), "n",
        F.when(timed, F.timestamp_micros("t0")).alias("started"), F.when(timed, F.timestamp_micros("t1")).alias("ended"),
        F.when(timed, (F.col("t1") - F.col("t0")) / 1e6).alias("duration_s"),
    )


def step_runs(steps: DataFrame) -> DataFrame:
    """`runs` of the assistant steps of `agent_steps`-like rows: run_id, first_pos, last_pos (int), n, started, ended, duration_s."""
    own = steps.select("run_id", "pos", "content", "tool_calls", "happened_at", "arrived_at", F.col("role").alias("role")).where(F.col("role") == "assistant")
    found = runs(own, "run_id", "pos", event_key(F.col("content"), F.col("tool_calls")), "happened_at", "arrived_at")
    return found.select(F.col("entity").alias("run_id"), F.col("first_pos").cast("int").alias("first_pos"), F.col("last_pos").cast("int").alias("last_pos"), "n", "started", "ended", "duration_s")
