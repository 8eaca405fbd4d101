"""A chainable view of trajectories in long form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import diff, render
from wakeline.functions.text import truncate_middle
from wakeline.operators import scoring, sequence


class Trajectories:
    """Messages, one per row. Each method gives a DataFrame or another view and computes nothing by itself."""

    def __init__(self, messages: DataFrame, keys: sequence.Keys = sequence.K, content: str = "content", calls: str = "tool_calls") -> None:
        self.messages, self.keys, self.content, self.calls = messages, keys, content, calls

    def _view(self, messages: DataFrame) -> Trajectories:
        return Trajectories(messages, self.keys, self.content, self.calls)

    def once(self, arrived: str) -> Trajectories:
        return self._view(sequence.once(self.messages, arrived, self.keys))

    def where(self, condition: str | Column) -> Trajectories:
        return self._view(self.messages.where(condition))

    def chunks(self) -> DataFrame:
        return sequence.chunk(self.messages, self.keys)

    def last_turns(self, n: int) -> Trajectories:
        return self._view(sequence.last_turns(self.messages, n, self.keys))

    def middle(self, keep_first: int, n_turns: int) -> Trajectories:
        return self._view(sequence.middle(self.messages, keep_first, n_turns, self.keys))

    def prefix_at(self, step: int) -> Trajectories:
        return self._view(sequence.prefix_at(self.messages, step, self.keys))

    def relabel(self, cut: int | None = None) -> DataFrame:
        return sequence.relabel(self.messages, cut, self.keys)

    def events(self, masked: bool = False, limit: int = 5000, raw_output: Column | str | None = None) -> DataFrame:
        """raw_output: what tools gave, where it is kept beside the content (such as `extra.raw_output`); it goes before it."""
        said = F.coalesce(self.content, F.lit(""))
        output = truncate_middle(said if raw_output is None else F.coalesce(F.col(raw_output) if isinstance(raw_output, str) else raw_output, said), limit)
        return sequence.events(self.messages, self.content, self.calls, output, self.keys, masked)

    def validate(self, call_id: str = "tool_call_id") -> DataFrame:
        return sequence.validate(self.messages, self.calls, call_id, self.keys)

    def branches(self, n_rollouts: int = 1, max_points: int | None = None, sample_limit: int | None = None) -> DataFrame:
        return sequence.branches(self.messages, n_rollouts, max_points, sample_limit, k=self.keys)

    def tasks(self) -> DataFrame:
        return sequence.task_of(self.messages, self.content, self.keys)

    def z_context(self, summaries: DataFrame, max_size: int = 20, keep_first: int = 4) -> DataFrame:
        return sequence.z_context(self.messages, summaries, self.content, max_size, keep_first, self.keys)

    def entities(self, name: str = "name") -> DataFrame:
        return scoring.step_entities(sequence.unblocked(self.messages), self.keys.traj, name, self.calls)

    def describe(self) -> DataFrame:
        return sequence.describe(self.messages, self.content, self.keys)

    def prompts(self, masked: bool = False) -> DataFrame:
        """trajectory, prompt: what asks for a summary of each trajectory's events."""
        key = self.keys.traj
        listed = self.events(masked).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("event_no", "event"))).alias("_e"))
        return listed.join(self.tasks(), key).select(key, render.summary_prompt(F.col("task"), F.transform("_e", lambda x: x["event"])).alias("prompt"))


def register_functions(spark: SparkSession) -> None:
    """Makes the functions that need Python callable from SQL: json_line, json_block, quoted, reverse_diff."""
    for name, f in {"json_line": render.json_line, "json_block": render.json_block, "quoted": render.quoted, "reverse_diff": diff.reversed_diff}.items():
        spark.udf.register(name, f)


Reward = Callable[..., Column | DataFrame]
REWARDS: dict[str, Reward] = {"distortion": scoring.distortion_reward, "coverage": scoring.coverage, "partial_score": scoring.partial_score}


def reward(name: str) -> Reward:
    """A reward by name; others are added to REWARDS."""
    if name not in REWARDS:
        raise KeyError(f"unknown reward {name!r}; known: {', '.join(sorted(REWARDS))}")
    return REWARDS[name]
