"""Rendering trajectories to text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.names import fresh

#: The prompt and the template that summaries are asked for with.
SYSTEM_PROMPT = (
    "You are an expert at tracking and summarizing the progress of coding agents. "
    "You will be shown a task description followed by a partial sequence of agent "
    "actions and tool observations — the agent has not yet finished. "
    "Produce a concise summary of what the agent has done so far: "
    "which files it has read or modified, what it has discovered, "
    "what approaches it has tried, and what state it has left things in. "
    "Do not speculate about what it will do next."
)
PROMPT_HEAD = "Here are the past events so far.\n<TASK>\n"
PROMPT_TAIL = (
    "\nSummarize the above to assist the agent in understanding its current state.\n"
    "Suggest next steps clearly and concisely.\n"
    "A good summary enables the agent to effectively choose its next actions.\n"
    "Focus on key decisions, actions taken, and their outcomes.\n\n"
    "Your summary will be directly provided to the agent to help it decide its next actions."
)


def _dump(text: str | None, indent: int | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return "{}" if indent and value in ({}, None) else json.dumps(value, indent=indent)


@F.pandas_udf(T.StringType())
def json_line(texts: pd.Series) -> pd.Series:
    """JSON text with a blank after commas and colons and non-ASCII characters escaped; text that is no JSON as it is."""
    return texts.map(lambda t: _dump(t, None), na_action="ignore")


@F.pandas_udf(T.StringType())
def json_block(texts: pd.Series) -> pd.Series:
    """JSON text indented by two; `{}` for an empty object."""
    return texts.map(lambda t: _dump(t, 2), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def json_blocks(texts: pd.Series) -> pd.Series:
    """`json_block` of a list of lists of texts."""
    return texts.map(lambda rows: [[_dump(t if t is not None else "{}", 2) for t in (r if r is not None else [])] for r in rows], na_action="ignore")


@F.pandas_udf(T.StringType())
def quoted(texts: pd.Series) -> pd.Series:
    """A name in the quotes that Python shows it in."""
    return texts.map(repr, na_action="ignore")


def _quote(s: Column) -> Column:
    """`quoted` for names without quotes and escapes, which need no Python."""
    return F.concat(F.lit("'"), s, F.lit("'"))


def _step(step: Column, index: Column, blocks: Column) -> Column:
    """Text of one step; index from 1; blocks: the arguments of its calls."""
    head = lambda label: F.concat(F.lit("[Step "), index.cast("string"), F.lit(" — "), label, F.lit("]"))
    content = F.coalesce(step["content"], F.lit(""))
    calls = F.transform(
        F.coalesce(step["tool_calls"], F.array().cast("array<struct<name:string,arguments:string,id:string>>")),
        lambda c, i: F.concat(F.lit("<tool_call name="), _quote(F.coalesce(c["name"], F.lit(""))), F.lit(">\n"), F.coalesce(F.get(blocks, i), F.lit("{}")), F.lit("\n</tool_call>")),
    )
    said = F.concat_ws("\n", head(F.lit("assistant")), F.when(content != "", content), F.array_join(F.when(F.size(calls) > 0, calls), "\n"))
    name = F.when(F.coalesce(step["name"], F.lit("")) != "", step["name"]).otherwise(F.lit("tool"))
    return F.when(step["role"] == "assistant", said).when(step["role"] == "tool", F.concat_ws("\n", head(F.concat(name, F.lit(" result"))), content)).otherwise(F.concat_ws("\n", head(F.coalesce(step["role"], F.lit("user"))), content))


def trajectory_text(trajectories: DataFrame, steps: str = "steps", task: str = "task", name: str = "text") -> DataFrame:
    """Adds the task, a line with the number of steps, and every step, with blank lines between, as one text. Arguments are
    JSON texts; only they go through Python. Null steps count as none, a null task as ''."""
    s, blocks = fresh([*trajectories.columns, name], "_steps", "_blocks")
    rows = trajectories.withColumn(s, F.coalesce(F.col(steps), F.array().cast(trajectories.schema[steps].dataType)))
    rows = rows.withColumn(blocks, json_blocks(F.transform(s, lambda x: F.transform(x["tool_calls"], lambda c: c["arguments"]))))
    parts = F.transform(s, lambda x, i: _step(x, i + 1, F.get(blocks, i)))
    top = F.array(F.concat(F.lit("[Task]\n"), F.coalesce(F.col(task), F.lit(""))), F.concat(F.lit("[Partial Trajectory — "), F.size(s).cast("string"), F.lit(" step(s) so far]")))
    return rows.withColumn(name, F.array_join(F.concat(top, parts), "\n\n")).drop(s, blocks)


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def conversation(text: Column, summary: Column | None = None, system: str = SYSTEM_PROMPT) -> Column:
    """System prompt, rendered text and, for training, the summary, as an array of (role, content)."""
    return F.array(_turn("system", F.lit(system)), _turn("user", text), *([_turn("assistant", summary)] if summary is not None else []))


def messages(steps: Column, task: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System, user and the steps as an array of (role, content, calls); calls as (name, arguments), none for other roles
    than assistant."""
    none = F.array().cast("array<struct<name:string,arguments:string>>")
    made = lambda role, content, calls: F.struct(role.alias("role"), content.alias("content"), calls.alias("calls"))
    own = F.transform(steps, lambda s: made(s["role"], F.coalesce(s["content"], F.lit("")), F.when(s["role"] == "assistant", F.coalesce(F.transform(s["tool_calls"], lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))), none)).otherwise(none)))
    return F.concat(F.array(made(F.lit("system"), F.lit(system), none), made(F.lit("user"), task, none)), own)


def summary_prompt(task: Column, events: Column, previous: Column | None = None) -> Column:
    """The prompt that asks for a summary of events, with the summaries so far."""
    boxed = lambda xs, tag: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(f"\n<{tag}>\n"), x, F.lit(f"\n</{tag}>\n"))), "")
    before = boxed(previous, "PREVIOUS SUMMARY") if previous is not None else F.lit("")
    return F.concat(F.lit(PROMPT_HEAD), task, F.lit("\n</TASK>\n"), F.coalesce(before, F.lit("")), F.coalesce(boxed(events, "EVENT"), F.lit("")), F.lit(PROMPT_TAIL))
