"""Unified diffs: reversing them, and the command that applies them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format.
HUNK = re.compile(r"@@ -(?P<old>\d+(?:,\d+)?),? \+(?P<new>\d+(?:,\d+)?),? @@")
INDEX = re.compile(r"index (?P<old>[a-f0-9]+)\.\.(?P<new>[a-f0-9]+)")
NO_NEWLINE = "\\ No newline at end of file"
_OPPOSITE = {"-": "+", "+": "-"}
_ESCAPE = re.compile(r"\\(?:([ntrfvab'\"\\])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|([0-7]{1,3}))")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b"}


class Line(NamedTuple):
    """A line of a hunk: its sign (a blank for lines that stay), its text, and whether no line break follows it."""

    sign: str
    text: str
    bare: bool


def unescaped(text: str) -> str:
    """The text that a quoted text with escapes stands for; other characters and unknown escapes stay as they are."""
    code = lambda m: _ESCAPED.get(m[1], m[1]) if m[1] else chr(int(m[2] or m[3], 16) if m[2] or m[3] else int(m[4], 8))
    return _ESCAPE.sub(code, text)


def _records(lines: list[str]) -> list[Line]:
    out: list[Line] = []
    for line in lines:
        if line.startswith("\\") and out and out[-1].sign in _OPPOSITE:
            out[-1] = out[-1]._replace(bare=True)
        elif line[:1] in _OPPOSITE:
            out.append(Line(line[0], line[1:], False))
        else:
            out.append(Line(" ", line, False))
    return out


def _undone(lines: list[str]) -> Iterator[str]:
    """The lines of a hunk that undoes one. What was added in a change is removed first, then what was removed is added; a
    change ends where a removal follows an addition or with a line that stays."""
    gone: list[str] = []  # was removed in this change, and is added again

    def written(record: Line) -> list[str]:
        return [_OPPOSITE[record.sign] + record.text] + ([NO_NEWLINE] if record.bare else [])

    before = " "
    for record in _records(lines):
        if record.sign == "-" and before == "+" or record.sign == " ":
            yield from gone
            gone = []
        if record.sign == "-":
            gone += written(record)
        else:
            yield from [record.text] if record.sign == " " else written(record)
        before = record.sign
    yield from gone


def reverse_diff(text: str | None) -> str | None:
    """The diff that undoes a diff: index hashes, line ranges and changes are exchanged, file headers stay as they are.

    A text on one line whose line breaks are written as backslash n, in quotes or not, is read as if they were line breaks.
    """
    if text is None:
        return None
    bare = text.strip("'\"")
    if "\n" not in bare and "\\n" in bare:
        text = unescaped(bare)
    out: list[str] = []
    body: list[str] = []
    in_hunk = False
    for line in [*text.split("\n"), None]:
        if in_hunk and line is not None and not line.startswith(("@@", "diff ")):
            body.append(line)
            continue
        out += _undone(body)
        body, in_hunk = [], line is not None and line.startswith("@@")
        if line is None:
            break
        header = (HUNK if in_hunk else INDEX).match(line)
        if header:
            form = "@@ -{new} +{old} @@" if in_hunk else "index {new}..{old}"
            line = form.format(**header.groupdict()) + line[header.end() :]
        out.append(line)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def reversed_diff(texts: pd.Series) -> pd.Series:
    return texts.map(reverse_diff, na_action="ignore")


def apply_command(patch: Column) -> Column:
    """The shell command that applies a patch given in place; the mark around it is hashed from the patch. Null for a null."""
    mark = F.concat(F.lit("PATCH_"), F.md5(patch))
    return F.concat(F.lit("git apply --verbose <<'"), mark, F.lit("'\n"), patch, F.lit("\n"), mark)
