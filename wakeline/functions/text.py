"""String functions. White space is Unicode white space, as Java's `\\s` and Spark's trim know only ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\xa0  -     　]"


#: The characters of WS, one by one: trimming by a set of characters is linear, which a pattern at the end of a text is not.
WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WS_CHARS))


def is_blank(s: Column) -> Column:
    return F.coalesce(strip(s) == "", F.lit(True))


def word_count(s: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(s, f"{WS}+"), lambda t: t != ""))


def basename(s: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(s, "/"), -1)


def truncate_middle(s: Column, limit: int = 5000) -> Column:
    """Texts above the limit as their two halves around a mark."""
    half = limit // 2
    return F.when(F.length(s) > limit, F.concat(F.left(s, F.lit(half)), F.lit("\n...[truncated]..."), F.right(s, F.lit(half)))).otherwise(s)


def remove_prefix(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), F.substr(s, F.lit(len(prefix) + 1))).otherwise(s)


def rstrip_slashes(s: Column) -> Column:
    return F.rtrim(s, F.lit("/"))


def section(s: Column, start: str, end: str) -> Column:
    """The text between two marks; the whole text where either is missing."""
    a, b = F.instr(s, start), F.instr(s, end)
    inner = F.substr(s, a + len(start), F.greatest(b - a - len(start), F.lit(0)))
    return F.when((a == 0) | (b == 0), s).otherwise(inner)


def section_by_find(s: Column, start: str, end: str) -> Column:
    """The text between two marks as slices by find positions give it, where a mark that is missing has position -1: counted
    from the end, so a missing end costs the last character, and a missing start mostly gives ''."""
    n = F.length(s)
    wrap = lambda p: F.least(n, F.greatest(F.lit(0), F.when(p < 0, n + p).otherwise(p)))
    a, b = wrap(F.instr(s, start) - 1), wrap(F.instr(s, end) - 1)
    cut = F.substr(s, a + 1, F.greatest(b - a, F.lit(0)))
    return F.substr(cut, F.lit(len(start) + 1))


def matches_start(s: Column, pattern: str) -> Column:
    """Whether the pattern matches at the start, not necessarily to the end."""
    return F.regexp_like(s, F.lit(f"^(?:{pattern})"))


def floor_div(a: Column, b: Column) -> Column:
    """Division rounded towards minus infinity."""
    return F.floor(a / b).cast("long")


def step_label(n: Column, cost: Column) -> Column:
    return F.format_string("Step %3d ($%.2f)", n, cost)


def batch_label(n: Column) -> Column:
    return F.lpad(n.cast("string"), 6, "0")


def key_hash(*cols: Column) -> Column:
    """A number in [0, 2^28) from the text of the columns joined by colons; the same in any engine that has md5."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *cols)), F.lit(1), F.lit(7)), 16, 10).cast("long")
