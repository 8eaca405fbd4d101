"""Whole values of JSON texts, for callers that want a tree and not triples."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null))')


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None):
    """(True, value) of a complete JSON text, else (False, None). Depth is bounded by memory only."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text.lstrip("﻿"), parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text.lstrip("﻿"))
    except ValueError:
        return False, None


def _parse_deep(text: str):
    """`parse` with a stack of its own, for texts nested too deeply for the standard parser."""
    at, end, stack, keys, root = 0, len(text.rstrip(" \t\n\r")), [], [], []
    stack.append(root)
    keys.append(None)
    state = "value"
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            return False, None
        at = m.end()
        mark, string, plain = m.groups()
        top = stack[-1]
        if state in ("value", "value-or-end") and mark not in (",", ":", "}") and not (mark == "]" and state == "value"):
            if mark == "]":
                stack.pop()
                keys.pop()
                state = "after"
                continue
            value = {} if mark == "{" else [] if mark == "[" else json.loads(string or plain)
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            if mark:
                stack.append(value)
                keys.append(None)
                state = "key-or-end" if mark == "{" else "value-or-end"
            else:
                state = "after"
        elif state in ("key", "key-or-end") and string:
            keys[-1], state = json.loads(string), "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "after" and mark == "," and len(stack) > 1:
            state = "key" if isinstance(top, dict) else "value"
        elif mark in ("}", "]") and len(stack) > 1 and state in ("after", "key-or-end") and (mark == "}") == isinstance(top, dict):
            stack.pop()
            keys.pop()
            state = "after"
        else:
            return False, None
    return (True, root[0]) if state == "after" and len(stack) == 1 and len(root) == 1 else (False, None)


def leaves(value) -> Iterator[tuple[str, object]]:
    """(path, leaf) of a JSON value; a leaf is a scalar, null, `{}` or `[]`. Order: as written."""
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            stack += [(f"{path}[{i}]", v[i]) for i in range(len(v) - 1, -1, -1)]
        else:
            yield path, v
