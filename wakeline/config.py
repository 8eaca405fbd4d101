"""Merging configurations."""

from __future__ import annotations

import os
from collections.abc import Mapping

UNSET = object()


def merge(*specs: Mapping) -> dict:
    """The specs merged from left to right, nested mappings key by key; values that are UNSET change nothing."""
    out: dict = {}
    for spec in specs:
        for key, value in spec.items():
            if value is UNSET:
                continue
            out[key] = merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else merge(value) if isinstance(value, Mapping) else value
    return out


def parse_assignments(items: list[str]) -> dict:
    """`a.b=1` and the like as a nested mapping of texts."""
    out: dict = {}
    for item in items:
        path, _, value = item.partition("=")
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def from_environment(**defaults: str) -> dict[str, str]:
    """Settings named like environment variables, from the environment or else by default."""
    return {k: os.environ.get(k, v) for k, v in defaults.items()}
