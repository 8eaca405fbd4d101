"""Problem 1: flat tables from deeply nested records.

Each JSON text is read once, token by token, into path-value-ordinal triples; no tree of it is built. The group of a triple is
the path of its innermost repeated ancestor (`steps[].tool_calls[]`), its ordinals are the positions in the lists on the way,
and its path starts at the list's element. So (record key, group, ordinals) identifies a row and the ordinals without the last
one identify its parent, whatever the records look like. The triples of one row leave the parser together, as a map from path to
value; a table is then one group with some of its paths pivoted to columns (`pivot`). Nothing is shuffled: all triples of a
record come from one text.

`Rules` tell the reader of a schema's exceptions: subtrees whose paths are data (`OPEN`, tool-call arguments), of which each
leaf becomes a row; objects that stand for a list of one (`ONE`); parts of which the JSON text is wanted too (`TEXT`).
`TRAJECTORY` are those of the trajectory records; without rules any JSON is shredded by its lists alone. What the tables of
records, steps, calls and arguments have no column for comes out in `further` and `repeated`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.names import fresh
from wakeline.operators.json_tree import _parse_deep, leaves, parse  # noqa: F401

SIDES = ("steps", "continuation")
RECORD_FIELDS = ("trajectory_id", "task", "summary", "metadata")
STEP_FIELDS = ("role", "content", "tool_call_id", "name")
FURTHER = "+"
ENVELOPE = "(envelope)"
TRIPLES = "record_key {key}, grp string, ordinals array<int>, fields map<string,string>"
OPEN, ONE, TEXT = "open", "one", "text"
#: By key: what to do with a container there, and the rules for what is in it; those of a list are for each of its elements.
Rules = Mapping[str, tuple[str | None, "Rules | None"]]
#: (group, ordinals, path below the group's element, kind, value). An element that is a container has a triple without a path; the
#: text of a container that a rule asks for has its kind and text.
Triple = tuple[str, tuple[int, ...], str | None, str, str | None]

_NO_RULE: tuple[None, None] = (None, None)
_FUNCTION: Rules = {"name": (TEXT, None), "arguments": (OPEN, None)}
_CALL: Rules = {"name": (TEXT, None), "id": (TEXT, None), "arguments": (OPEN, None), "function": (None, _FUNCTION)}
_STEP: Rules = {**dict.fromkeys(STEP_FIELDS, (TEXT, None)), "tool_calls": (ONE, _CALL)}
TRAJECTORY: Rules = {**dict.fromkeys(RECORD_FIELDS, (TEXT, None)), **dict.fromkeys(SIDES, (None, _STEP))}
#: The same below the key `record` of an envelope.
ENVELOPED: Rules = {**TRAJECTORY, "record": (None, TRAJECTORY)}
_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"([ \t\n\r]*+:)?|([\[{])|([\]}])|(,)|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][-+]?[0-9]++)?|true|false|null))'
)
_PLAIN = {"true": ("boolean", "true"), "false": ("boolean", "false"), "null": ("null", None)}
_VALUE, _FIRST_VALUE, _KEY, _FIRST_KEY, _AFTER = range(5)


def _string(raw: str) -> str:
    """The text of a JSON string; surrogates that stand alone become question marks."""
    return json.loads(f'"{raw}"').encode("utf-8", "replace").decode("utf-8") if "\\" in raw else raw


def _number(raw: str) -> str:
    """A number as it is written, those with a fraction or exponent in the shortest form."""
    if raw.lstrip("-").isdigit():
        return "0" if raw == "-0" else raw
    short = repr(float(raw))
    return raw if short in ("inf", "-inf") else short


class _Container:
    """A list or object that is open. `at`: its key or position in the one it is in, `own`: what is told of it by `_own`, `within`:
    what the places of its parts begin with; both only once they are asked for, so that depth costs nothing."""

    __slots__ = ("act", "at", "captured", "is_list", "is_open", "keys", "node", "place", "up", "within")

    def __init__(self, up, at, is_list: bool, is_open: bool, act: str | None, node: dict | None) -> None:
        self.up, self.at, self.is_list, self.is_open, self.act, self.node = up, at, is_list, is_open, act, node
        self.place, self.captured, self.within = 0, False, None
        self.keys: dict[str, int] = {}


def _within(c: _Container) -> tuple[str, tuple[int, ...], str]:
    """(group, ordinals, what paths begin with) of the parts of a container."""
    chain, up = [], c
    while up is not None and up.within is None:
        chain.append(up)
        up = up.up
    group, ordinals, path = up.within if up else ("", (), "")
    groups, places, parts = [group], list(ordinals), [path]
    for x in reversed(chain):
        if up is not None and up.is_list and not up.is_open:
            places.append(x.at)
            parts = []
        elif up is not None:
            parts.append(f"[{x.at}]" if up.is_list else x.at)
        if x.act is OPEN or x.act is ONE:
            groups.append("." + "".join(parts) + ("[]" if x.act is ONE else ""))
            parts = []
            if x.act is ONE:
                places.append(0)
        if x.is_list and not x.is_open:
            name = "".join(parts)
            groups.append(("." if name and any(groups) else "") + name + "[]")
            parts = []
        elif not x.is_list and any(parts):
            parts.append(".")
        up = x
    c.within = "".join(groups), tuple(places), "".join(parts)
    return c.within


def _own(c: _Container) -> tuple[str, tuple[int, ...], str]:
    """(group, ordinals, path) of a container itself."""
    if c.up is None:
        return "", (), ""
    group, ordinals, base = c.up.within or _within(c.up)
    if not c.up.is_list:
        path = base + c.at
    elif c.up.is_open:
        path = f"{base}[{c.at}]"
    else:
        ordinals, path = (*ordinals, c.at), ""
    if c.act is OPEN:
        return f"{group}.{path}", ordinals, ""
    return (f"{group}.{path}[]", (*ordinals, 0), "") if c.act is ONE else (group, ordinals, path)


def scan(text: str | None, rules: Rules | None = None, opened: bool = False) -> tuple[list[Triple], dict[str, int]] | None:
    """The triples of a complete JSON text and, if it is an object, where in them those of its keys begin; None for a text that
    is not complete JSON. opened: the whole text is a subtree whose paths are data. Without rules, every element that is an object
    has a triple without a path; with rules, every container that is an element of a list they name.

    Depth is bounded by memory only. Of a key given twice in an object the last value counts.
    """
    if text is None:
        return None
    text = text.lstrip("\ufeff").rstrip(" \t\n\r")
    end, at, state = len(text), 0, _VALUE
    out: list[Triple] = []
    add, match = out.append, _TOKEN.match
    now: _Container | None = None
    key, doubled, root = "", False, {}
    parts: list[str] | None = None  # of the text that is wanted
    while at < end:
        m = match(text, at)
        if m is None:
            return None
        at = m.end()
        what = m.lastindex
        if what == 2:  # a key
            if state not in (_KEY, _FIRST_KEY):
                return None
            key, keys = _string(m[1]), now.keys
            if key in keys:
                first = keys.pop(key)
                until = min((k for k in keys.values() if k > first), default=len(out))
                out[first:until] = [None] * (until - first)  # type: ignore[list-item]
                doubled = True
            keys[key] = len(out)
            state = _VALUE
            if parts is not None:
                parts.append(json.dumps(key, ensure_ascii=False) + ":")
        elif what == 5:
            if state != _AFTER or now is None:
                return None
            state = _VALUE if now.is_list else _KEY
            if parts is not None:
                parts.append(",")
        elif what == 4:  # the end of a container
            if now is None or (m[4] == "]") != now.is_list or state != _AFTER and state != (_FIRST_VALUE if now.is_list else _FIRST_KEY):
                return None
            if parts is not None:
                parts.append(m[4])
            if state != _AFTER:  # it is empty
                add((*_own(now), "list", "[]") if now.is_list else (*_own(now), "object", "{}"))
            if now.captured:
                if len(parts) > 2:
                    add((*_own(now), "list" if now.is_list else "object", "".join(parts)))
                parts = None
            if now.up is None:
                root = now.keys
            now = now.up
            state = _AFTER
        else:
            if state not in (_VALUE, _FIRST_VALUE):
                return None
            act = node = None
            if now is None:
                node = rules
            elif now.is_list:
                key, node = now.place, now.node
                now.place += 1
            elif now.node is not None:
                act, node = now.node.get(key, _NO_RULE)
            if what != 3:  # a scalar
                if what == 1:
                    kind, value = "string", _string(m[1])
                else:
                    kind, value = _PLAIN.get(m[6]) or ("number", _number(m[6]))
                if parts is not None:
                    parts.append(json.dumps(value, ensure_ascii=False) if what == 1 else value or "null")
                state = _AFTER
                if now is None:
                    add(("", (), "", kind, value))
                    continue
                group, ordinals, base = now.within or _within(now)
                if not now.is_list:
                    add((group, ordinals, base + key, kind, value) if act is not OPEN else (f"{group}.{base}{key}", ordinals, "", kind, value))
                elif now.is_open:
                    add((group, ordinals, f"{base}[{key}]", kind, value))
                else:
                    add((group, (*ordinals, key), "", kind, value))
                continue
            is_list = m[3] == "["
            if act is ONE and is_list:
                act = None
            is_open = opened if now is None else now.is_open or act is OPEN
            new = _Container(now, key, is_list, is_open, act, None if is_open else node)
            if parts is not None:
                parts.append(m[3])
            elif act is TEXT:
                parts, new.captured = [m[3]], True
            if act is ONE or now is not None and now.is_list and not is_open and (node is not None or rules is None and not is_list):
                group, ordinals, _ = _own(new)
                add((group, ordinals, None, "list" if is_list else "object", None))
            now = new
            state = _FIRST_VALUE if is_list else _FIRST_KEY
    if state != _AFTER or now is not None or at != end:
        return None
    if doubled:
        root = {k: sum(t is not None for t in out[:n]) for k, n in root.items()}
        out = [t for t in out if t is not None]
    return out, root


def leaf_triples(text: str | None) -> list[tuple[str, str, str | None]] | None:
    """(path, kind, value) of each leaf of a JSON text, a leaf being a scalar, null, `{}` or `[]`; None if it is not complete."""
    found = scan(text, opened=True)
    return None if found is None else [t[2:] for t in found[0]]


def _inline(group: str, ordinals: tuple[int, ...], path: str, above: str, n: int) -> str:
    """The path from an element of the group `above`, which has n ordinals, with positions in place of further groups."""
    names = group[len(above) :].removeprefix(".").split("[]")
    inner = names[0] + "".join(f"[{k}]{name}" for k, name in zip(ordinals[n:], names[1:]))
    return inner + ("." if inner and path else "") + path


def _trajectory(text: str | None) -> list[Triple] | None:
    """The triples of a trajectory record, whether or not it is in an envelope; those of the envelope are in groups that begin with
    ENVELOPE. None for texts that are no complete JSON or no object."""
    found = scan(text, ENVELOPED)
    if found is None or text.lstrip("\ufeff \t\n\r")[:1] != "{":
        return None
    out, keys = found
    if "record" not in keys:
        return out
    first = keys["record"]
    until = min((k for k in keys.values() if k > first), default=len(out))
    inside = out[first:until]
    if any(s in keys for s in SIDES) or not all(t[0].startswith("record.") or t[2].startswith("record.") or t[2:] == ("record", "object", "{}") for t in inside):
        return scan(text, TRAJECTORY)[0]
    own = [(g.removeprefix("record."), o, p if g or p is None else "" if p == "record" else p[7:], k, v) for g, o, p, k, v in inside]
    return own + [(f"{ENVELOPE}.{g}" if g else ENVELOPE, *rest) for k, (g, *rest) in enumerate(out) if not first <= k < until]


_PARTS = {"envelope": "envelope", "": "record", **{f"{s}[]": "step" for s in SIDES}, **{f"{s}[].tool_calls[]": "call" for s in SIDES}}
_HELD = {
    "": RECORD_FIELDS, **{f"{s}[]": STEP_FIELDS for s in SIDES}, **{f"{s}[].tool_calls[]": ("name", "id") for s in SIDES},
}
#: Groups of calls and of their arguments: the calls' group, and 0 for the calls, 1 for arguments at a call, 2 at its function.
_ROLES = {c + end: (c, k) for c in (f"{s}[].tool_calls[]" for s in SIDES) for k, end in enumerate(("", ".arguments", ".function.arguments"))}


def _below(path: str, key: str) -> bool:
    return path == key or path.startswith((key + ".", key + "["))


class _Call:
    """What is known of one tool call: whether it is an object and has one under `function`, and the leaves of its arguments, at
    the call and at its function."""

    __slots__ = ("in_function", "is_object", "leaves")

    def __init__(self) -> None:
        self.is_object = self.in_function = False
        self.leaves: tuple[list, list] = ([], [])


def _calls_of(out: list[Triple]) -> dict[tuple[str, tuple[int, ...]], _Call]:
    found: dict[tuple[str, tuple[int, ...]], _Call] = {}
    for g, o, p, k, v in out:
        role = _ROLES.get(g)
        if role is None:
            if ".tool_calls[].function." in g and (c := g[: g.index(".function.")]) in _ROLES:
                found.setdefault((c, o[:2]), _Call()).in_function = True
            continue
        at = (role[0], o)
        call = found.get(at)
        if call is None:
            call = found[at] = _Call()
        if role[1]:
            call.leaves[role[1] - 1].append((p, k, v))
            call.in_function |= role[1] == 2
        elif not p:
            call.is_object |= k == "object"
        elif p.startswith("function.") or p == "function" and k == "object":
            call.in_function = True
    return found


def _arguments(found: list[tuple[str, str, str | None]]) -> list[tuple[str, str, str | None]]:
    """The leaves of a call's arguments; a JSON text of an object or list counts as that value. What is absent or anything else is
    one leaf with the path ''."""
    if not found:
        return [("", "null", None)]
    if len(found) == 1 and found[0][:2] == ("", "string") and found[0][2].lstrip()[:1] in ("{", "["):
        return leaf_triples(found[0][2]) or found
    return found


def _further(out: list[Triple], calls: dict[tuple[str, tuple[int, ...]], _Call]) -> Iterator[Triple]:
    """The leaves that the tables of records, steps, calls and arguments have no column or row for: unknown keys, and parts that
    are not of the expected kind, such as an element of `tool_calls` that is no object. The group is that of the envelope, record,
    step or call that the leaf belongs to, and the path starts there."""
    for g, o, p, k, v in out:
        if p is None or (k == "object" or k == "list") and len(v) > 2 or _ROLES.get(g, ("", 0))[1]:
            continue
        part, call = g[: len(ENVELOPE)] if g.startswith(ENVELOPE) else next((f"{s}[]" for s in SIDES if g.startswith(f"{s}[]")), ""), None
        if g.startswith(".tool_calls[]", len(part)) and (call := calls.get((f"{part}.tool_calls[]", o[:2]))) and call.is_object:
            part += ".tool_calls[]"
        else:
            call = None
        n = part.count("[]")
        path = _inline(g, o, p, part, n)
        if not path and k == "object":
            continue
        if call and _below(path, "function.name") or any(_below(path, h) for h in _HELD.get(part, ())) and not (call and call.in_function and _below(path, "name")):
            continue
        yield "envelope" if part == ENVELOPE else part, o[:n], path, k, v
    for (g, o), call in calls.items():
        if call.is_object and call.leaves[1]:
            yield from ((g, o, "arguments" + ("." if p and p[0] != "[" else "") + p, k, v) for p, k, v in call.leaves[0])


def triples(text: str | None, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, list[int], dict[str, str | None]]]:
    """(group, ordinals, {path: value}) of every row that a trajectory record's text holds; only those of the groups in `wanted`,
    if it is given."""
    out = _trajectory(text)
    if out is None:
        return
    calls = _calls_of(out)
    if wanted is None or not wanted.isdisjoint(FURTHER_GROUPS):
        for i, (g, o, p, k, v) in enumerate(_further(out, calls)):
            yield g + FURTHER, [*o, i], {"path": p, "kind": k, "value": v}
    if wanted is None or not wanted.isdisjoint(ARGUMENT_GROUPS):
        for (g, o), call in calls.items():
            seen: set[str] = set()
            for i, (p, k, v) in enumerate(_arguments(call.leaves[1] or call.leaves[0]) if call.is_object else ()):
                yield f"{g}.arguments", [*o, i], {"path": p, "kind": k, "value": v} if p in seen else {"path": p, "kind": k, "value": v, "first": "1"}
                seen.add(p)
        if wanted is not None and wanted <= {*ARGUMENT_GROUPS}:
            return
    rows: dict[tuple[str, tuple[int, ...]], dict[str, str | None]] = {("", ()): {}}
    for g, o, p, _, v in out:
        if (wanted is None or g in wanted) and g != ENVELOPE and not _ROLES.get(g, ("", 0))[1]:
            row = rows.get((g, o))
            if row is None:
                row = rows[g, o] = {}
            if p is not None:
                row[p] = v
    for (g, o), row in rows.items():
        if not ((call := calls.get((g, o))) and not call.is_object):
            yield g, list(o), row


def rows_of(text: str | None) -> Iterator[tuple[str, list[int], dict[str, str | None]]]:
    """(group, ordinals, {path: value}) of every row of any JSON text, by its lists alone. The root is a row of the group ''."""
    found = scan(text)
    if found is None:
        return
    rows: dict[tuple[str, tuple[int, ...]], dict[str, str | None]] = {("", ()): {}}
    for g, o, p, _, v in found[0]:
        row = rows.setdefault((g, o), {})
        if p is not None:
            row[p] = v
    yield from ((g, list(o), row) for (g, o), row in rows.items())


def shred(df: DataFrame, key: str, text: str, groups: tuple[str, ...] | None = None, trajectories: bool = True) -> DataFrame:
    """Rows of path-value maps of every record in `df[text]`: record_key, grp, ordinals, fields.

    groups: only these groups leave the parser; None for all. trajectories: by the rules of trajectory records; else any JSON is
    shredded, by its lists alone. Null, blank and incomplete texts give no rows, nor do trajectories that are no object. A null key
    stays null. Repeated texts count under each key. Other columns of `df` are not read.
    """
    keep = None if groups is None else frozenset(groups)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("record_key", batch.schema.field(0).type), ("grp", pa.string()), ("ordinals", pa.list_(pa.int32())), ("fields", pa.map_(pa.string(), pa.string()))])
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for grp, ords, fields in triples(t, keep) if trajectories else rows_of(t):
                    if keep is None or grp in keep:
                        for c, v in zip(cols, (k, grp, ords, list(fields.items()))):
                            c.append(v)
                if len(cols[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                    cols = ([], [], [], [])
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, TRIPLES.format(key=kind))


def pivot(shredded: DataFrame, grp: str | tuple[str, ...], names: list[str]) -> DataFrame:
    """One table of `shred`: record_key, the parent's ordinals, `pos` (own place under the parent), one column per path in
    `names`, and `other`, a map of the paths not named. A name that clashes with the keys gets underscores before it. Several
    groups make one table with the column `grp`."""
    ords, several = F.col("ordinals"), not isinstance(grp, str)
    out = fresh(["record_key", "parent", "pos", "other", *(["grp"] if several else [])], *names)
    return shredded.where(F.col("grp").isin(list(grp) if several else [grp])).select(
        "record_key", *(["grp"] if several else []), F.slice(ords, 1, F.greatest(F.size(ords) - 1, F.lit(0))).alias("parent"), F.try_element_at(ords, F.lit(-1)).alias("pos"),
        *(F.try_element_at("fields", F.lit(n)).alias(o) for n, o in zip(names, out)),
        F.map_filter("fields", lambda k, _: ~k.isin(names)).alias("other"),
    )


def _sided(shredded: DataFrame, below: str, names: list[str]) -> tuple[DataFrame, Column]:
    groups = tuple(f"{s}[]{below}" for s in SIDES)
    return pivot(shredded, groups, names), F.when(F.col("grp") == groups[0], SIDES[0]).otherwise(SIDES[1]).alias("side")


def records(shredded: DataFrame) -> DataFrame:
    """One row per record: record_key, trajectory_id, task, summary, metadata (JSON text)."""
    return pivot(shredded, "", list(RECORD_FIELDS)).select("record_key", *RECORD_FIELDS)


def steps(shredded: DataFrame) -> DataFrame:
    """One row per step, child of records: record_key, side, step_pos (null elements count), role, content, tool_call_id, name."""
    rows, side = _sided(shredded, "", list(STEP_FIELDS))
    return rows.select("record_key", side, F.col("pos").alias("step_pos"), *STEP_FIELDS)


def calls(shredded: DataFrame) -> DataFrame:
    """One row per tool call, child of steps by (record_key, side, step_pos): call_pos, name, id."""
    rows, side = _sided(shredded, ".tool_calls[]", ["function.name", "name", "id"])
    return rows.select("record_key", side, F.col("parent")[0].alias("step_pos"), F.col("pos").alias("call_pos"), F.coalesce(F.col("`function.name`"), F.col("name")).alias("name"), "id")


def arguments(shredded: DataFrame, distinct: bool = False) -> DataFrame:
    """One row per leaf of a call's arguments, child of calls by (record_key, side, step_pos, call_pos): arg_pos, arg_path,
    arg_kind, arg_value. Arguments that are no object or list, or an empty one, give one row with arg_path ''. distinct: of leaves
    with equal paths in one call (keys that hold dots or brackets) only the first."""
    rows, side = _sided(shredded, ".tool_calls[].arguments", ["path", "kind", "value", "first"])
    if distinct:
        rows = rows.where("first IS NOT NULL")
    return rows.select(
        "record_key", side, F.col("parent")[0].alias("step_pos"), F.col("parent")[1].alias("call_pos"), F.col("pos").alias("arg_pos"),
        F.col("path").alias("arg_path"), F.col("kind").alias("arg_kind"), F.col("value").alias("arg_value"),
    )


ARGUMENT_GROUPS = tuple(f"{s}[].tool_calls[].arguments" for s in SIDES)
FURTHER_GROUPS = tuple(g + FURTHER for g in _PARTS)

KNOWN_GROUPS = frozenset({"", *(g for g in _PARTS if g != "envelope"), *ARGUMENT_GROUPS, *FURTHER_GROUPS})


def repeated(shredded: DataFrame) -> DataFrame:
    """One row per leaf of a list other than steps, continuation, tool_calls and arguments: record_key, grp (the path of the list,
    positions left out), ordinals (positions on the way, joined by commas; without the last one they name the parent), path
    below the element, value. `pivot` makes a table of one grp."""
    rows = shredded.where(~F.col("grp").isin(list(KNOWN_GROUPS)))
    return rows.select("record_key", "grp", F.array_join(F.col("ordinals").cast("array<string>"), ",").alias("ordinals"), F.explode("fields").alias("path", "value"))


def further(shredded: DataFrame) -> DataFrame:
    """One row per leaf that no other table holds (see `further_leaves`), child of the envelope or record by record_key, of steps
    by (record_key, side, step_pos), of calls by these and call_pos: part (envelope, record, step, call), path, kind, value."""
    o, grp = F.col("ordinals"), F.col("grp")
    part = F.create_map(*(F.lit(x) for g, p in _PARTS.items() for x in (g + FURTHER, p)))
    place = lambda i: F.when(F.size(o) > i + 1, F.get(o, F.lit(i)))
    side = F.when(F.size(o) > 1, F.regexp_extract(grp, r"^(\w+)\[", 1))
    return shredded.where(grp.isin(list(FURTHER_GROUPS))).select(
        "record_key", F.element_at(part, grp).alias("part"), side.alias("side"), place(0).alias("step_pos"), place(1).alias("call_pos"),
        *(F.try_element_at("fields", F.lit(n)).alias(n) for n in ("path", "kind", "value")),
    )
