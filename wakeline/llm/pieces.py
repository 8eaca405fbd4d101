"""Problem 5: cutting oversized items at natural boundaries.

Lexical-cohesion segmentation. The gaps between a text's lines and sentences are candidates. At each gap the words of the
BLOCK units before it and of the BLOCK units after it are compared by cosine; where this similarity has a valley the topic
changes. A valley's depth is how far the similarity climbs from it to the nearest peak on either side. Of the gaps that a
piece of allowed size can end at, the one with the deepest valley is taken (at equal depth the stronger kind of boundary, then
the later one). Without a gap the last white space in the window is taken, and only where there is none either, the text is
cut at the limit (`forced`). As every white space and sentence mark is such a place, exactly the items with an unbroken
stretch above the limit have a forced cut.

The next piece begins `overlap` characters before the cut. The overlap is shortened only where otherwise an unbroken
stretch that fits into one piece would have to be cut.

Lists of steps are cut between turns in the same way: the gaps are those between turns, the overlap is the last turn, left
out where it and the next turn don't fit into one piece. A turn above the limit alone is cut between its steps, and a step
above the limit alone at its text's boundaries; both are `forced`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.deliveries import arrival, once

TEXT_LIMIT, TEXT_OVERLAP, STEPS_LIMIT = 4000, 200, 12_000
BLOCK = 6
#: Numbers that are held at once while similarities are computed; it decides on memory only.
CELLS = 4_000_000
PARAGRAPH, LINE, SENTENCE, SPACE, FORCED, END = "paragraph", "line", "sentence", "space", "forced", "end"
_KINDS = (SENTENCE, LINE, PARAGRAPH)  # from weak to strong
_GAP = re.compile(r"(\n[ \t\r]*\n\s*)|(\n)|([.!?…]['\")\]»”]*\s+|[。！？]+['\")\]»”]*\s*)")
_CJK = "㐀-鿿豈-﫿぀-ヿ가-힯"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]{{2,}}")
_SPACE = re.compile(r"[\s。！？]")
SCHEMA = T.StructType([
    T.StructField("item_kind", T.StringType()), T.StructField("item_key", T.StringType()), T.StructField("item_pos", T.IntegerType()),
    T.StructField("piece_no", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("until", T.IntegerType()),
    T.StructField("char_from", T.IntegerType()), T.StructField("char_until", T.IntegerType()), T.StructField("n_chars", T.IntegerType()),
    T.StructField("boundary", T.StringType()), T.StructField("forced", T.IntegerType()), T.StructField("text", T.StringType()),
])


def _cosine(a: Counter, b: Counter) -> float:
    norm = sum(x * x for x in a.values()) * sum(x * x for x in b.values())
    return sum(n * b[w] for w, n in a.items()) / norm**0.5 if norm else 0.0


def similarities(units: list[str]) -> np.ndarray:
    """Cosine of the words of the BLOCK units before and after each gap between neighbouring units."""
    n = len(units)
    words = [_WORD.findall(u.lower()) for u in units]
    upto = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    s, at = np.zeros(max(0, n - 1)), 0
    while at < n - 1:  # a few gaps at a time, with the units that they look at
        low, until = max(0, at + 1 - BLOCK), at + 1
        held = lambda k: (k + BLOCK - low) * int(upto[min(n, k + BLOCK)] - upto[low])  # noqa: B023, E731
        while until < n - 1 and held(until + 1) <= CELLS:
            until += 1
        high = min(n, until + BLOCK)
        if held(until) > CELLS:  # one gap between very large units
            s[at] = _cosine(Counter(w for u in words[low : at + 1] for w in u), Counter(w for u in words[at + 1 : high] for w in u))
        else:
            ids: dict[str, int] = {}
            flat = np.array([ids.setdefault(w, len(ids)) for u in words[low:high] for w in u], np.int64)
            row = np.repeat(np.arange(high - low), np.diff(upto[low : high + 1]))
            total = np.zeros((high - low + 1, len(ids)), np.float32)
            total[1:] = np.bincount(row * len(ids) + flat, minlength=(high - low) * len(ids)).reshape(high - low, len(ids)).cumsum(axis=0)
            gap = np.arange(at + 1, until + 1) - low
            left, right = total[gap] - total[np.maximum(gap - BLOCK, 0)], total[np.minimum(gap + BLOCK, high - low)] - total[gap]
            norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
            s[at:until] = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0.0)
        at = until
    return s


def _peaks(s: list[float]) -> list[float]:
    """For each value the one that a climb to the left ends at."""
    out = s[:1]
    for before, here in zip(s, s[1:]):
        out.append(out[-1] if before >= here else here)
    return out


def depths(units: list[str]) -> np.ndarray:
    """Depth of the similarity valley at each gap between neighbouring units: how far it is up to the nearest peak on the left
    and on the right, added; 0 at a peak or where the words don't change."""
    s = similarities(units).round(6)
    left, right = _peaks(s.tolist()), _peaks(s[::-1].tolist())[::-1]
    return np.array(left) + np.array(right) - 2 * s


def _best(ends: np.ndarray, depth: np.ndarray, low: int, high: int, strength: np.ndarray | None = None) -> int | None:
    """Index of the gap with low < end <= high that has the deepest valley, of equals the strongest, then the last."""
    a, b = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "right")
    if a >= b:
        return None
    deepest = a + np.flatnonzero(depth[a:b] == depth[a:b].max())
    return int(deepest[-1] if strength is None else deepest[len(deepest) - 1 - np.argmax(strength[deepest][::-1])])


def spans(text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of pieces of at most `limit` characters; their union is the whole text.

    0 <= overlap < limit. A text within the limit is one piece, an empty one too.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    if len(text) <= limit:
        return [(0, len(text), END)]
    gaps = [(m.end(), 3 - m.lastindex) for m in _GAP.finditer(text) if m.end() < len(text)]
    ends, strength = np.array([e for e, _ in gaps], np.int64), np.array([k for _, k in gaps], np.int64)
    edges = [0, *ends.tolist(), len(text)]
    depth = depths([text[a:b] for a, b in zip(edges, edges[1:])])
    marks = np.array([m.start() for m in _SPACE.finditer(text)], np.int64)
    spaces = np.union1d(marks, marks + 1)
    out, start, done = [], 0, 0
    while len(text) - start > limit:
        low, high = max(start + max(limit // 2, overlap), done), start + limit
        i = _best(ends, depth, low, high, strength)
        if i is None:
            i = _best(ends, depth, max(start + overlap, done), low, strength)
        if i is not None:
            end, kind = int(ends[i]), _KINDS[strength[i]]
        else:
            k = int(np.searchsorted(spaces, high, "right")) - 1
            end, kind = (int(spaces[k]), SPACE) if k >= 0 and spaces[k] > max(start, done) else (high, FORCED)
        out.append((start, end, kind))
        done, start = end, max(end - overlap, start + 1)
        k = int(np.searchsorted(spaces, done, "right"))
        stretch = int(spaces[k]) if k < len(spaces) else len(text)
        if stretch - done <= limit < stretch - start:
            start = stretch - limit
    return [*out, (start, len(text), END)]


def turns(roles: list[str | None]) -> list[tuple[int, int]]:
    """(first, until) of each turn: an assistant step and all up to the next one; steps before the first are one turn too."""
    starts = [i for i, r in enumerate(roles) if i == 0 or r == "assistant"]
    return list(zip(starts, [*starts[1:], len(roles)]))


def step_spans(roles: list[str | None], contents: list[str | None], limit: int = STEPS_LIMIT, overlap: int = TEXT_OVERLAP) -> list[tuple[int, int, int | None, int | None, str]]:
    """(first, until, char_from, char_until, kind) of the pieces of a list of steps; null contents count as empty."""
    texts = [c or "" for c in contents]
    sizes = np.cumsum([0, *map(len, texts)])
    size = lambda a, b: int(sizes[b] - sizes[a])
    units = turns(roles)
    begins, ends = [a for a, _ in units], np.array([b for _, b in units[:-1]], np.int64)
    depth = depths(["\n".join(texts[a:b]) for a, b in units])
    out: list[tuple[int, int, int | None, int | None, str]] = []
    start, n = 0, len(roles)
    while size(start, n) > limit:
        turn = units[bisect_right(begins, start) - 1]
        high = int(np.searchsorted(sizes, sizes[start] + limit, "right")) - 1
        low = max(out[-1][1] if out else 0, start)
        half = int(np.searchsorted(sizes, sizes[start] + limit // 2, "left")) - 1
        i = _best(ends, depth, max(low, half), high)
        i = _best(ends, depth, low, high) if i is None else i
        if i is not None:
            end = int(ends[i])
            out.append((start, end, None, None, "turn"))
            k = bisect_right(begins, end) - 1
            start = begins[k - 1] if begins[k - 1] > start and size(begins[k - 1], units[k][1]) <= limit else end
        elif size(start, turn[1]) <= limit:
            start = low
        else:  # one turn above the limit
            s = turn[0]
            while s < turn[1]:
                e = max(s + 1, min(turn[1], int(np.searchsorted(sizes, sizes[s] + limit, "right")) - 1))
                out += [(s, e, a, b, FORCED) for a, b, _ in spans(texts[s], limit, overlap)] if size(s, e) > limit else [(s, e, None, None, FORCED)]
                s = e
            start = turn[1]
    if start < n:
        out.append((start, n, None, None, END))
    return out


def _content_rows(kind: str, key, pos, text: str, limit: int, overlap: int, with_text: bool) -> Iterator[tuple]:
    cuts = spans(text, limit, overlap)
    forced = int(any(how == FORCED for _, _, how in cuts))
    for i, (a, b, how) in enumerate(cuts):
        yield kind, key, pos, i, a, b, a, b, b - a, how, forced, text[a:b] if with_text else None


def _step_rows(key, roles, contents, limit: int, overlap: int, with_text: bool) -> Iterator[tuple]:
    size = [len(c or "") for c in contents]
    cuts, begins = step_spans(roles, contents, limit, overlap), [a for a, _ in turns(roles)]
    # steps before the first assistant step are no turn
    forced = int(any(how == FORCED and roles[begins[bisect_right(begins, a) - 1]] == "assistant" for a, _, _, _, how in cuts))
    for i, (a, b, c, d, how) in enumerate(cuts):
        text = "\n".join(x or "" for x in contents[a:b]) if with_text else None
        yield "steps", key, -1, i, a, b, c, d, sum(size[a:b]) if c is None else d - c, how, forced, text if c is None or text is None else text[c:d]


def _mapped(df: DataFrame, rows) -> DataFrame:
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    names = SCHEMA.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few at a time: the items are large
                part = batch.slice(at, 256)
                made = [r for row in zip(*(c.to_pylist() for c in part.columns)) for r in rows(*row)]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    return df.mapInArrow(run, SCHEMA)


def content_pieces(items: DataFrame, key: str, pos: str, text: str, limit: int = TEXT_LIMIT, overlap: int = TEXT_OVERLAP, with_text: bool = True, at: str | None = None) -> DataFrame:
    """Pieces of the texts above `limit` characters: item_kind `content`, item_key, item_pos, piece_no, first and until
    (character offsets, also as char_from and char_until), n_chars, boundary (kind of the end), forced (the item has more than
    `limit` characters in a row without white space or 。！？), text (null unless with_text).

    Null and empty texts and those within the limit give no rows. An item delivered again counts once, the earliest by `at`.
    Texts go to Python only if they are above the limit. Other columns of `items` are not read.
    """
    large = items.select(F.col(key).cast("string").alias("k"), F.col(pos).cast("int").alias("p"), F.col(text).alias("t"), arrival(items, at)).where(F.length("t") > limit)
    return _mapped(once(large, ["k", "p"]), lambda k, p, t: _content_rows("content", k, p, t, limit, overlap, with_text))


def step_pieces(items: DataFrame, key: str, steps: str, limit: int = STEPS_LIMIT, overlap: int = TEXT_OVERLAP, with_text: bool = True, at: str | None = None) -> DataFrame:
    """Pieces of the lists of steps whose contents sum to more than `limit` characters: columns as `content_pieces`, with
    item_kind `steps`, item_pos -1, first and until as step indexes, and char_from and char_until only where a single step
    had to be cut. forced: one turn alone is above the limit. Null lists and null steps count as empty. An item delivered
    again counts once, the earliest by `at`."""
    s = F.col(steps)
    chars = F.aggregate(F.coalesce(s, F.array().cast(items.schema[steps].dataType)), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.length(x["content"]), F.lit(0)))
    large = items.select(F.col(key).cast("string").alias("k"), F.transform(s, lambda x: x["role"]).alias("_r"), F.transform(s, lambda x: x["content"]).alias("_c"), chars.alias("_n"), arrival(items, at)).where(F.col("_n") > limit).drop("_n")
    return _mapped(once(large, ["k"]), lambda k, r, c: _step_rows(k, r, c, limit, overlap, with_text))


def pieces(agent_steps: DataFrame, trajectories: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of oversized contents and step lists. A step or trajectory delivered again counts once, the earliest by
    `arrived_at` or `ingested_at`, where there are such columns."""
    content = content_pieces(agent_steps, "run_id", "pos", "content", with_text=with_text, at="arrived_at")
    return content.unionByName(step_pieces(trajectories, "trajectory_id", "steps", with_text=with_text, at="ingested_at"))
