"""Problem 6: evaluation passages inside a training corpus.

Size-partitioned MinHash containment search. A passage counts from MIN_WORDS words on with at most one word in ten changed.
A longer one holds a part of MIN_WORDS to 2 * MIN_WORDS - 1 words that counts too, as not all of its parts can be worse than
the whole; so parts of bounded size are looked for, whatever the sizes of items and documents.

Such a part keeps a stretch of at least `stretch()` words without a change (6 for 20 words and 2 changes), which is a set of
shingles of SHINGLE words. Every stretch of an item is represented by its MinHash, and so is every stretch of a document.
Items are partitioned by size (doubling classes of their number of words); a class has the width of stretch that its smallest
passage leaves intact. With `min_share` (a passage must also be that share of its item) the classes of larger items get wider
stretches; without it all classes come to the same width. A document holds a part only if it contains the MinHashes of at
least `least_hits()` of the item's stretches. As the smallest stretch that must be intact is looked up, no passage is missed by
chance, which banding of signatures of whole items could not promise.

Candidates are verified: enough of the shingles of such a part must be contained exactly in the document, and from an intact
stretch the match is then extended to both sides, word by word, by furthest-reaching paths for 0, 1, 2, ... changes. A path
is given up where it falls DROP words behind (each change costs ten), which no part of a passage does.

Plan: documents are scanned once. A bitmap of the items' keys (at most 2 ** BITS bits) is broadcast and tells which stretches of a
document may be an item's; false alarms only cost time. What is around the others (the segments) is stored, and its keys are joined with
the items' by a salted shuffle. The driver sees no item, only the bitmap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.lineage import stored

SHINGLE, MIN_WORDS, RATE, DROP = 5, 20, 10, 150
#: Words that a Python task looks at together are about so many characters.
BLOCK_CHARS = 4_000_000
BITS, BITS_A_KEY, SALT = 28, 128, 8
_WORDS = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORDS.findall(text.lower()) if text else []


def stretch(n_words: int, rate: int = RATE) -> int:
    """The least length of the longest unchanged stretch in n words with at most n / rate changes."""
    changes = n_words // rate
    return -(-(n_words - changes) // (changes + 1))


def size_class(n_words: int, min_words: int = MIN_WORDS) -> int:
    """0 for items of less than 2 * min_words words, 1 for less than 4 * min_words, and so on."""
    return (n_words // min_words).bit_length() - 1


def smallest_passage(cls: int, min_words: int = MIN_WORDS, min_share: float = 0.0) -> int:
    """Words of the smallest passage that counts for an item of the size class."""
    return max(min_words, int(np.ceil(min_share * min_words * 2**cls)))


def width_of(smallest: int, rate: int = RATE) -> int:
    """Shingles in the stretch that passages of at least `smallest` words leave intact."""
    words = min(stretch(n, rate) for n in range(smallest, smallest + rate + 1))
    if words < SHINGLE:
        raise ValueError(f"passages of {smallest} words with one change in {rate} may hold no shingle of {SHINGLE} words")
    return words - SHINGLE + 1


def least_hits(smallest: int, width: int, rate: int = RATE) -> int:
    """How many stretches of `width` shingles are intact in a part of `smallest` to 2 * smallest - 1 words, at least."""
    return max(1, min(n - n // rate - (n // rate + 1) * (width + SHINGLE - 2) for n in range(smallest, 2 * smallest)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of the shingle at each position."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, x = np.zeros(n, np.uint64), ids.view(np.uint64)
    for k in range(size):
        h = h * _P + x[k : k + n]
    return _mix(h)


def _minhash(h: np.ndarray, width: int) -> np.ndarray:
    """MinHash of each stretch of `width` shingles."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = h[:n].copy()
    for k in range(1, width):
        np.minimum(low, h[k : k + n], out=low)
    return low


def _own_shingles(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles within each of the lists that begin at `starts`, told apart by list: (hashes, where each list's begin)."""
    size = np.maximum(np.diff(starts) - SHINGLE + 1, 0)
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(begin[-1]) - begin[owner] + starts[owner]
    return _mix(_shingles(words)[place] ^ (owner.astype(np.uint64) * _P)) if len(place) else np.zeros(0, np.uint64), begin


def enough_shingles(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, smallest: np.ndarray, rate: int = RATE) -> np.ndarray:
    """For each pair of a list of a and one of b: whether some part of the latter of `smallest` to 2 * smallest - 1 words has as
    many shingles in the former as changes can leave it."""
    ha, _ = _own_shingles(a, a_starts)
    hb, begin = _own_shingles(b, b_starts)
    ha.sort()
    upto = np.concatenate([[0], np.cumsum(ha[np.minimum(np.searchsorted(ha, hb), len(ha) - 1)] == hb)]) if len(ha) else np.zeros(len(hb) + 1, np.int64)
    out = np.zeros(len(b_starts) - 1, bool)
    for low in np.unique(smallest).tolist():
        for n in {low, *range(-(-low // rate) * rate, 2 * low, rate)}:  # between these a longer part may miss no more of them
            m = n - SHINGLE + 1
            full = np.flatnonzero(upto[m:] - upto[: max(0, len(upto) - m)] >= m - SHINGLE * (n // rate))
            pair = np.searchsorted(begin, full, "right") - 1
            out[pair[(full + m <= begin[np.minimum(pair + 1, len(begin) - 1)]) & (smallest[np.minimum(pair, len(smallest) - 1)] == low)]] = True
    return out


def _reach(a: list[int], i: int, b: list[int], j: int, rate: int) -> tuple[list[int], list[int]]:
    """For 0, 1, ... changes, how many words of b from j on are matched to a from i on, the last one unchanged, and how many
    words of a that takes. A change replaces, drops or adds one word. Ends where the paths fall DROP behind."""
    na, nb = len(a) - i, len(b) - j
    front, best, took, out, outa, e, top = {0: 0}, 0, 0, [], [], 0, 0
    while True:
        far = 0
        for d, y in front.items():  # d = words of a less words of b
            s = y
            while y < nb and y + d < na and a[i + y + d] == b[j + y]:
                y += 1
            front[d] = y
            if y > far:
                far = y
            if y > s and y > best:
                best, took = y, y + d
        out.append(best)
        outa.append(took)
        top = max(top, far - rate * e)
        if best >= nb or not front or far - rate * e < top - DROP:
            return out, outa
        e += 1
        grown: dict[int, int] = {}
        for d, y in front.items():
            if y < far - DROP:
                continue
            for dd, yy in ((d, y + 1), (d - 1, y + 1), (d + 1, y)):
                if yy <= nb and 0 <= yy + dd <= na and yy > grown.get(dd, -1):
                    grown[dd] = yy
        front = grown


def longest(a: list[int], b: list[int], i: int, j: int, size: int, rate: int = RATE) -> tuple[int, int, int, int, int, int]:
    """(words of b, changes, range in a, range in b) of the longest passage found around a[i:i+size] == b[j:j+size] with at most
    one change in `rate` words."""
    right, right_a = _reach(a, i + size, b, j + size, rate)
    left, left_a = _reach(a[:i][::-1], 0, b[:j][::-1], 0, rate)
    r, score = np.array(right), np.array(right) - rate * np.arange(len(right))
    found = (size, 0, i, i + size, j, j + size)
    for x, n in enumerate(left):
        ok = np.flatnonzero(score >= rate * x - n - size)
        if not len(ok):
            continue
        y = int(np.searchsorted(r, r[ok[-1]], "left"))
        total = size + n + right[y]
        if total > found[0] or total == found[0] and x + y < found[1]:
            found = (total, x + y, i - left_a[x], i + size + right_a[y], j - n, j + size + right[y])
    return found


def passage(a: np.ndarray, b: np.ndarray, size: int, min_words: int = MIN_WORDS, rate: int = RATE) -> tuple[int, int] | None:
    """(words, changes) of the longest passage of b found in a, from min_words words on, that holds an intact stretch of `size`
    words."""
    ha, hb = _shingles(a, size), _shingles(b, size)
    order = np.argsort(hb, kind="stable")
    low, high = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    la, lb = a.tolist(), b.tolist()
    best, done, covered = (0, 0), {}, []
    for i in np.flatnonzero(high > low).tolist():
        for x in range(low[i], high[i]):
            j = int(order[x])
            if done.get(i - j, -1) >= i or la[i : i + size] != lb[j : j + size] or any(p <= i < q and r <= j < s for p, q, r, s in covered):
                continue
            n = size
            while i + n < len(la) and j + n < len(lb) and la[i + n] == lb[j + n]:
                n += 1
            done[i - j] = i + n - size
            words, changes, *there = longest(la, lb, i, j, n, rate)
            if words >= min_words:
                covered.append(there)
                if words > best[0]:
                    best = words, changes
                if words == len(lb):
                    return best
    return best if best[0] >= min_words else None


Index = list[tuple[int, str, np.ndarray, int, int, np.ndarray]]


def _ids(words: list[str]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words))


def build_index(items: list[tuple[int, str, str | None]], min_words: int = MIN_WORDS, rate: int = RATE, min_share: float = 0.0) -> Index:
    """For `search` in this process: item, part, words, size of an intact stretch, least hits and keys of each text that is long enough."""
    out = []
    for item, part, text in items:
        ids = _ids(words_of(text))
        if len(ids) >= min_words:
            small = smallest_passage(size_class(len(ids), min_words), min_words, min_share)
            width = width_of(small, rate)
            out.append((item, part, ids, width + SHINGLE - 1, least_hits(small, width, rate), _minhash(_shingles(ids), width)))
    return out


def search(texts: list[str | None], index: Index, min_words: int = MIN_WORDS, rate: int = RATE) -> list[tuple[int, int, str, int, int]]:
    """(text's place, item, part, words, changes) of each text that holds a passage of an item's part, by the steps that `leaks`
    takes in Spark."""
    out = []
    for t, text in enumerate(texts):
        ids = _ids(words_of(text))
        h = _shingles(ids)
        for item, part, words, size, least, keys in index:
            one = np.isin(keys, _minhash(h, size - SHINGLE + 1)).sum() >= least and enough_shingles(ids, np.array([0, len(ids)]), words, np.array([0, len(words)]), np.array([min_words]), rate)[0]
            if one and (found := passage(ids, words, size, min_words, rate)):
                out.append((t, item, part, *found))
    return out


def _hashed(text) -> F.Column:
    """Hashes of the words of a text, in their order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each list starts and the last one ends)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64, copy=False), offsets - offsets[0]


def _few(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, those with about BLOCK_CHARS / 8 words in the column's lists at a time (or one)."""
    offsets, at = batch.column(column).offsets.to_numpy(), 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_CHARS // 8, "right")) - 1)
        yield batch.slice(at, until - at)
        at = until


def _key_of(low: np.ndarray) -> np.ndarray:
    return low.view(np.int64)


def item_keys(items: DataFrame, key: str, parts: list[str], min_words: int, rate: int, min_share: float) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: item_no, item_key, part, words, size (of an intact stretch), least (hits), and key, item_no, at."""
    texts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("t")) for p in parts)))
    rows = items.select(F.col(key).alias("item_key"), texts.alias("x")).where("item_key IS NOT NULL AND x.t IS NOT NULL").select("item_key", "x.part", _hashed(F.col("x.t")).alias("words"))
    rows = rows.where(F.size("words") >= min_words).distinct().withColumn("item_no", F.monotonically_increasing_id())
    kind = items.schema[key].dataType.simpleString()

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            smallest = [smallest_passage(size_class(len(w), min_words), min_words, min_share) for w in batch.column(2)]
            widths = [width_of(n, rate) for n in smallest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w + SHINGLE - 1 for w in widths], pa.int32()), pa.array([least_hits(n, w, rate) for n, w in zip(smallest, widths)], pa.int32())], names=["item_key", "part", "words", "item_no", "size", "least"])

    held = stored(rows.mapInArrow(sized, f"item_key {kind}, part string, words array<long>, item_no long, size int, least int"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, words, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                low = _minhash(_shingles(np.array(words, np.int64)), size - SHINGLE + 1)
                yield pa.RecordBatch.from_arrays([pa.array(_key_of(low)), pa.array(np.full(len(low), no, np.int64)), pa.array(np.arange(len(low), dtype=np.int32))], names=["key", "item_no", "at"])

    return held, stored(held.select("item_no", "words", "size").mapInArrow(keyed, "key long, item_no long, at int"))


def bitmap(keys: DataFrame, key: str = "key") -> np.ndarray:
    """For each key the bits that its lowest and its highest bits name, as words of 64; at most 2 ** BITS bits, however many
    keys there are."""
    bits = min(BITS, max(12, (BITS_A_KEY * keys.count()).bit_length()))
    places = F.explode(F.array(F.col(key).bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(F.col(key), 64 - bits))).alias("p")
    rows = keys.select(places).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return out.view(np.uint64)


def segments(docs: DataFrame, doc_key: str, text: str, widths: list[int], bits: np.ndarray, context: int) -> DataFrame:
    """doc_no, doc_key, words, keys of every stretch of a document with keys that may be items', with `context` words around."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    kind = docs.schema[doc_key].dataType.simpleString()
    high = np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    rows = docs.select(F.col(doc_key).alias("k"), _hashed(F.col(text).cast("string")).alias("w"), F.monotonically_increasing_id().alias("n"))

    def pieces_of(piece: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, starts = _lists(piece.column(1))
        known = lambda at: (sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        last = np.uint64(len(sent.value) * 64 - 1)
        h = _shingles(ids)
        ends = np.repeat(starts[1:], np.diff(starts))
        hits = []
        for width in widths:
            low = _minhash(h, width)
            found = np.flatnonzero(known(low & last))
            found = found[known(low[found] >> high)]
            found = found[found + (width + SHINGLE - 1) <= ends[found]]  # no stretch crosses from one text to the next
            hits.append((found, low[found]))
        place = np.concatenate([p for p, _ in hits])
        keys = np.concatenate([k for _, k in hits])
        order = np.argsort(place, kind="stable")
        place, keys = place[order], keys[order]
        if not len(place):
            return
        doc = np.searchsorted(starts, place, "right") - 1
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(place, prepend=place[0]) > 2 * context))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(place)]):
            d = int(doc[a])
            first, until = max(int(starts[d]), int(place[a]) - context), min(int(starts[d + 1]), int(place[b - 1]) + context + max(widths) + SHINGLE)
            yield d, ids[first:until], np.unique(keys[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _few(batch, 1):
                made = list(pieces_of(piece))
                if made:
                    place = pa.array([d for d, _, _ in made])
                    yield pa.RecordBatch.from_arrays([piece.column(2).take(place), piece.column(0).take(place), pa.array([w for _, w, _ in made], pa.list_(pa.int64())), pa.array([_key_of(k) for _, _, k in made], pa.list_(pa.int64()))], names=["doc_no", "doc_key", "words", "keys"])

    return rows.mapInArrow(run, f"doc_no long, doc_key {kind}, words array<long>, keys array<long>")


def leaks(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, parts: list[str], min_words: int = MIN_WORDS, rate: int = RATE, min_share: float = 0.0) -> DataFrame:
    """doc_key, item_key, part, n_words, n_changes: the longest passage of each item's part in each document, from min_words
    words of the item in a row on, with at most one word in `rate` changed, dropped or added; with min_share, only passages of
    at least that share of the part's words.

    Words are runs of letters and digits, case ignored. Null and empty texts hold no passage; items without a key are left out.
    Repeated items give one row per text they differ in; repeated documents one row each. Empty tables give an empty result.
    Other columns are not read. No passage of min_words words is missed; of a longer one n_words may be less than the most
    possible where it is joined from parts that are more than DROP / rate changes apart.
    """
    held, keys = item_keys(items, item_key, parts, min_words, rate, min_share)
    sizes = [r[0] for r in held.select("size").distinct().orderBy("size").collect()]  # one per width of a size class
    widths = [s - SHINGLE + 1 for s in sizes] or [1]
    largest = max((smallest_passage(c, min_words, min_share) for c in range(40) if width_of(smallest_passage(c, min_words, min_share), rate) <= max(widths)), default=min_words) if min_share else min_words
    context = 2 * largest + 2 * (2 * largest // rate)
    held_segments = stored(segments(docs, doc_key, text, widths, bitmap(keys), context).withColumn("seg_no", F.monotonically_increasing_id()))
    salt = lambda c: F.pmod(F.col(c), F.lit(SALT)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    hits = held_segments.select("seg_no", salt("seg_no"), F.explode("keys").alias("key")).join(keys.select("key", "item_no", salts), ["key", "salt"])
    counted = hits.groupBy("seg_no", "item_no").agg(F.count("*").alias("hits"))
    pairs = counted.withColumn("salt", salt("seg_no")).join(held.select("*", salts).withColumnRenamed("words", "item_words"), ["item_no", "salt"]).where("hits >= least")
    judged = pairs.select("seg_no", "item_key", "part", "item_words", "size").join(held_segments.select("seg_no", "doc_no", "doc_key", "words"), "seg_no")
    columns = judged.select("doc_no", "doc_key", "item_key", "part", "words", "item_words", "size")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _few(batch, 4):
                words, starts = _lists(piece.column(4))
                others, item_starts = _lists(piece.column(5))
                smallest = np.maximum(min_words, np.ceil(min_share * np.diff(item_starts))).astype(np.int64)
                size, at, made = piece.column(6).to_numpy(), [], []
                for k in np.flatnonzero(enough_shingles(words, starts, others, item_starts, smallest, rate)).tolist():
                    found = passage(words[starts[k] : starts[k + 1]], others[item_starts[k] : item_starts[k + 1]], int(size[k]), int(smallest[k]), rate)
                    if found:
                        at.append(k)
                        made.append(found)
                if at:
                    yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(at)) for c in range(4)), *(pa.array(x, pa.int32()) for x in zip(*made))], names=["doc_no", "doc_key", "item_key", "part", "n_words", "n_changes"])

    kinds = {n: t for n, t in columns.dtypes}
    found = columns.mapInArrow(verify, f"doc_no long, doc_key {kinds['doc_key']}, item_key {kinds['item_key']}, part string, n_words int, n_changes int")
    best = found.groupBy("doc_no", "doc_key", "item_key", "part").agg(F.max(F.struct("n_words", (-F.col("n_changes")).alias("m"))).alias("b"))
    return best.select("doc_key", "item_key", "part", F.col("b.n_words").alias("n_words"), (-F.col("b.m")).alias("n_changes"))
