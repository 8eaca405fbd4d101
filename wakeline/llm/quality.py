"""Problem 8: per-document text statistics and structural form.

Each line gives evidence for a form: rows of cells for `table`, marked or bare entries for `list`, encoded, garbled or
repeated matter for `junk`. Lines without a mark are judged as blocks: the block's distribution over function words and
character classes is compared with prose profiles of each language, and with profiles of bare entries and of garbled
letters, by Jensen-Shannon divergence; the nearest profile gives the block's form. A document's distribution of
characters over forms is then compared with the structural profiles in the same way and gets the nearest one.

The profiles are fitted on all documents: starting from the profiles below, each block and each document goes to the nearest
one, and a profile becomes the pooled distribution of what went to it. What the table has fewer than LEAST_WORDS words or
LEAST_DOCS documents of keeps its starting profile.

Texts are read once. What the reading leaves of each is stored: its statistics, characters by form, the counts of the few
blocks whose form hangs on the profiles, and what it adds to the fit. The sums of the fit and then the forms come from that.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.lineage import stored
from wakeline.names import fresh

PROSE, LIST, TABLE, JUNK = FORMS = ("prose", "list", "table", "junk")

LEAST_WORDS, LEAST_DOCS = 300, 30

#: Frequent function words by language.
FUNCTION_WORDS: dict[str, frozenset[str]] = {
    k: frozenset(v.split())
    for k, v in {
        "en": "the a an and or but if of to in on at by for from with as is are was were be been has have had it its this that these those not no only so than then there which who what when where why how does do did can could may might must will would should we i you he she they them us our your their one two before after because while until each every any all both into out about over under between without more most ever since however again",
        "de": "der die das den dem des ein eine einen einem einer und oder aber wenn von zu in im an am auf bei für mit als ist sind war waren wird werden wurde wurden hat haben hatte es er sie wir ich ihr nicht kein keine nur so dann dort was wer wie wo warum dass dafür nach vor aus durch ohne um auch noch immer wieder zwei bisher mehr muss müssen sich dieser diese dieses zum zur schon ihn",
        "fr": "le la les l un une des du de d et ou mais si dans en sur à au aux par pour avec comme est sont était a ont il elle ils nous je vous ne pas plus que qui quoi quand où pourquoi ce cette ces se s sa son ses après avant sans entre aucun aucune deux été être lorsque encore jusqu y tout toute n'a rien ensuite",
        "es": "el la los las un una unos unas y o pero si de del en a al por para con como es son era fue ha han se lo le que qué quien cuando donde porque no sin entre sobre después antes dos más ya su sus este esta estos muy todo toda hasta ningún ninguna ni nada otra otro hay siempre también cada ser está",
        "pt": "o a os as um uma uns umas e ou mas se de do da dos das em no na nos nas por para com como é são era foi foram ha há que quem quando onde porque não sem entre sobre depois antes dois duas mais já seu sua este esta muito todo toda até nenhum nenhuma nem nada outra outro ali ao à pelo pela também cada ser está",
        "ru": "и в во не на с со что как но по из к ко у за от до для о об это этот эта эти был была было были он она они мы я вы его её их если или же бы уже ещё только так там где когда почему после перед без при между два две нет ни все всё под над который которая которые того чтобы пока",
        "zh": "的 了 是 在 和 不 有 也 都 就 这 那 我 他 们 个 到 被 把 对 与 或 但 而 并 后 前 中 上 下 从 为 以 之 其 还 没 已 会 能 再 需 要",
    }.items()
}
#: Profiles of prose: (share of function words among words, of vowels among letters).
PROSE_PROFILES: dict[str, tuple[float, float]] = {"en": (0.40, 0.38), "de": (0.38, 0.37), "fr": (0.42, 0.44), "es": (0.42, 0.46), "pt": (0.42, 0.47), "ru": (0.28, 0.42), "zh": (0.20, 0.0)}
#: Structural profiles over the forms of characters; they lean to the form so that all are equally wide.
STRUCTURE: dict[str, tuple[float, float, float, float]] = {f: tuple(0.97 if g == f else 0.01 for g in FORMS) for f in FORMS}

_CJK = "㐀-鿿豈-﫿぀-ヿ가-힯"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_HAS_CJK = re.compile(f"[{_CJK}]")
_NO_VOWEL = re.compile(r"[^aeiouyáéíóúàèìòùâêîôûäëïöüãõåæøœаеёиоуыэюя]+")
_ASCII_VOWELS = dict.fromkeys(map(ord, "aeiouy"))
_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f�]")
_MOJIBAKE = re.compile(r"[À-ÿ][\x80-¿‘-„†-…‰‹›€™œžŸŒŠšŽˆ˜]|[ÃÂÐÑ][\x80-¿]|â€|ï»¿")
_ITEM = re.compile(r"\s*(?:[-*+•‣◦▪·–—>]\s+(?:\[[ xX]\]\s*)?|\(?(?:\d{1,4}|[A-Za-z]{1,2}|[ivxlIVXL]{1,5})[.):]\s+|\[[ xX]\]\s+)(?=\S)")
_BORDER = "|+:=-─━┼┬┴│┌┐└┘├┤ "
_HTML = re.compile(r"\s*</?(?:table|thead|tbody|tr|td|th|caption)\b", re.I)
_WIDE = re.compile(r"\s{2,}")
_ENCODED = re.compile(r"\s*(?:[A-Za-z0-9+/_-]{44,}={0,2}|(?:0x)?[0-9a-fA-F]{6,8}:?\s+(?:[0-9a-fA-F]{2,4}\s+){4,}.*|(?:[0-9a-fA-F]{2}[ :]){8,}.*|[0-9a-fA-F]{32,}(?:\s+[0-9a-fA-F]{6,})*|(?:\\x[0-9a-fA-F]{2}){6,}.*|(?:%[0-9A-Fa-f]{2}){6,}.*)\s*$")
_CODE = re.compile(r"\s*(?:diff --git |index [0-9a-f]{6,}\.\.|--- [ab/]|\+\+\+ [ab/]|@@ )")
#: Fences whose label does not say that they hold code.
_TEXT_FENCES = frozenset(["", "text", "txt", "plain", "plaintext", "log", "csv", "tsv", "table", "md", "markdown", "hex", "base64", "output"])
_CODE_LINE = re.compile(r"[{};\\]\s*$|^(?: {4}|\t)\s*\S|^\s*(?:def|class|import|from \w+ import|return|elif|else:|try:|except|func|fn|let|const|var|public|private|#include|#!|@\w|>>>|//|\$ )|[=!<>]=|\w\([^ )]*\)|[-=]>|^\s*[\w.]+\s*=\s*\S|::")
_HEAD = re.compile(r"\s*(?:#{1,6}\s|\[[^\]]{1,60}\]\s*$|={3,}\s*$|-{3,}\s*$)")
_INNER = re.compile(r"[^\W\d_][;\[\]{}<>^~][^\W\d_]")
_END = tuple(".!?。！？…:;\"'”»)")
_PLAIN = re.compile(r"[\w\s.,;:!?'\"()\-`/。，！？；：、（）“”‘’«»…—–]+")


def _jsd(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    d = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        if a > 0:
            d += a * log2(a / m) / 2
        if b > 0:
            d += b * log2(b / m) / 2
    return d


def _shape(common: float, vowels: float) -> tuple[float, ...]:
    """One distribution from both shares: half of it over words, half over letters."""
    return common / 2, (1 - common) / 2, vowels / 2, (1 - vowels) / 2


class Profiles(NamedTuple):
    prose: dict[str, tuple[float, ...]]
    bare: tuple[float, ...]
    garbled: tuple[float, ...]
    structure: dict[str, tuple[float, ...]]


START = Profiles({k: _shape(*v) for k, v in PROSE_PROFILES.items()}, _shape(0.04, 0.39), _shape(0.01, 0.21), STRUCTURE)
#: Of CJK blocks: (share of function characters, of lines with a sentence mark).
_CJK_PROSE, _CJK_BARE = (_shape(0.20, 0.80), _shape(0.25, 0.05)), _shape(0.03, 0.03)
_CJK_FUNCTION = FUNCTION_WORDS["zh"] | frozenset("은는이가을를의에다고")
_CJK_MARK = re.compile(r"[。，、；：！？!?]|[.,;:](?:\s|$)")

_LANGUAGES: dict[str, list[str]] = {}
for _lang, _common in FUNCTION_WORDS.items():
    for _w in _common:
        _LANGUAGES.setdefault(_w, []).append(_lang)


def common_share(words: list[str]) -> tuple[str, float]:
    """The language whose function words are the largest share of the words (lower case), and that share."""
    if not words:
        return "en", 0.0
    counts = Counter(words)
    found = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in _LANGUAGES.keys() & counts.keys():
        for lang in _LANGUAGES[w]:
            found[lang] += counts[w]
    lang = max(found, key=found.__getitem__)
    return lang, found[lang] / len(words)


def _garbled(text: str) -> bool:
    """Control or replacement characters, wrongly decoded bytes or mostly symbols."""
    solid = len(text) - text.count(" ")
    if not solid:
        return False
    if solid >= 6 and len(_PLAIN.sub("", text)) > 0.4 * solid:
        return True
    if text.isascii() and text.isprintable():
        return False
    return len(_BAD.findall(text)) > 0.04 * solid or 2 * len(_MOJIBAKE.findall(text)) > 0.16 * solid


def _level_1(c: str) -> bool:
    """Whether an ideograph is in the first, common level of GB 2312, Big5 or JIS X 0208."""
    for code, low, high in (("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6), ("shift_jis", 0x88, 0x97)):
        try:
            if low <= c.encode(code)[0] <= high:
                return True
        except UnicodeEncodeError:
            pass
    return False


def _cjk_form(lines: list[str], text: str) -> str:
    """`_block_form` of a block in Chinese, Japanese or Korean: its shares of function characters among characters, and of
    lines that hold a sentence mark among lines, are compared with the profiles of prose and of bare entries. Ideographs most
    of which are rare are random matter."""
    chars = _HAS_CJK.findall(text)
    ideographs = [c for c in chars if "\u3400" <= c <= "\u9fff"]
    if len(ideographs) >= 10 and sum(map(_level_1, ideographs)) < 0.7 * len(ideographs):
        return JUNK
    share = sum(c in _CJK_FUNCTION or "\u3041" <= c <= "\u309f" for c in chars) / len(chars)
    marked = sum(_CJK_MARK.search(x) is not None for x in lines) / len(lines)
    mine = _shape(share, marked)
    short = sum(map(len, lines)) / len(lines) < 25
    return LIST if len(lines) >= 3 and short and marked < 0.5 and _jsd(mine, _CJK_BARE) < min(_jsd(mine, p) for p in _CJK_PROSE) else PROSE


def _shares(words: list[str], lang: str) -> tuple[int, int, int, str]:
    """(function words, vowels, letters, the letters) of a block's words."""
    letters = "".join(filter(str.isalpha, words))
    vowels = len(letters) - len(letters.translate(_ASCII_VOWELS)) if letters.isascii() else len(_NO_VOWEL.sub("", letters))
    return sum(map(FUNCTION_WORDS[lang].__contains__, words)), vowels, len(letters), letters


class Block(NamedTuple):
    """Counts of a block of lines without marks. It may be bare if its lines are at least three, short and mostly without an end;
    its lines are sparse if they have few words."""

    size: int
    common: int
    words: int
    vowels: int
    letters: int
    may_be_bare: bool
    sparse: bool


def _block(lines: list[str], words: list[str], lang: str) -> tuple[str | None, Block]:
    """The form of a block of lines without marks in a document of the language, if that is the same with any profiles, and the
    counts that give it otherwise."""
    text = " ".join(lines)
    common, vowels, letters, _ = _shares(words, lang)
    short = sum(map(len, lines)) < 60 * len(lines)
    may_be_bare = len(lines) >= 3 and short and sum(x.rstrip().endswith(_END) for x in lines) < 0.5 * len(lines)
    block = Block(sum(map(len, lines)), common, len(words), vowels, letters, may_be_bare, len(words) <= 4 * len(lines))
    if _garbled(text) or not words:
        return JUNK, block
    if not text.isascii() and len(_HAS_CJK.findall(text)) > 0.2 * len(words):
        return _cjk_form(lines, text), block
    share = common / len(words)
    if share < 0.06 and len(_INNER.findall(text)) > 0.08 * len(words) >= 0.8:
        return JUNK, block
    return None if may_be_bare or _may_be_garbled(block) else PROSE, block


def _may_be_garbled(block: Block) -> bool:
    return block.letters >= 30 and block.vowels / block.letters < 0.29


def _block_form(block: Block, lang: str, profiles: Profiles) -> str:
    """Form of a block that `_block` leaves open: the nearest of the prose profile of the language and the bare-entry and garbled
    ones."""
    share, vowels = block.common / block.words, block.vowels / max(1, block.letters)
    mine = _shape(share, vowels)
    near = {LIST: _jsd(mine, profiles.bare), JUNK: _jsd(mine, profiles.garbled), PROSE: min(_jsd(mine, profiles.prose[lang]), _jsd(mine, _shape(0.22, PROSE_PROFILES[lang][1])))}
    if _may_be_garbled(block) and near[JUNK] < near[LIST] and near[JUNK] < near[PROSE]:
        return JUNK
    return LIST if block.may_be_bare and (near[LIST] < near[PROSE] or block.sparse and share < 0.25) else PROSE


def _cells(line: str) -> int:
    """How many cells the line is a row of; 0 if it is none."""
    s = line.strip()
    if "|" in s and len(s) > 1 and s[0] == "|" and s[-1] == "|":
        return s.count("|") - 1
    if "\t" in line:
        return line.count("\t") + 1
    for mark in ";,|":
        n = s.count(mark)
        if n and mark + " " not in s.replace(" | ", "|") and n * 40 >= len(s):
            parts = s.split(mark)
            if all(len(p.split()) <= 3 for p in parts):
                return n + 1
    parts = _WIDE.split(s)
    return len(parts) if len(parts) > 1 and max(len(p.split()) for p in parts) <= 3 else 0


def _is_border(bare: str) -> bool:
    return not bare.strip(_BORDER) and ("|" in bare or "---" in bare or "===" in bare or "──" in bare)


def _tabular(rows: list[int]) -> list[bool]:
    """Which lines are rows of a table: those with as many cells as a neighbour (or one more or less, for blank cells)."""
    n = len(rows)
    return [rows[i] > 1 and any(0 <= j < n and rows[j] > 1 and abs(rows[j] - rows[i]) <= 1 for j in (i - 2, i - 1, i + 1, i + 2)) for i in range(n)]


def _repeated(text: str, words: list[str]) -> bool:
    """A few words, characters, phrases or lines over and over."""
    t = text.strip()
    if len(words) >= 8 and len(set(words)) <= (2 if len(t) < 80 else 3 if len(words) < 75 else 0.04 * len(words)):
        return True
    if len(t) < 80:
        return False
    period = t.find(t[: 2 * len(t) // 3], 1)  # after it two thirds of the text come again; if it has a shorter period, it is found
    if period > 0 and t.startswith(t[period:]):
        return True
    lines = t.split("\n")
    if len(lines) >= 4 and len(set(lines)) <= 0.2 * len(lines) or len(set(t)) <= 4:
        return True
    return len(set(words)) < 0.25 * len(words) + 4 and len(t) >= 300 and len(zlib.compress(t.encode("utf-8", "replace"), 1)) < 0.05 * len(t)


def _is_code(lines: list[str]) -> bool:
    """Whether at least half of the lines that are not blank look like code."""
    shown = [x for x in lines if x.strip()]
    return 2 * sum(_CODE_LINE.search(x) is not None for x in shown) >= len(shown)


def _bears_marks(bare: str, tabular: bool) -> bool:
    """Whether a line in a fence is encoded, a row of a table or an entry; rows and entries that look like code are none."""
    if _ENCODED.match(bare) or _HTML.match(bare) or ("|" in bare or "+" in bare) and _is_border(bare):
        return True
    return (tabular or _ITEM.match(bare) is not None) and _CODE_LINE.search(bare) is None


def _sorted_lines(text: str) -> tuple[dict[str, int], list[list[str]], list[str]]:
    """Characters by form of the lines that bear marks, the blocks of lines without, and the lines that are in no block.
    Code and headings count for no form. Lines in a fence count by their marks, unless the fence is marked as code; those
    without marks are taken for code. A fence that is never closed is none, unless most of what follows it is code."""
    weight = dict.fromkeys(FORMS, 0)
    lines = text.split("\n")
    rows = [_cells(x) if x.strip() else -1 for x in lines]
    shown = [i for i, r in enumerate(rows) if r >= 0]
    table = dict(zip(shown, _tabular([rows[i] for i in shown])))
    blocks: list[list[str]] = [[]]
    rest: list[str] = []

    def close() -> None:
        if blocks[-1]:
            blocks.append([])

    fences = [i for i, x in enumerate(lines) if x.strip().startswith(("```", "~~~"))]
    stray = fences[-1] if len(fences) % 2 and not _is_code(lines[fences[-1] + 1 :]) else -1
    fenced = marked = code = outside = False
    for i, line in enumerate(lines):
        bare = line.strip()
        if bare.startswith(("```", "~~~")):
            close()
            if i != stray:
                fenced = not fenced
                marked = fenced and bare.strip("`~ ").lower() not in _TEXT_FENCES
                code, outside = (False, code) if fenced else (outside, False)
        elif fenced and not (_CODE.match(bare) if not bare or marked or code else _bears_marks(bare, table[i]) or _CODE.match(bare)) and not _ENCODED.match(bare):
            pass
        elif not bare:
            close()
            code = False
        elif _CODE.match(bare):
            close()
            code = True
        elif code and line[:1] in "+- ":
            pass
        elif _ENCODED.match(bare):
            close()
            code = False
            weight[JUNK] += len(bare)
        elif _HTML.match(bare) or (table[i] and not _ITEM.match(bare)) or (("|" in bare or "+" in bare) and _is_border(bare)):
            close()
            code = False
            weight[JUNK if _garbled(bare) and "|" not in bare and "\t" not in line and "<t" not in bare else TABLE] += len(bare)
        elif _HEAD.match(bare):
            close()
            code = False
        elif (m := _ITEM.match(bare)) and bare[0] != ">":
            close()
            code = False
            weight[JUNK if _garbled(bare[m.end() :]) and len(bare) > 40 else LIST] += len(bare)
        else:
            code = False
            blocks[-1].append(bare)
            continue
        rest.append(bare)
    close()
    return weight, blocks[:-1], rest


def verdict(text: str | None) -> str:
    """prose, list, table or junk: the structural profile nearest to the distribution of the text's characters over forms."""
    return measures(text)[-1]


def _nearest(weight: dict[str, int], n_words: int, structure: dict[str, tuple[float, ...]]) -> str:
    total = sum(weight.values())
    if not total:
        return PROSE if n_words else JUNK
    mine = tuple(weight[f] / total for f in FORMS)
    return min(FORMS, key=lambda f: (_jsd(mine, structure[f]), FORMS.index(f)))


class Reading(NamedTuple):
    """What is kept of a text: statistics, language, characters by form (None if the text is junk whatever its lines are), the
    blocks that are left open, and for the fit the form, the shares of characters over FORMS and the counts over _POOLED (function
    words, words, vowels, letters of each) that the starting profiles give, or None."""

    n_words: int
    mean_word_length: float
    symbol_ratio: float
    line_end_share: float
    common_word_share: float
    lang: str
    weight: dict[str, int] | None
    opened: list[Block]
    start_form: str | None = None
    start_shares: tuple[float, ...] | None = None
    pooled: list[int] | None = None


_POOLED = (PROSE, LIST, JUNK)


def read(text: str | None, start: Profiles = START) -> Reading:
    """A text's reading; `start` only decides what it adds to the fit."""
    if text is None or not text.strip():
        return Reading(0, 0.0, 0.0, 0.0, 0.0, "en", None, [])
    weight, blocks, rest = _sorted_lines(text)
    by_block = [_WORD.findall("\n".join(b).lower()) for b in blocks]
    words = [w for b in by_block for w in b] + _WORD.findall("\n".join(rest).lower())
    solid = len("".join(text.split()))
    letters = sum(map(len, words))
    lines = [x.rstrip() for x in text.split("\n") if x.strip()]
    lang, share = common_share(words)
    stats = len(words), letters / len(words) if words else 0.0, 1 - letters / solid, sum(x.endswith(_END) for x in lines) / len(lines), share
    if _repeated(text, words):
        return Reading(*stats, lang, None, [])
    opened, pooled, started = [], [0] * 4 * len(_POOLED), dict(weight)
    for b, w in zip(blocks, by_block):
        form, block = _block(b, w, lang)
        if form is None:
            opened.append(block)
            at_start = _block_form(block, lang, start)
        else:
            at_start = form
            weight[form] += block.size
        started[at_start] += block.size
        if w and (text.isascii() or not _HAS_CJK.search("".join(b))):
            first = 4 * _POOLED.index(at_start)
            for i, x in enumerate((block.common, block.words, block.vowels, block.letters), first):
                pooled[i] += x
    total = sum(started.values())
    if not total:
        return Reading(*stats, lang, weight, opened)
    return Reading(*stats, lang, weight, opened, _nearest(started, len(words), start.structure), tuple(started[f] / total for f in FORMS), pooled if any(pooled) else None)


def _form(weight: dict[str, int] | None, opened: Iterable[Block], lang: str, n_words: int, profiles: Profiles) -> str:
    """The form of a document from its reading."""
    if weight is None:
        return JUNK
    weight = dict(weight)
    for block in opened:
        weight[_block_form(block, lang, profiles)] += block.size
    return _nearest(weight, n_words, profiles.structure)


def _pool(sums: Iterable[tuple], start: Profiles) -> Profiles:
    """The profiles from sums over documents: language, form, number, sums of shares, sums of counts (None where there are none)."""
    pooled: dict[tuple[str, str], list[int]] = {}
    docs = dict.fromkeys(FORMS, 0)
    shares = {f: [0.0] * len(FORMS) for f in FORMS}
    for lang, form, n, share, counts in sums:
        if form is None:
            continue
        docs[form] += n
        shares[form] = [a + float(b) for a, b in zip(shares[form], share)]
        for i, f in enumerate(_POOLED):
            mine = pooled.setdefault((f, lang if f == PROSE else ""), [0, 0, 0, 0])
            for j, x in enumerate(counts[4 * i : 4 * i + 4] if counts else ()):
                mine[j] += x or 0

    def shape(key: tuple[str, str], other: tuple[float, ...]) -> tuple[float, ...]:
        common, n, vowels, letters = pooled.get(key, (0, 0, 0, 0))
        return _shape(common / n, vowels / letters) if n >= LEAST_WORDS and letters else other

    return Profiles(
        {k: shape((PROSE, k), v) for k, v in start.prose.items()}, shape((LIST, ""), start.bare), shape((JUNK, ""), start.garbled),
        {f: tuple((x / docs[f] + 0.01) / 1.04 for x in shares[f]) if docs[f] >= LEAST_DOCS else start.structure[f] for f in FORMS},
    )


def fit_profiles(texts: Iterable[str | None], start: Profiles = START) -> Profiles:
    """The profiles that pool what is nearest to each of the starting ones; see the top of this module."""
    return _pool(((r.lang, r.start_form, 1, r.start_shares, r.pooled) for r in (read(t, start) for t in texts)), start)


def fit_stored(made: DataFrame) -> Profiles:
    """`fit_profiles` from a table of readings. Its sums are exact, so the order of the rows makes no difference."""
    each = lambda name, n, kind: F.array(*(F.sum(F.col(name)[i].cast(kind)) for i in range(n)))
    by = made.where("start_form IS NOT NULL").groupBy("lang", "start_form")
    sums = by.agg(F.count("*"), each("start_shares", len(FORMS), "decimal(20,18)"), each("pooled", 4 * len(_POOLED), "long"))
    return _pool(sorted((tuple(r) for r in sums.collect()), key=lambda r: r[:2]), START)


_STATS = [("n_words", pa.int64(), "long"), ("mean_word_length", pa.float64(), "double"), ("symbol_ratio", pa.float64(), "double"), ("line_end_share", pa.float64(), "double"), ("common_word_share", pa.float64(), "double"), ("form", pa.string(), "string")]
#: Columns of stored readings after the statistics; characters by form are in the order of FORMS, open blocks one after the other.
_KEPT = [("lang", pa.string(), "string"), ("weight", pa.list_(pa.int64()), "array<long>"), ("opened", pa.list_(pa.int32()), "array<int>"), ("start_form", pa.string(), "string"), ("start_shares", pa.list_(pa.float64()), "array<double>"), ("pooled", pa.list_(pa.int64()), "array<long>")]


def measures(text: str | None, profiles: Profiles = START) -> tuple[int, float, float, float, float, str]:
    """Word count, mean word length, symbol ratio, share of lines that end in punctuation, share of common words, form."""
    r = read(text)
    return *r[:5], _form(r.weight, r.opened, r.lang, r.n_words, profiles)


def readings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key as `k` and the reading of each text."""
    columns = [*_STATS[:-1], *_KEPT]
    schema = ", ".join([f"k {docs.schema[key].dataType.simpleString()}", *(f"{n} {t}" for n, _, t in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(*r[:6], None if r.weight is None else [r.weight[f] for f in FORMS], [int(x) for b in r.opened for x in b], *r[8:]) for r in map(read, batch.column(1).to_pylist())]
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t, _) in zip(zip(*made), columns))], names=["k", *(n for n, _, _ in columns)])

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, schema)


def text_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, n_words (a CJK character is a word), mean_word_length, symbol_ratio (share of characters other than letters,
    digits and white space), line_end_share, common_word_share (in the language where it is largest) and form.

    One row per row of `docs`. Null and blank texts have zeros and the form junk. A key named like a statistic makes the
    statistic's name get an underscore before it. Only the two columns are read, once; only sums by language and form are
    shuffled and reach the driver.
    """
    made = stored(readings(docs, key, text))
    profiles = tuple(fit_stored(made))  # a plain tuple travels without this package
    names = [key, *fresh([key], *(n for n, _, _ in _STATS))]
    schema = ", ".join([f"`{key}` {docs.schema[key].dataType.simpleString()}", *(f"`{n}` {t}" for n, (_, _, t) in zip(names[1:], _STATS))])
    width = len(Block._fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Profiles(*profiles)
        for batch in batches:
            forms = []
            for n_words, lang, weight, opened in zip(*(batch.column(i).to_pylist() for i in (1, 6, 7, 8))):
                blocks = (Block(*opened[i : i + width]) for i in range(0, len(opened), width))
                forms.append(_form(weight and dict(zip(FORMS, weight)), blocks, lang, n_words, fitted))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(forms, pa.string())], names=names)

    return made.select("k", *(n for n, _, _ in _STATS[:-1]), "lang", "weight", "opened").mapInArrow(run, schema)
