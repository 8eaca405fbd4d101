"""Problem 2: broken prompt and response pairs.

A response (summary) is flagged with one defect, the first that holds:

- `empty`: nothing is left once headings, placeholders and markup are taken away;
- `refusal`: most of it are sentences in which the writer declines, or courtesies around them; quotations don't count;
- `echo`: nearly all its word shingles are contained in the task or in the assistant contents of the steps;
- `other_language`: by the posteriors of prompt and response under a character n-gram naive Bayes model, they are hardly in one
  language (probability below SAME_LANGUAGE);
- `truncated`: open code, a cut mark, or a last sentence without a mark at its end whose end has a low likelihood under the
  end-of-text n-gram model; more is asked of it in texts whose other sentences or items are closed by a mark, less of an item.

Language model: trigrams hashed into GRAMS buckets, fitted on at most SAMPLE labelled documents of each language (those
with the smallest hash of their text); of fixed size, it is what the driver gets and broadcasts. End-of-text model: for word
n-grams at the end of a sentence so far, how often the sentence ended there, counted over all responses by 64-bit keys. It
grows with the data and stays distributed: a response is joined with the counts of the n-grams at its end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.deliveries import arrival, once

LANGUAGES = ("en", "de", "fr", "es", "pt", "ru", "zh")
SAMPLE, GRAMS = 300, 1 << 16
ECHO_SHARE, DECLINE_SHARE, SAME_LANGUAGE, END_LIKELIHOOD, STYLED_LIKELIHOOD, ITEM_LIKELIHOOD, LEAST_SEEN = 0.7, 0.4, 0.02, 0.5, 0.6, 0.1, 3
_CJK = "㐀-鿿豈-﫿぀-ヿ가-힯"
_WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­\x00-\x08]")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~).*$", re.M)
_FENCED = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?^[ \t]*\1[^\n]*$", re.M | re.S)
_TAG = re.compile(r"</?[A-Za-z][\w.-]*(?:\s[^<>]*)?/?>")
_SPAN = re.compile(r"`[^`\n]*`")
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|「[^」\n]*」')
_IDENT = re.compile(r"[_/\\@#=<>{}\[\]]|\w\.\w")
_CJK_RUN = re.compile(f"([{_CJK}，。、；：？！]+)")
_MARK = re.compile(r"^\s*(?:[-*+•–>]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])(?:\s+|$)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]»”]*\s+|(?<=[。！？])|;\s+")
_CUT = re.compile(r"(?:[\[<(]\s*(?:\.{3}|…)?\s*(?:truncated|max[ _-]?tokens|token limit|cut(?: off)?|length limit|end of (?:output|buffer))[^\]>)]{0,80}[\]>)])\s*$", re.I)
_OPEN_END = re.compile(r"[,:：，、(\[{（/=<&+\\]\s*$")
_CLOSED = re.compile(r"(?:[.!?。！？](?:[\"')\]»”*_]|</\w+>)*)\s*$")
_LABEL = re.compile(r"^[*_#>\s]*(?:summary|resumen|resumo|résumé|zusammenfassung|итог|резюме|摘要|总结)\s*[:：]?[*_]*\s*[:：]?\s*", re.I)
#: Texts that stand for no text.
PLACEHOLDERS = frozenset("none null nil nan na n/a n.a todo tbd tba fixme empty placeholder undefined unknown pending blank summary untitled test xxx lorem".split()) | {"no summary", "not available", "not applicable", "no content", "to do", "to be done", "no data"}
#: What a writer is asked to do with a run, in English; who cannot do anything else (reproduce a failure, merge) describes the run.
_ANSWERS = "help|assist|comply|answer|respond|summari[sz]\\w*|describ\\w*|provid\\w*|produc\\w*|process|view\\w*|access|share|fulfil\\w*|support|discuss\\w*|recap|engage|continue with (?:this|that|the) request|do (?:that|this|so)|complete (?:this|that|the|your) (?:request|task)"
#: Ways to decline, by language: the writer speaks of themself.
DECLINES = re.compile("|".join([
    rf"\b(?:i|we|i'm|we're)\b(?:\W+\w+(?:'\w+)?){{0,3}}?\W+(?:can ?not|can't|couldn't|won't|wouldn't|not|unable|decline|refuse|refrain)\b(?:\W+(?:be|able|to|from|possibly|really|directly|or|go|further)\b){{0,4}}\W+(?:{_ANSWERS})\b",
    r"\bsomething (?:that )?(?:i|we) (?:can ?not|can't|won't|may not|am not able to|am unable to) do\b", r"\bi (?:do not|don't) have (?:access|permission|the ability)\b", r"\bi (?:must|have to|need to) (?:decline|refuse)\b",
    r"\bmy (?:guidelines|instructions|policy|policies|rules|programming)\b", r"\bnot (?:be )?(?:appropriate|possible|right|able) for me\b", r"\bas an ai\b",
    r"\bno puedo\b", r"\bno me es posible\b", r"\b(?:debo|tengo que) (?:rechazar|negarme|declinar)\b", r"\bno tengo (?:acceso|permiso)\b", r"\bno (?:podré|estoy autorizad)",
    r"\bnão (?:posso|consigo|poderei)\b", r"\bnão me é possível\b", r"\b(?:preciso|devo|tenho (?:que|de)) (?:recusar|declinar)\b", r"\bnão tenho (?:acesso|permissão)\b",
    r"\bje ne (?:peux|puis|pourrai|saurais)\b", r"\bje (?:dois|suis (?:obligé|contraint) de) (?:refuser|décliner)\b", r"\b(?:il )?m'est impossible\b", r"\bje n'ai pas (?:accès|le droit)\b", r"\bje refuse\b",
    r"\b(?:kann|darf|werde|möchte) ich\b.{0,80}\bnicht\b", r"\bich (?:kann|darf|werde|möchte)\b.{0,80}\bnicht\b", r"\bmuss ich\b.{0,60}\bablehnen\b", r"\bich muss\b.{0,60}\bablehnen\b", r"\bich habe keinen zugriff\b", r"\bhabe ich keinen zugriff\b", r"\bist (?:es )?mir (?:es )?(?:leider )?nicht (?:möglich|erlaubt|gestattet)\b",
    r"\b(?:я )?не (?:могу|смогу|имею)\b", r"\bвынужден[а]? отказ", r"\b(?:должен|должна) отказ", r"\bу меня нет (?:доступа|права|возможности)", r"\bмне не (?:разрешено|позволено)",
    r"我(?:无法|不能|不可以|没有(?:权限|办法|访问)|无权|必须拒绝|只能拒绝|不得不拒绝|拒绝)", r"(?:抱歉|对不起|很遗憾|遗憾).{0,20}(?:无法|不能|拒绝|没有权限)", r"(?:无法|不能)(?:协助|帮助|提供|满足|完成|处理|总结|概括)(?:您|你|这|该|此)",
]), re.I)
#: Courtesies that say nothing of the run.
COURTESY = re.compile("|".join([
    r"\b(?:sorry|apologi[sz]e|unfortunately|regrettably|thank you|thanks for|let me know|is there (?:something|anything) else|feel free|if you (?:share|provide|send|can)|i understand|happy to|please (?:let|provide|share))\b",
    r"lo siento|lamentablemente|gracias por|si (?:compartes|me)|desculpe|infelizmente|obrigad|sinto muito|désolé|malheureusement|merci (?:de|pour)|tut mir leid|leider|danke|entschuldigung|извин|к сожалению|прости|спасибо|抱歉|对不起|遗憾|谢谢",
]), re.I)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def plain(text: str | None) -> str:
    """The text without invisible characters, tags and outer white space."""
    return _TAG.sub("\n", _INVISIBLE.sub("", text or "")).strip()


def is_heading(line: str) -> bool:
    """A few words and a colon."""
    t = line.rstrip(" *_")
    return t.endswith((":", "：")) and len(t.strip("#=*_>- ").split()) <= 4


def is_empty(text: str | None) -> bool:
    """Null, blank, or nothing but headings, placeholders and markup."""
    kept = []
    for line in _FENCE.sub("", plain(text)).split("\n"):
        bare = line.strip()
        if not bare or bare.startswith("#") or is_heading(bare):
            continue
        kept.append(bare)
    rest = " ".join(kept).strip(" \t*_-–—•.:()[]{}<>/|\"'`~…=+").lower()
    return not re.search(r"[^\W_]", rest) or rest in PLACEHOLDERS


def sentences(text: str) -> list[str]:
    return [s.strip() for line in text.split("\n") for s in _SENTENCE.split(_MARK.sub("", line)) if s and s.strip()]


#: Numbers, code (a span is " C " here) and paths: of a run, not of a request.
_OF_A_RUN = re.compile(r"\d|(?<!\S)C(?!\S)|\w[./_]\w|\w\(")


def is_refusal(text: str) -> bool:
    """Mostly declining, or courtesies around it; what is quoted or in code is not the writer's, and who tells numbers, code or
    paths describes the run."""
    own = [s for s in sentences(_LABEL.sub("", _QUOTED.sub(" ", _SPAN.sub(" C ", _FENCED.sub("", plain(text)))))) if words_of(s)]
    size = {i: len(words_of(s)) for i, s in enumerate(own)}
    declining = {i for i, s in enumerate(own) if DECLINES.search(s.replace("’", "'")) and not _OF_A_RUN.search(s)}
    polite = {i for i, s in enumerate(own) if COURTESY.search(s.replace("’", "'"))}
    return bool(declining) and sum(size[i] for i in declining | polite) >= DECLINE_SHARE * sum(size.values())


def echo_share(response: str, prompt: list[str], n: int = 3) -> float:
    """Share of the response's shingles of n words that the prompt's texts contain; 0 for less than n words."""
    w = words_of(_LABEL.sub("", plain(response)))
    if len(w) < n:
        return 0.0
    mine = list(zip(*(w[k:] for k in range(n))))
    first = set(mine)
    known: set = set()
    for t in prompt:
        x = words_of(t)
        known |= first.intersection(zip(*(x[k:] for k in range(n))))
    return sum(g in known for g in mine) / len(mine)


def letters_of(text: str | None) -> str:
    """Natural language of the text: without code, quotations, identifiers, numbers and marks; lower case."""
    t = _CJK_RUN.sub(r" \1 ", _QUOTED.sub(" ", _SPAN.sub(" ", _FENCED.sub(" ", plain(text)))))
    return " " + " ".join(re.findall(r"[^\W\d_]+", " ".join(w for w in t.lower().split() if not _IDENT.search(w)))) + " "


def grams(letters: str) -> np.ndarray:
    """Bucket of each character trigram."""
    c = np.frombuffer(letters.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(16)
    return (h % np.uint64(GRAMS)).astype(np.int64)


def language_code(label: str | None) -> str | None:
    """A label in any spelling as one of LANGUAGES, else None."""
    code = re.match(r"\s*([a-z]{2})(?![a-z])", (label or "").lower())
    return code[1] if code and code[1] in LANGUAGES else None


def fit_languages(rows: list[tuple[str, str]]) -> np.ndarray:
    """Log-probabilities [GRAMS, languages] from (text, language); wrongly labelled rows are dropped by a second fit."""

    def fit(kept: list[tuple[np.ndarray, int]]) -> np.ndarray:
        counts = np.zeros((len(LANGUAGES), GRAMS), np.float64)
        for g, k in kept:
            counts[k] += np.bincount(g, minlength=GRAMS)
        total = counts.sum(1, keepdims=True)
        # the same share for trigrams never seen, however much there is of a language: they tell nothing
        share = counts / np.maximum(total, 1) + 0.05 / max(1.0, total.sum() / max(1, (total > 0).sum()))
        return np.log(share / share.sum(1, keepdims=True)).T.astype(np.float32)

    data = [(g, LANGUAGES.index(lang)) for t, lang in rows if len(g := grams(letters_of(t)))]
    model = fit(data)
    return fit([(g, k) for g, k in data if model[g].sum(0).argmax() == k])


def posteriors(text: str | None, model: np.ndarray) -> np.ndarray:
    """Probability of each language by naive Bayes with equal priors; equal for a text without letters."""
    x = model[grams(letters_of(text))].sum(0, dtype=np.float64)
    x = np.exp(x - x.max())
    return x / x.sum()


def other_language(prompt: str | None, response: str, model: np.ndarray) -> bool:
    """Whether prompt and response are hardly in one language, by the posteriors of both."""
    return float(posteriors(prompt, model) @ posteriors(response, model)) < SAME_LANGUAGE


def tokens_of(sentence: str) -> list[str]:
    """Words of a sentence with code and numbers each as one mark."""
    return [w if w[0] != "0" else "0" for w in _WORD.findall(re.sub(r"\d+(?:\.\d+)*", "0", _SPAN.sub(" codespan ", sentence)).lower())]


def _key(gram: str) -> int:
    """64-bit hash of an n-gram; the kind is part of it. That of a single word ("1...") is odd, all others are even."""
    h = int.from_bytes(blake2b(gram.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    return h | 1 if gram[0] == "1" else h & ~1


def end_contexts(w: list[str], k: int) -> list[int]:
    """Keys of the n-grams that end at word k: two with the sentence's start, one with gaps, then of three, two and one words."""
    start, last = " ".join(w[:2]), w[k]
    before = w[k - 1] if k else "^"
    more = w[k - 2] if k > 1 else "^"
    skip = f"{w[k - 5]} {w[k - 3]} {before}" if k > 4 else f"^ {before}"
    return [_key(x) for x in (f"A{start}|{before} {last}", f"B{start}|{before}", f"S{skip}", f"3{more} {before} {last}", f"2{before} {last}", f"1{last}")]


def word_contexts(word: str) -> list[int]:
    """Keys of the character trigrams of a word, that of its end last."""
    x = "^" + word
    return [_key("W" + x[i : i + 3]) for i in range(max(1, len(x) - 2))]


def end_counts(text: str | None, ended: Counter, seen: Counter, words: Counter) -> None:
    """Adds the text's sentences to the counts. Its last sentence counts without its end, unless it is closed by a mark."""
    body = _FENCED.sub("", plain(text))
    lines = [x for x in body.split("\n") if x.strip()]
    for i, line in enumerate(lines):
        parts = [s for s in _SENTENCE.split(_MARK.sub("", line)) if s and s.strip()]
        for j, s in enumerate(parts):
            w = tokens_of(s)
            whole = _CLOSED.search(s) is not None or i + 1 < len(lines) and j + 1 == len(parts)
            n = len(w) - (not whole)
            words.update(w[:n])
            for k in range(n):
                c = end_contexts(w, k)
                seen.update(c)
                if k + 1 == len(w):
                    ended.update(c)


def word_counts(words: Counter, ended: Counter, seen: Counter) -> None:
    """Adds where in words character trigrams stand: `ended` counts those at a word's end."""
    for w, n in words.items():
        c = word_contexts(w)
        for x in c:
            seen[x] += n
        ended[c[-1]] += n


def end_likelihood(w: list[str], ended: dict[int, int], seen: dict[int, int]) -> float:
    """How likely a sentence of these words ends here. A word never seen whose last trigram ends no word is taken as cut off."""
    return likelihood(end_keys(w), ended, seen)


def end_keys(w: list[str]) -> list[int]:
    """The keys whose counts `likelihood` looks at."""
    return [*end_contexts(w, len(w) - 1), word_contexts(w[-1])[-1]]


def likelihood(keys: list[int], ended: dict[int, int], seen: dict[int, int]) -> float:
    """`end_likelihood` by the keys of the sentence's end."""
    a, b, skip, three, two, one, word = keys
    p = lambda c: ended.get(c, 0) / seen[c] if seen.get(c, 0) >= LEAST_SEEN else None
    if not seen.get(one):
        if (x := p(word)) is not None and x < 0.02:
            return 0.0
        return x if (x := p(b)) is not None else 0.5
    known = [x for x in (p(a), p(b), p(skip), p(three) if p(three) is not None else p(two) if p(two) is not None else p(one)) if x is not None]
    return sum(known) / len(known) if known else 0.5


def is_truncated(text: str, ended: dict[int, int], seen: dict[int, int]) -> bool:
    """Breaks off inside code, a word, a sentence or a list item."""
    below, w = truncation(text)
    return below > 1 or below > 0 and end_likelihood(w, ended, seen) < below


ALWAYS = 2.0
HELD = 300_000  # n-grams and words that a task counts before it hands them on


def truncation(text: str) -> tuple[float, list[str]]:
    """(limit, last sentence): truncated if the sentence's end is less likely than the limit; 2 is always, 0 never."""
    body = _INVISIBLE.sub("", text).strip()
    if _CUT.search(body):
        return ALWAYS, []
    body = plain(body)
    if len(_FENCE.findall(body)) % 2:
        return ALWAYS, []
    if re.search(r"^\s*(```|~~~)\s*$", body.rsplit("\n", 1)[-1]):
        return 0.0, []
    body = _FENCED.sub("", body).rstrip()
    lines = [x for x in body.split("\n") if x.strip()]
    if not lines:
        return 0.0, []
    last = lines[-1]
    item = _MARK.match(last)
    rest = (last[item.end() :] if item else last).strip()
    if not rest or rest.count("`") % 2 or _OPEN_END.search(rest) or rest.count("(") > rest.count(")"):
        return ALWAYS, []
    pieces = [s for s in _SENTENCE.split(rest) if s and s.strip()]
    w = tokens_of(pieces[-1]) if pieces else []
    if not w or set(w) == {"codespan"}:
        return 0.0, []
    if _CLOSED.search(rest):
        return 0.1 if w[-1] == "0" else 0.0, w
    if item:
        items = [x.rstrip() for x in lines[:-1] if _MARK.match(x)]
        return STYLED_LIKELIHOOD if items and all(_CLOSED.search(x) for x in items) else ITEM_LIKELIHOOD, w
    styled = len(pieces) > 1 or any(_CLOSED.search(x) for x in lines[:-1] if not _MARK.match(x))
    return STYLED_LIKELIHOOD if styled else END_LIKELIHOOD, w


def defect_of(task: str | None, contents: list[str | None], response: str | None, model: np.ndarray, ended: dict[int, int], seen: dict[int, int]) -> str | None:
    return earlier_defect(task, contents, response, model) or ("truncated" if is_truncated(response, ended, seen) else None)


def earlier_defect(task: str | None, contents: list[str | None], response: str | None, model: np.ndarray) -> str | None:
    """The defect, if it is another one than truncation."""
    if is_empty(response):
        return "empty"
    if is_refusal(response) and not echo_share(response, [c for c in contents if c]) >= ECHO_SHARE:
        return "refusal"
    if echo_share(response, [t for t in (task, *contents) if t]) >= ECHO_SHARE:
        return "echo"
    if other_language(task, response, model):
        return "other_language"
    return None


def language_model(labelled: DataFrame, text: str, label: str, sample: int = SAMPLE) -> np.ndarray:
    """`fit_languages` on at most `sample` rows of each language, those with the smallest hash of their text."""
    code = F.regexp_extract(F.lower(F.trim(F.col(label))), r"^([a-z]{2})(?![a-z])", 1)
    rows = labelled.select(F.col(text).alias("t"), code.alias("c")).where(F.col("c").isin(list(LANGUAGES)) & F.col("t").isNotNull())
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("t"), "t"))
    return fit_languages([(r.t, r.c) for r in rows.withColumn("r", rank).where(F.col("r") <= sample).collect()])


def end_model(responses: DataFrame, text: str) -> DataFrame:
    """c, e, n: how often each n-gram ended a sentence and stood at all, over all rows, by its key; it stays distributed.

    N-grams seen less than LEAST_SEEN times are left out, as `likelihood` makes no use of them; single words are all kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended, seen, words = Counter(), Counter(), Counter()

        def made() -> pa.RecordBatch:
            word_counts(words, ended, seen)
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array([ended[c] for c in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["c", "e", "n"])
            for x in (ended, seen, words):
                x.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                end_counts(t, ended, seen, words)
                if len(seen) + len(words) > HELD:
                    yield made()
        if seen:
            yield made()

    rows = responses.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "c long, e long, n long")
    return rows.groupBy("c").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where((F.col("n") >= LEAST_SEEN) | (F.col("c").bitwiseAND(F.lit(1)) == 1))


def defects(pairs: DataFrame, labelled: DataFrame, key: str = "trajectory_id", task: str = "task", steps: str = "steps", response: str = "summary", label_text: str = "text", label: str = "lang", at: str = "ingested_at") -> DataFrame:
    """key, defect of every pair that has one. A key delivered again counts once, the earliest by `at` if there is such a column.

    labelled: texts with a language label, from which the language model is fitted. Null tasks and steps count as empty, a
    null key stays null. Without labelled rows or known languages no pair is flagged for its language. Other columns are
    not read.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(language_model(labelled, label_text, label))
    s = F.col(steps)
    said = F.zip_with(s["role"], s["content"], lambda r, c: F.when(r == "assistant", c))
    first = once(pairs.select(F.col(key).cast("string").alias("k"), F.col(task).alias("t"), F.col(response).alias("r"), F.filter(said, lambda c: c.isNotNull()).alias("c"), arrival(pairs, at)), ["k"])
    rows = first.select("k", "t", "r", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, t, r, x in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found, below, w = earlier_defect(t, x or [], r, sent.value), 0.0, []
                if not found:
                    below, w = truncation(r)
                    found = "truncated" if below > 1 else None
                if found or below > 0:
                    for c, v in zip(out, (k, found, below, None if found else end_keys(w))):
                        c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())))], names=["k", "defect", "below", "keys"])

    judged = rows.mapInArrow(run, "k string, defect string, below double, keys array<long>")
    looked = judged.select("k", "defect", "below", "keys", F.explode_outer(F.array_distinct("keys")).alias("c")).join(end_model(first, "r"), "c", "left")
    counted = looked.groupBy("k", "defect", "below", "keys").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("c", "e", "n"))).alias("counts"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for k, defect, below, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not defect and likelihood(keys, {x["c"]: x["e"] for x in counts}, {x["c"]: x["n"] for x in counts}) < below:
                    defect = "truncated"
                if defect:
                    ids.append(k)
                    found.append(defect)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found)], names=[key, "defect"])

    return counted.mapInArrow(decide, f"`{key}` string, defect string")
