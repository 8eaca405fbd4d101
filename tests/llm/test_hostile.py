"""Texts that make careless patterns take quadratic time, and random characters: nothing fails or hangs."""

import random
from collections import Counter

import numpy as np
import pytest

from wakeline.llm import leaks, pairs, pieces, quality, splits

N = 10_000
HOSTILE = ["x" * 2 * N, "word " * N, "a,b\n" * N, "- x\n" * N, "`" * 2 * N, "字" * 2 * N, "a" + "\n" * N + "b", "<a " * N, '"' * N, "| " * N, "(" * N, "1." * N, "a b. " * N, " " * N + "x", "[;" * N, "*_#> " * N, "-" * N, "diff --git \n" * N, "." * N, 'a."' * N, "a" + " " * N + "b", "[truncated " * N]


@pytest.mark.parametrize("text", HOSTILE, ids=lambda t: repr(t[:6]))
def test_hostile_texts(text):
    model = np.zeros((pairs.GRAMS, len(pairs.LANGUAGES)), np.float32)
    assert quality.verdict(text) in quality.FORMS
    pairs.defect_of(text, [text], text + "!", model, {}, {})
    pairs.defect_of(text, [], text, model, {}, {})
    pairs.end_counts(text[: N // 4], Counter(), Counter(), Counter())
    assert pieces.spans(text)[-1][1] == len(text)
    assert leaks.search([text], leaks.build_index([(1, "p", " ".join(f"w{k}" for k in range(30)))])) == []


def test_random_characters():
    rnd = random.Random(0)
    pools = ["abc ,.;:\n\t-*|`\"'#<>[](){}0123", "​  　。！？字漢한Äßñжé\U0001f600\x00\x01\x85�", "aA1 \n"]
    model = np.zeros((pairs.GRAMS, len(pairs.LANGUAGES)), np.float32)
    for _ in range(1500):
        s = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.choice([0, 1, 2, 5, 30, 200])))
        quality.measures(s)
        pairs.defect_of(s, [s, None], s + rnd.choice(["", "x", s]), model, {}, {})
        pieces.spans(s, 20, 5)
        splits.keys_of(s)
