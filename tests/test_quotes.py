"""Quotes against passages: normalising, exact and near matches, and the search against a plain one."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest

from veritab.functions import quotes
from veritab.operators import texts

PASSAGE = "GraphDP achieves a mean F1 score of 0.64 and a mean AUC of 0.78 across projects."


def plain(quote, passage):
    q, p = quotes.normalise(quote), quotes.normalise(passage)
    if not q or q in p:
        return float(bool(q))
    if len(q) < 20 or len(p) < len(q) * 0.8:
        return 0.0
    best = 0.0
    for start in [0, *(m.end() for m in re.finditer(" ", p))]:
        window = p[start : start + len(q) + 5]
        if len(window) < len(q) * 0.8:
            break
        best = max(best, SequenceMatcher(None, q, window, autojunk=False).ratio())
        if best >= 0.99:
            break
    return round(best, 3)


def test_normalising_ignores_case_quotes_dashes_hyphens_and_forms():
    assert quotes.normalise("Cross\u2010project \u201cdefect\u201d  pre-\ndiction.") == quotes.normalise('cross-project "defect" prediction') == "crossproject defect prediction"
    assert quotes.normalise("The \ufb01rst e\ufb00ect\u00a0was \uff26ine\u00ad") == "the first effect was fine"


@pytest.mark.parametrize(
    "quote, passage, low, high",
    [
        ("achieves a mean F1 score of 0.64", PASSAGE, 1, 1), ("achieves a mean Fl score of 0.64 and a mean", PASSAGE, 0.9, 0.999), ("reaches a mean F1 score of 0.91 on every project", PASSAGE, 0, 0.899),
        ("0.64", PASSAGE, 1, 1), ("0.65", PASSAGE, 0, 0), ("The first effect was fine", "The \ufb01rst e\ufb00ect was \ufb01ne, they say", 1, 1), ("", PASSAGE, 0, 0), ("...", PASSAGE, 0, 0),
        ("x" * 200, PASSAGE, 0, 0), ("These patterns correspond to error-prone code", "These patterns cor\u2010 respond to error-prone code.", 1, 1),
    ],
)
def test_similarity(quote, passage, low, high):
    found = quotes.similarity(quote, passage)
    assert low <= found <= high and found == plain(quote, passage)


def test_the_search_finds_what_a_plain_one_does(monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 64)
    random.seed(4)
    words = ["".join(random.choices("abcdefgh", k=random.randint(1, 8))) for _ in range(40)]
    for _ in range(150):
        passage = " ".join(random.choices(words, k=random.randint(1, 80)))
        at = random.randrange(len(passage))
        quote = list(passage[at : at + random.randint(1, 80)])
        for _ in range(random.choice([0, 1, 2, 6])):
            quote[random.randrange(len(quote))] = random.choice(["z", "", "a", " "])
        assert quotes.similarity("".join(quote), passage) == plain("".join(quote), passage)


def test_columns_of_quotes(spark):
    rows = spark.createDataFrame([(1, PASSAGE), (2, None)], "k int, text string")
    asked = spark.createDataFrame([(1, "a MEAN f1 score"), (1, "achieves a mean Fl score of 0.64 and a mean"), (2, "x"), (3, "x"), (1, None)], "k int, quote string")
    found = [(r["k"], r["exact"], r["verified"]) for r in texts.quoted(asked, rows, "k", "quote", "text").collect()]
    assert sorted(found) == [(1, False, False), (1, False, True), (1, True, True), (2, False, False), (3, False, False)]
