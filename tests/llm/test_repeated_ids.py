"""Ids that several different texts share, against brute force."""

from __future__ import annotations

import random

import pytest

from veritab.llm import jaccard


def shingles(text, size):
    words = (text or "").lower().split()
    if len(words) < size:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(rows, size, percent):
    """(id, shingles, component) of each row; an id is one document with all of its texts."""
    sets = [shingles(t, size) for _, t in rows]
    group = {i: i for i, _ in rows if i is not None}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, _), a in zip(rows, sets):
        for (j, _), b in zip(rows, sets):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((root(i), root(j)))
                group[hi] = lo
    return sorted((i if i is not None else -1, len(s), -1 if i is None else root(i)) for (i, _), s in zip(rows, sets))


def test_a_long_text_of_an_id_with_a_short_one_links(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, "a b c d e f"), (1, " ".join(words)), (9, " ".join(words[:398] + ["x"]))]
    found = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(rows, 4, 85) and {r["component_id"] for r in found} == {1}


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_equal_brute_force(spark, seed):
    random.seed(seed)
    bases = [[f"v{random.randrange(60)}" for _ in range(random.randint(3, 60))] for _ in range(12)]

    def text():
        words = list(random.choice(bases))
        for _ in range(random.choice([0, 0, 1, 2])):
            words[random.randrange(len(words))] = f"n{random.randrange(1000)}"
        return random.choice([" ".join(words)] * 8 + [None, "", "one two"])

    rows = [(random.choice([None, *range(45)]), text()) for _ in range(110)]
    found = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in found)
    assert got == components(rows, 4, 85)
