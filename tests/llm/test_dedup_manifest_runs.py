"""Exact duplicates, the Merkle manifest and periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.llm import manifest, naming, queries, runs
from veritab.llm.common import materialize

TEXTS = [None, "", " \t\n", "a", "A", "One two three.", "oNE two three.", "x" * 3000, "X" * 2999 + "y", "word " * 3000, "é😀 Ünï", "ab " * 7, "É", "é"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, a null id, repeated rows, null groups, and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", "de", 5, "x", 1, 2, 3) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "s1", None, None, "x", 1, 2, 3), (3, "a", "s0", "de", 5, "x", 1, 2, 3), (3, "a", "s0", "de", 5, "x", 1, 2, 3), (2**60 + 1, "a", "s0", "de", 5, "x", 1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, id string, chunk int, idx int, digest int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# 11: exact duplicates


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("size", [1024, 7, 1])
def test_same_texts_have_one_name(docs, size):
    found = naming.same_texts(docs.where("length(text) < 100 OR text IS NULL") if size == 1 else docs, block_bytes=size).collect()
    rows = [(r["doc_id"], lower(r["text"])) for r in docs.collect() if size > 1 or len(r["text"] or "") < 100]
    groups = {}
    for i, text in rows:
        groups.setdefault(text, []).append(i)
    want = sorted(((i is not None, i or 0), max((x for x in groups[t] if x is not None), default=None), len(groups[t]), sha(t)) for i, t in rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    kept = [r for r in found if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_names_over_several_chunks(spark, monkeypatch):
    """Texts of 1 to 40 blocks that share blocks and pairs, in chunks of a few texts; a third are one text."""
    random.seed(3)
    parts = ["".join(random.choices("ab", k=4)) for _ in range(5)]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) + random.choice(["", "a", "b"]) for _ in range(150)]
    texts += [t for t in texts[:50]] + [texts[0]] * 100
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in naming.same_texts(rows, block_bytes=4).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if u == t]
        assert (found[i]["keep_id"], found[i]["group_size"], found[i]["kept"]) == (max(same), len(same), i == max(same))


def test_a_chunk_ends_when_it_is_full(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(naming, "CHUNK_BLOCKS", 10)
    monkeypatch.setattr(naming, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)})())}))
    caught = []
    table = type("D", (), {"schema": {"doc_id": type("S", (), {"dataType": type("K", (), {"simpleString": staticmethod(lambda: "bigint")})()})()}})
    monkeypatch.setattr(table, "__getitem__", lambda self, name: F.lit(0), raising=False)
    monkeypatch.setattr(table, "select", lambda self, *c: self, raising=False)
    monkeypatch.setattr(table, "mapInArrow", lambda self, run, shape: caught.append(run), raising=False)
    if spark:  # literals need a session
        naming._cut(table(), "doc_id", "text", naming.lower_ascii, 4)
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array(["abcdefgh" * 3])], names=["id", "text"]) for i in range(6)]
    made = list(caught[0](iter(batches)))
    assert [b.column("chunk")[0].as_py() - (3 << 32) for b in made] == [0, 0, 1, 1, 2, 2]
    assert [b.num_rows for b in made] == [3, 1, 3, 1, 3, 1]  # two distinct blocks where a chunk begins


def test_same_texts_of_an_empty_table(empty):
    assert naming.same_texts(empty).count() == 0


# 12: manifest


def tree(nodes, fanout):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        levels.append(nodes)
    return levels


def path(levels, i, fanout):
    steps = []
    for level in levels[:-1]:
        run = i - i % fanout
        steps.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        i //= fanout
    return steps


def plain_manifest(leaves, fanout):
    """(id, leaf, subroot, root, steps) of (group, id, leaf) rows."""
    groups = {}
    for group, i, digest in leaves:
        groups.setdefault(group, []).append((i is not None, i or 0, digest, i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    return sorted(
        (str(x[3]), x[2], trees[g][-1][0], top[-1][0], path(trees[g], i, fanout) + path(top, k, fanout))
        for k, g in enumerate(names) for i, x in enumerate(sorted(groups[g]))
    )


@pytest.mark.parametrize("fanout, levels, groups", [(3, 6, 3), (3, 1, 3), (2, 2, 40), (3, 2, 1), (4, 1, 90)])
def test_proofs_equal_a_plain_tree(spark, fanout, levels, groups):
    """Large and small groups, null among them, with superblocks of few and many levels."""
    random.seed(groups)
    rows = [(None if (g := min(random.randrange(groups), random.randrange(groups))) == 2 else f"g{g}", i if i % 50 else None, sha(str(i))) for i in range(300)]
    leaves = materialize(spark.createDataFrame(rows, "g string, i long, d string").repartition(4), "test")
    found = manifest.prove(leaves, "g", ["i"], "d", ["i"], fanout, levels)
    got = sorted((str(r["i"]), r["d"], r["subroot"], r["root"], list(zip(r["lefts"], r["rights"]))) for r in found.collect())
    assert got == plain_manifest(rows, fanout)
    folded = found.select((manifest.fold(F.col("d"), F.col("lefts"), F.col("rights")) == F.col("root")).alias("ok"), (manifest.fold(F.lit("0"), F.col("lefts"), F.col("rights")) == F.col("root")).alias("no"))
    assert {tuple(r) for r in folded.collect()} == ({(True, False)})


def test_manifest_of_odd_rows(docs, empty):
    leaves = docs.select("doc_id", "source", "idx", manifest.leaf(docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], docs["text"]).alias("digest"))

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    rows = [(r["source"], r["doc_id"], sha("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))) for r in docs.collect()]
    found = manifest.prove(materialize(leaves, "test"), "source", ["doc_id"], "digest", ["doc_id", "idx"]).collect()
    got = sorted((str(r["doc_id"]), r["digest"], r["subroot"], r["root"], list(zip(r["lefts"], r["rights"]))) for r in found)
    assert got == plain_manifest(rows, 3) and all(r["idx"] == 2 for r in found)
    none = materialize(empty.withColumn("d", F.lit("x")), "test")
    assert manifest.prove(none, "source", ["doc_id"], "d", ["doc_id"]).count() == 0


def test_one_leaf_is_its_own_root(spark):
    one = materialize(spark.createDataFrame([("g", 1, "ab")], "g string, i long, d string"), "test")
    (row,) = manifest.prove(one, "g", ["i"], "d", ["i"]).collect()
    assert (row["subroot"], row["root"], row["lefts"]) == ("ab", "ab", [])


# 13: runs


def plain_runs(words, least=12):
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            part = words[i : j + p]
            if len(part) >= max(least, 2 * p) and not any(part[q:] == part[:-q] for q in range(1, p)):
                found.append((i, len(part), p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


WORDS = st.one_of(
    st.lists(st.integers(0, 1), max_size=80),
    st.lists(st.integers(0, 5), max_size=120),
    st.builds(lambda a, b, k, c: a + b * k + c, *[st.lists(st.integers(0, 3), max_size=15)] * 2, st.integers(2, 9), st.lists(st.integers(0, 3), max_size=15)),
)


@given(WORDS, st.sampled_from([12, 4, 1]))
@settings(max_examples=400, deadline=None)
def test_runs_equal_the_definition(words, least):
    assert runs.find_runs(runs.numbered([b"%d" % w for w in words]), least) == plain_runs(words, least)


@pytest.mark.parametrize("kinds", [1, 2, 40, 3000])
def test_matches_of_heavy_and_light_words(kinds):
    ids = runs.numbered([b"%d" % w for w in np.random.default_rng(kinds).zipf(1.3, 3000) % kinds])
    found = runs.lag_matches(ids)
    assert all(found[p] == (ids[p:] == ids[:-p]).sum() for p in range(1, 1501)) and found[0] == 0


def test_differences_are_counted_in_parts(monkeypatch):
    ids = np.arange(2000) % 97
    whole = runs.lag_matches(ids)
    monkeypatch.setattr(runs, "HELD_DIFFERENCES", 100)
    assert (runs.lag_matches(ids) == whole).all()


def test_one_word_very_often_and_a_chain_of_runs():
    """Every lag of the first has matches enough; the second has about as many runs as words."""
    assert runs.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert runs.find_runs(np.array(b)) == plain_runs(b)


def test_collapse_keeps_first_periods():
    words = b"x a b a b a b a b a b a b y".split()
    found = runs.find_runs(runs.numbered(words))
    assert found == [(1, 12, 2)] and runs.collapse(words, found) == b"x a b y"


def test_runs_of_odd_rows(docs, empty):
    found = runs.periodic_runs(docs).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found}
    assert [tuple(r) for r in by[9]["runs"]] == [(0, 3000, 1)] and by[9]["collapsed"] == "word"
    assert by[11]["runs"] == [] and by[0]["collapsed"] == "" and by[0]["n_words"] == 0 and by[2]["n_words"] == 0
    assert by[None]["collapsed"] == "no id"
    assert runs.periodic_runs(empty).count() == 0


def test_query_of_runs_equals_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    found = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 8000").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            g, old = h // 10, list(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
        want = plain_runs(words)
        gone = {i for s, size, q in want for i in range(s + q, s + size)}
        best = max(want, key=lambda r: (r[1], -r[0], -r[2])) if want else (None, None, None)
        lines, left = "".join(f"{s},{size},{q}\n" for s, size, q in want), " ".join(w for i, w in enumerate(words) if i not in gone)
        assert found[row["doc_id"]] == (row["doc_id"], len(want), *best, 1000 * best[1] // best[2] if want else None, sha(lines), sha(left))
