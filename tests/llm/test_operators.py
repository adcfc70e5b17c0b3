"""Each corpus operator against brute force, on rows with nulls, ties, copies and odd texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritab.llm import bpe, chat, components, extract, jaccard, langid, media, pack, quality, search, urls
from veritab.llm.queries import URL_RULES, tokenizer_path

TEXTS = [None, "", " \t\n", "a", "One two three.", "One two three.", "x" * 3000, "word " * 5000, "é😀 <|endoftext|> don't", "a\x1cb \u3000c", "ÀÉ İ ǅ ﬁ"]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with every odd text, a null id, a repeated row, and columns whose names clash."""
    rows = [(i, t, "x", 1.0, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 1.0, 7), (4, "One two three.", "x", 1.0, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score double, n int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


# 1: media


def test_media_round_trip(docs):
    rows = media.texts_as_media(docs).collect()
    assert len(rows) == docs.count()
    by = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    for doc in docs.collect():
        raw = (doc["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        found = by[doc["doc_id"], len(raw)]
        assert found["payload_bytes"] == len(payload) and found["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert found["tail_crc32"] == zlib.crc32(payload[-64:])
        assert found["media_sha256"] == hashlib.sha256(media.to_image(payload)).hexdigest()


@given(st.binary(max_size=500))
@settings(max_examples=50, deadline=None)
def test_image_holds_any_payload(raw):
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    assert media.from_image(media.to_image(payload)) == payload


def test_items_keep_order_and_captions():
    html = "<p>one</p><figure><img src='sha256:a' alt='x'><figcaption>first</figcaption></figure>two<script>no</script><img src=b>"
    items = media.parse_items(html)
    assert [(i["position"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [(0, "text", "one", None), (1, "media", "sha256:a", "first"), (2, "text", "two", None), (3, "media", "b", None)]


def test_references_without_media_stay(spark):
    pages = spark.createDataFrame([(1, "a<img src='sha256:00'>b<img src=else>")], "page_id long, html string")
    store = spark.createDataFrame([("11", 5)], "payload_sha256 string, n int")
    rows = media.resolve(media.interleave(pages, pages["html"], "page_id"), store, "page_id").orderBy("position").collect()
    assert [r["kind"] for r in rows] == ["text", "media", "text", "media"] and all(r["n"] is None for r in rows)


def test_media_of_an_empty_table(empty):
    assert media.texts_as_media(empty).count() == 0


# 2: language


def test_language(spark, docs, empty):
    random.seed(1)
    words = {"aa": ["bada", "gado", "beda", "dabo"], "bb": ["xilu", "quxi", "zulix", "luzzi"]}
    rows = [(i, " ".join(random.choices(words[k], k=30)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(train, train["doc_id"] % 5 != 0)
    found = {r["doc_id"]: r for r in langid.identify(train, model).collect()}
    assert all(found[i]["lang_pred"] == k and not found[i]["rejected"] and 0 <= found[i]["score"] <= 1 for i, _, k in rows)
    odd = langid.identify(docs, model).collect()
    assert len(odd) == docs.count() and {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert langid.keep_identified(docs, model).columns == docs.columns
    assert langid.identify(empty, langid.train(empty, empty["doc_id"] > 0)).count() == 0
    assert langid.identify(docs, langid.Model({})).where("lang_pred <> 'und'").count() == 0


def test_mixed_texts_junk_and_ties_are_rejected(spark):
    random.seed(2)
    parts = {"aa": "ba da ga do be ke mi", "bb": "xi lu qu zu fy wo tz", "cc": "schr ung ach ein icht orst"}
    words = {k: ["".join(random.choices(v.split(), k=random.randint(1, 4))) for _ in range(150)] for k, v in parts.items()}

    def text(k, n=150):
        return " ".join(random.choices(words[k], k=n))

    rows = spark.createDataFrame([(i, text(k), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)], "doc_id long, text string, lang string")
    model = langid.train(rows, rows["doc_id"] >= 0)
    pure = [text(k) for k in words for _ in range(10)]
    junk = [" ".join("".join(random.choices("éèñøåþðß", k=6)) for _ in range(n)) for n in (3, 30, 200)]
    odd = [*junk, *(f"{text(a, 75)} {text(b, 75)}" for a, b in (("aa", "bb"), ("bb", "cc"), ("cc", "aa"))), "é"]
    found = langid.identify(spark.createDataFrame(list(enumerate(pure + odd)), "doc_id long, text string"), model).collect()
    rejected = {r["doc_id"]: r["rejected"] for r in found}
    assert model.min_margin > 0 and not any(rejected[i] for i in range(len(pure)))
    assert all(rejected[len(pure) + i] for i in range(len(odd)))


def test_dictionaries_draw_from_whole_texts_once():
    copy = "the same line over again " * 40
    chunks = [c for text in (("a" * 4000) + " the end of it all", copy, copy + " more") for c, _, _ in langid.drawn_chunks(text)]
    content = langid.fill(list(dict.fromkeys(chunks)))
    assert b"the end of it all" in content and content.count(b"the same line over again") < 40


def test_predictions_equal_plain_compression(spark):
    """Every text with every dictionary, a fresh compressor each time."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs, docs["doc_id"] % 5 != 0)
    params = zstandard.ZstdCompressionParameters.from_level(3, **langid._ZSTD)
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for row in docs.collect():
        text = langid.letters(row["text"] or "")
        if not text:
            assert found[row["doc_id"]]["lang_pred"] == "und" and found[row["doc_id"]]["rejected"]
            continue
        sizes = {}
        for lang, content in model.dictionaries.items():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(compression_params=params)
            parts = [text[i : i + langid.CHUNK] for i in range(0, len(text), langid.CHUNK)]
            sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=shared, compression_params=params).compress(p.encode())) for p in parts)
        best, second = sorted(sizes.values())[:2]
        mine = found[row["doc_id"]]
        assert sizes[mine["lang_pred"]] == best and mine["margin"] == pytest.approx((second - best) / best)
        assert mine["rejected"] == (second == best or (second - best) / best < model.min_margin)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = spark.createDataFrame([(1, "ab", "x"), (2, "cd", "y"), (3, "ef", "z")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.train(rows, rows["doc_id"] > 0)
    assert set(langid.train(rows, rows["doc_id"] < 3).dictionaries) == {"x", "y"}


# 3: encoding


def test_bpe_equals_the_library(docs, library, empty):
    rows = bpe.bpe_digests(docs, tokenizer_path()).collect()
    assert len(rows) == docs.count() and bpe.bpe_digests(empty, tokenizer_path()).count() == 0
    by = {r["doc_id"]: r for r in rows}
    for doc in docs.collect():
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        assert by[doc["doc_id"]]["n_tokens"] == len(ids)
        assert by[doc["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[doc["doc_id"]]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def coders():
    return bpe.WordEncoder(tokenizer_path()), bpe.WordEncoder(tokenizer_path(), by_library=True)


@given(st.lists(st.text(alphabet="abcehinorstu  \t\n\x1c\x85.,!'<|>éßİſΣς😀\u0301\u3000漢0²½ǅSTLDendoftxr", max_size=60), max_size=5))
@settings(max_examples=300, deadline=None)
def test_both_coders_equal_the_library(coders, library, texts):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for coder in coders:
        ids, ends = coder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == want


def test_pair_test_is_exact(coders):
    v = coders[0].vocabulary
    random.seed(2)
    tokens = random.sample([i for t, i in v.ids.items() if not t.endswith(v.suffix) and t in v.whole], 400)
    ends = random.sample([i for t, i in v.ids.items() if t.endswith(v.suffix)], 400)
    verdict = v.compatible(np.array(tokens), np.array(ends))
    for a, b, good in zip(tokens, ends, verdict):
        word = v.texts[a] + v.texts[b][: -len(v.suffix)]
        assert good == (v.merge_exactly(word) == [a, b])


@pytest.mark.parametrize("change", [{"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "Whitespace"}}])
def test_other_vocabularies_are_refused(tmp_path, change):
    import json

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    (tmp_path / "v.json").write_text(json.dumps(spec | change))
    for by_library in (False, True):
        with pytest.raises(ValueError):
            bpe.WordEncoder(str(tmp_path / "v.json"), by_library)


def test_forgotten_words_encode_alike(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_REMEMBERED", 20)
    random.seed(4)
    texts = [" ".join(random.choices([f"word{i} x{i}" for i in range(60)], k=15)) for _ in range(40)]
    for coder in (bpe.WordEncoder(tokenizer_path()), bpe.WordEncoder(tokenizer_path(), by_library=True)):
        for text in texts:
            assert coder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


# 4: packing


def test_packing_is_whole_and_gapless(docs, library, empty):
    caps = pack.Capacities(tokens=100, documents=3, attention=6000)
    rows = pack.pack(docs, tokenizer_path(), caps).collect()
    assert pack.pack(empty, tokenizer_path()).count() == 0
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc in docs.where("doc_id <> 4").collect():
        ids = np.array([*library.encode(doc["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[doc["doc_id"]], key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(len(pieces))) and sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in held] == [0, *itertools.accumulate(r["length"] for r in held)][:-1]
        assert sum(r["length"] for r in held) <= 100 and len(held) <= 3 and sum(r["length"] ** 2 for r in held) <= 6000


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_uses_few_sequences(score):
    lengths = np.random.default_rng(3).integers(1, 4097, 5000)
    packer = pack.Packer(pack.Capacities(score=score))
    packer.place(lengths)
    assert packer.opened <= 1.01 * -(-lengths.sum() // 4096)


def test_the_vector_decides_between_sequences():
    """With like room for tokens a piece goes where fewer documents and less attention are left to spend."""
    for weights, want in (((1.0, 0.1, 0.3), 0), ((1.0, 0.0, 0.0), 1)):
        caps = pack.Capacities(tokens=100, documents=10, attention=10_000, weights=weights)
        packer = pack.Packer(caps)
        packer.number, packer.opened = np.array([0, 1]), 2
        # 49 and 50 tokens used: by one piece of 49, or by ten times five.
        packer.used = np.array([[49.0, 1.0, 2401.0], [50.0, 9.0, 250.0]])
        assert packer.place(np.array([20]))[0].tolist() == [want]


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(4, "one two"), (4, "one two"), (None, None)], "doc_id long, text string")
    rows = pack.pack(docs, tokenizer_path()).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"]) for r in rows) == [("4", 0, 3), ("4", 0, 3), ("None", 0, 1)]


def test_every_sequence_stays_open_between_blocks():
    packer = pack.Packer(pack.Capacities())
    packer.place(np.full(3000, 2200))
    packer.place(np.full(3000, 1896))
    assert packer.opened == 3000


def test_sequences_are_shared_between_scan_tasks(spark):
    docs = spark.createDataFrame([(i, "one two three " * (i % 7)) for i in range(64)], "doc_id long, text string").repartition(8)
    rows = pack.pack(docs, tokenizer_path()).collect()
    assert len(rows) == 64 and len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 4096)


# 5: urls


def test_urls_against_rules(spark):
    hosts = ["net", "example.net", "a.example.net", "example.com", "x.example.com", "badexample.com", "org", "EXAMPLE.Net", "example.net:80", ""]
    paths = ["", "/", "/en", "/en/x", "/de/", "/de/y?z", "/fr/#a", "?q", "#f"]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate(itertools.product(hosts, paths))] + [(-1, None), (-2, "no scheme"), (None, "a://b://c/d")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for r in urls.filter_urls(pages.withColumn("host", pages["url"]), URL_RULES).join(pages, "page_id").collect():
        rest = r["url"].partition("://")[2] if r["url"] and "://" in r["url"] else ""
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit)[1:] if fit else (None, "allow")
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *want)
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0 and urls.filter_urls(pages, []).where("rule is not null").count() == 0


def test_repeated_urls_are_judged_each(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id long, url string")
    assert [tuple(r) for r in urls.filter_urls(pages, URL_RULES).collect()] == [(1, "a.net", "/x", "net/", "block")] * 2


def test_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda text: 7)
    index = urls.Index(urls.build_index(URL_RULES))
    assert index.find([b"org\n/fr/", b"org\n/de/"]).tolist()[1] == -1 and index.text(int(index.find([b"org\n/fr/"])[0])) == b"org\n/fr/"


# 6: near duplicates


def brute(rows, size, percent):
    upper = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        words = [w for w in (text or "").translate(upper).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            group[max(root(a), root(b))] = min(root(a), root(b))
    return {(i, len(sets[i]), root(i)) for i in sets}


def family(seed, n=120):
    """Copies, near copies at all distances, chains, short texts, shared passages and singles."""
    random.seed(seed)
    words = [f"w{k}" for k in range(60)]
    base = random.choices(words, k=80)
    passage = random.choices(words, k=30)
    rows, last = [], base
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = list(base)
            for _ in range(random.randint(0, 4)):
                text[random.randrange(80)] = random.choice(words)
        elif kind == 1:
            last = text = [*last[1:], random.choice(words)] if random.random() < 0.8 else [w if random.random() < 0.98 else "q" for w in last]
        elif kind == 2:
            text = random.choices(words[:3], k=random.randint(0, 6))
        elif kind == 3:
            text = passage + random.choices(words, k=20)
        elif kind == 4:
            text = list(base)
        else:
            text = random.choices(words, k=random.randint(1, 100))
        rows.append((i, " ".join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\x0b"), (n + 3, "Kelvin \u212a A"), (n + 4, "kelvin \u212a a")]


@pytest.mark.parametrize("seed, size, percent", [(1, 4, 85), (2, 5, 80)])
def test_links_equal_brute_force(spark, monkeypatch, seed, size, percent):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    rows = family(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {tuple(r) for r in jaccard.link(docs, size, percent).collect()} == brute(rows, size, percent)


def test_links_by_shuffle_and_in_blocks_equal_brute_force(spark, monkeypatch):
    for name, value in (("GROUP", 3), ("BLOCK", 2), ("BROADCAST_IDS", 0), ("COLUMNS", 16)):
        monkeypatch.setattr(jaccard, name, value)
    rows = family(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard.link(docs, 4, 85).collect()} == brute(rows, 4, 85)


@pytest.mark.parametrize("seed", range(5))
def test_links_of_a_group_connect_what_brute_force_does(seed, monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 32)
    random_ = np.random.default_rng(seed)
    base = [np.unique(random_.integers(0, 300, random_.integers(1, 60))) for _ in range(6)]
    sets = [np.unique(np.append(b[random_.random(len(b)) < 0.97], random_.integers(0, 300, 1))) for b in base for _ in range(6)]
    graph = {i: i for i in range(len(sets))}

    def root(g, i):
        while g[i] != i:
            i = g[i]
        return i

    mine = dict(graph)
    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[i], sets[j]))
        if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            graph[max(root(graph, i), root(graph, j))] = min(root(graph, i), root(graph, j))
    for i, j in jaccard.group_links(sets, 80):
        mine[max(root(mine, i), root(mine, j))] = min(root(mine, i), root(mine, j))
    assert [root(graph, i) for i in graph] == [root(mine, i) for i in mine]


def test_links_of_odd_rows(spark, docs, empty):
    found = jaccard.link(docs).collect()
    assert len(found) == docs.count() and [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    assert {r["component_id"] for r in found if r["doc_id"] in (4, 5)} == {4} and jaccard.link(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 4, 6, 7, 8, 9, 10, None], key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    found = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {(i, 0) for i in range(51)} | {(i, 100) for i in range(100, 140)}


# 7: search


def test_search_recall_ties_and_odd_vectors(spark):
    random_ = np.random.default_rng(4)
    x = random_.normal(size=(3000, 32)).astype(np.float32)
    x[500:700] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9020, [None] * 32), (9040, [1.0]), (None, [1.0] * 32), (0, rows[0][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = search.nearest(frame, frame["vec_id"] % 20 == 0)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = x.astype(float) @ x.astype(float).T
    ids, hits = np.arange(3000), 0
    for q in range(0, 3000, 20):
        s = exact[q].copy()
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - exact[q, m[1]]) < 1e-9 for m in mine)
        hits += len({m[1] for m in mine} & set(best.tolist()))
    assert hits / (150 * 20) >= 0.95 and set(found) == set(range(0, 3000, 20))
    assert [m[1] for m in sorted(found[520])] == [0, 0, *range(500, 518)]
    few = spark.createDataFrame(rows[:3] + [(20, rows[20][1])], "vec_id long, embedding array<float>")
    assert search.nearest(few, few["vec_id"] % 20 == 0).count() == 6
    assert search.nearest(few.limit(0), few["vec_id"] % 20 == 0).count() == 0


def test_search_recall_on_clusters_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 512)
    random_ = np.random.default_rng(9)
    centres = random_.normal(size=(40, 64))
    x = (centres[random_.integers(0, 40, 4000)] + 0.4 * random_.normal(size=(4000, 64))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = search.nearest(frame, frame["vec_id"] % 20 == 0).collect()
    exact = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(exact, -np.inf)
    hits = sum(r["vec_id"] in set(np.argsort(-exact[r["query_id"]])[:20].tolist()) for r in got)
    assert len(got) == 200 * 20 and hits / len(got) >= 0.9


def test_search_takes_usable_vectors_of_every_length(spark):
    rows = [(1, []), (2, []), (3, []), (20, [1.0, 0.0]), (40, [1.0, 2.0]), (60, [1.0, 0.0, 0.0]), (61, [2.0, 1.0, 1.0]), (62, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 0, 1.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    found = sorted(tuple(r) for r in search.nearest(frame, frame["vec_id"] % 20 == 0).collect())
    assert found == [(20, 1, 40, 1.0), (40, 1, 20, 1.0), (60, 1, 61, 2.0)]


# 8: pages

P = "Some long paragraph of the article, with commas and words that go on. " * 4


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<nav><a href=x>Menu</a></nav><article><h1>T</h1><p>{P}<p>a <b>b</b>c<br>d</article><footer>f</footer>", f"T {P}a bc d"),
        (f"<div class='sidebar'>{P}</div><div><p>{P}</p><p>short</p></div><section id=comments><p>{P}{P}</p></section>", f"{P}short"),
        (f"<main><header>H</header><p>{P}</p><form>x</form><p>end</p><script>var a='<p>no</p>'</script></main>", f"{P}end"),
        (f"<article><p>{P}</p><aside>{P}</aside><div class='cookie-notice'>{P}</div><p>z</p></article>", f"{P}z"),
    ],
)
def test_extraction(html, want):
    assert extract.extract_text(html) == " ".join(want.split())


@pytest.mark.parametrize(
    "attributes",
    ['class="content" style="overflow: hidden"', 'title="the hidden valley"', "class=no-sidebar", 'class="has-sidebar page"', "class='with-navbar'"]
    + ["class=elementor-widget", "id=social-science", "class=related-work", "class=widget", 'data-x="class=sidebar"'],
)
def test_names_and_values_take_no_article_text(attributes):
    page = f"<body><nav><a href=x>Menu</a></nav><div {attributes}><h1>T</h1><p>{P}</p><p>{P}</p></div><div class='site-footer'>f</div></body>"
    assert extract.extract_text(page) == " ".join(f"T {P} {P}".split())


@pytest.mark.parametrize("attributes", ["hidden", "aria-hidden=true", "class='x related-posts'", "class=widget", "id=cookie-notice"])
def test_furniture_by_name_goes(attributes):
    page = f"<body><div><p>{P}</p><p>{P}</p></div><div {attributes}><a href=x>One more</a> <a href=y>Another</a></div></body>"
    assert extract.extract_text(page) == " ".join(f"{P} {P}".split())


def test_text_outside_the_article_is_selected_by_density():
    page = f"<body><article><p>{P}</p><p>{P}</p></article><section><p>{P}</p><p>{P}</p></section><div><a href=x>One</a></div></body>"
    assert extract.extract_text(page) == " ".join((P * 4).split())


@pytest.mark.parametrize("unit", ["<a ", "<p title='", "</b>", "<u><div><i></u>", "<div>", "<", "<script>", "<!--", '<p x="', "<ul><li>", "<table><tr><td>", "<a ="])
def test_reading_takes_time_in_proportion(unit):
    import time

    page = unit * ((1 << 20) // len(unit))
    began = time.process_time()
    extract.extract_text(page)
    assert time.process_time() - began < 20  # a second or two on an idle machine; a square would be hours


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="a>hello</div>', "hello"),
        ("x <b title='1 > 0'>y</b> z", "x y z"),
        ("a < b <c", "a < b"),
        ("<p>one</ p><p>two</p></p></div>", "one two"),
        ("<!doctype html><?x y?><!-- <p>no</p> --><p>yes", "yes"),
        ("<textarea><p>no</p></textarea><p>yes</p><title>no", "yes"),
    ],
)
def test_no_markup_is_text(html, want):
    assert extract.extract_text(html) == want


@pytest.mark.parametrize("attributes", ['class="notice-period"', 'id="search-results"', 'class="share-of-market"', 'class="widget"'])
def test_paragraphs_stay_whatever_their_names(attributes):
    page = f"<body><article><p>{P}</p><p {attributes}>Short words.</p><p>{P}</p></article></body>"
    assert extract.extract_text(page) == " ".join(f"{P} Short words. {P}".split())


def test_density_selects_without_article_tags():
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(12))
    page = f"<body><div><ul>{menu}</ul></div><div><h1>Head</h1><div><p>{P}</p><p>{P}</p></div><div><h2>More</h2><p>{P}</p>tail</div></div><div><ul>{menu}</ul></div></body>"
    assert extract.extract_text(page) == " ".join(f"Head {P} {P} More {P} tail".split())


def plain_density(node, share):
    """Density by its definition: counts over all descendants, walked anew for each node."""
    import math

    def walk(n, linked):
        for c in n.children:
            if isinstance(c, str):
                yield "text", len("".join(c.split())), linked
            elif not c.silent:
                yield "tag", 1, linked or c.tag == "a"
                yield from walk(c, linked or c.tag == "a")

    parts = list(walk(node, node.tag == "a"))
    chars, links = (sum(n for k, n, a in parts if k == "text" and (a or not only)) for only in (False, True))
    tags, link_tags = (max(1, sum(n for k, n, a in parts if k == "tag" and (a or not only))) for only in (False, True))
    if not chars:
        return 0.0, links, chars
    inner = max(1.0, chars / max(1, links) * tags / link_tags)
    base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
    return (chars / tags * math.log(inner + 1) if base <= 1 else chars / tags * math.log(inner) / math.log(max(base, 1.0001))), links, chars


@pytest.mark.parametrize("seed", range(20))
def test_densities_equal_their_definition(seed):
    random.seed(seed)

    def tree(depth):
        tag = random.choice(["div", "p", "a", "b", "section", "nav", "span"])
        inner = "".join(tree(depth - 1) if depth and random.random() < 0.6 else random.choice(["words of text ", "x", " ", "a longer run of words, and more "]) for _ in range(random.randint(0, 4)))
        return f"<{tag}>{inner}</{tag}>"

    root = extract.parse(f"<body>{tree(5)}{tree(5)}<script>no</script></body>")
    share = extract.measure(root)
    order = [root]
    for node in order:
        order += [c for c in node.children if not isinstance(c, str) and not c.silent]
    for node in order:
        density, links, chars = plain_density(node, share)
        assert node.density == pytest.approx(density) and (node.links, node.chars) == (links, chars)
        kept = [c for c in node.children if isinstance(c, str) or not c.out]
        assert node.total == pytest.approx(sum(len("".join(c.split())) if isinstance(c, str) else plain_density(c, share)[0] for c in kept))


def test_pages_with_clashing_columns_and_long_ones(spark):
    long = f"<body><p>{'word ' * 300_000}</p></body>"
    pages = spark.createDataFrame([(1, "u", long, "x", 5)], "page_id long, url string, html string, text string, n_chars int")
    row = extract.main_text(pages).first()
    assert row["n_chars"] == 5 * 300_000 - 1 and set(extract.main_text(pages).columns) == {"page_id", "url", "text", "n_chars"}


@given(st.text(alphabet="<>/pdiva b=\"'&;!-x", max_size=80))
@settings(max_examples=200, deadline=None)
def test_extraction_takes_any_text(html):
    extract.extract_text(html)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>x y</p>"), (1, "u", None)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in extract.main_text(pages).collect()) == [0, 0, 3] and extract.main_text(pages.limit(0)).count() == 0


# 9: chats


def cheapest(roles, costs):
    """The least cost over all legal sequences, by trying every assignment."""
    best = chat.INF
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        state, total = [(0, 0.0)], 0
        frontier = {0: 0.0}
        for role, b in zip(roles, labels):
            step = {}
            for a, c in frontier.items():
                cost = c + chat.turn_options(role, costs)[a][b][0]
                step[b] = min(step.get(b, chat.INF), cost)
            frontier = step
        best = min([best, *(chat.finish(np.array([frontier.get(s, chat.INF) for s in range(4)]), costs)[1:2])])
    return best


def legal(turns):
    state = 0
    for role, _ in turns:
        assert role in chat.STEPS[state]
        state = role
    return state == chat.ASSISTANT


@pytest.mark.parametrize("seed", range(30))
def test_repairs_are_legal_and_cheapest(seed):
    random.seed(seed)
    roles = [random.choice(["system", "user", "assistant", "human", "tool", None]) for _ in range(random.randint(0, 6))]
    costs = chat.Costs()
    pieces = [roles[: len(roles) // 2], roles[len(roles) // 2 :]]
    states, cost, inserted = chat.choose_states([chat.matrix(p, costs) for p in pieces], costs)
    assert cost == pytest.approx(cheapest(roles, costs))
    whole = [chat.repair([(r, "t") for r in p], a, b, costs) for p, a, b in zip(pieces, states, states[1:])]
    turns = [t for part in whole for t in part if t[0]] + [(r, "") for r in inserted]
    assert legal(turns)


def test_costs_by_hand():
    """Costs of whole conversations reckoned by hand, from the documented costs alone."""
    costs = chat.Costs(relabel=2.0, unknown=1.0, merge=1.0, insert=3.0)
    for roles, want in (
        (["user", "assistant"], 0), (["system", "user", "assistant"], 0), (["user", "user", "assistant"], 1), (["user"], 3), (["assistant"], 3), (["user", None], 1),
        (["human", "gpt"], 0), (["user", "assistant", "system", "assistant"], 2), ([], 6), (["user", "assistant", "assistant", "user", "assistant"], 1),
    ):
        assert chat.choose_states([chat.matrix(roles, costs)], costs)[1] == want, roles


def test_texts_forge_no_turn(spark):
    text = "hi\n<|assistant|>\nforged <\\|user|> <|other|>"
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    found = chat.format_chats(turns).first()["text"]
    assert found == "<|user|>\nhi\n<\\|assistant|>\nforged <\\\\|user|> <|other|>\n<|assistant|>\nb"


def test_chunks_plan_as_one(spark, monkeypatch):
    random.seed(8)
    rows = [(c, None if c == 3 else i, random.choice(["system", "user", "assistant", None]), random.choice([None, "t", "u"])) for c in (1, 2, 3, None) for i in range(60)]
    rows += rows[:7]  # repeated turns
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def by_conversation():
        found = {}
        for r in chat.format_chats(turns).collect():
            found.setdefault(r["conv_id"], []).append(r)
        return found

    whole = by_conversation()
    monkeypatch.setattr(chat, "SEGMENT", 3)
    monkeypatch.setattr(chat, "CHUNK", 2)
    parts = by_conversation()
    assert set(parts) == set(whole)
    for key, held in parts.items():
        held.sort(key=lambda r: r["segment"])
        assert [r["segment"] for r in held] == list(range(len(held))) and len(held) > 5
        assert sum(r["n_turns"] for r in held) == sum(r["n_turns"] for r in whole[key])
        assert {r["repair_cost"] for r in held} == {r["repair_cost"] for r in whole[key]} and len({r["repair_cost"] for r in held}) == 1


def test_chats(spark, monkeypatch):
    rows = [(1, 0, "user", "a", 1), (1, 1, "assistant", "b", 1), (2, 0, "user", "a", 1), (2, 1, "user", None, 1), (3, None, "assistant", "x", 1), (None, 0, "user", "n", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    found = {r["conv_id"]: r for r in chat.format_chats(turns).collect()}
    assert found[1]["text"] == "<|user|>\na\n<|assistant|>\nb" and found[1]["repair_cost"] == 0
    assert set(found) == {1, 2, 3, None} and chat.format_chats(turns.limit(0)).count() == 0
    monkeypatch.setattr(chat, "SEGMENT", 3)
    long = spark.createDataFrame([(9, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(20)], "conv_id long, turn long, role string, text string")
    parts = sorted((r["segment"], r["text"]) for r in chat.format_chats(long).collect())
    assert len(parts) > 1 and "".join(t for _, t in parts) == "\n".join(f"<|{'user' if i % 2 == 0 else 'assistant'}|>\n{i}" for i in range(20))


# 10: quality


def test_quality(spark, docs, empty):
    random.seed(6)
    good = [" ".join(random.choices(["the", "river", "stone", "walks", "over"], k=20)) for _ in range(150)]
    bad = [" ".join(random.choices(["$$$", "win!!", "CLICK", "###"], k=20)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(itertools.chain(*zip(good, bad)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(frame, labels, labels["doc_id"] % 3 != 1)
    found = {r["doc_id"]: r for r in quality.score(frame, model).collect()}
    held = [i for i, _ in rows if i % 3 == 1]
    assert sum(found[i]["predicted"] == 1 - i % 2 for i in held) >= 0.95 * len(held)
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(empty, quality.train(empty, labels, labels["doc_id"] > 0)).count() == 0


def test_scores_equal_plain_sums(spark):
    """Features listed one by one in Python, averaged and put through the model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels, labels["doc_id"] % 3 != 1)
    mask = (1 << 64) - 1

    def grams(word):
        import xxhash

        out = [xxhash.xxh3_64_intdigest(word.encode())]
        marked = f"<{word}>"
        for n in range(quality.SHORTEST, quality.LONGEST + 1):
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) & mask
                    h ^= h >> 29
                out.append(h)
        return [h % quality.BUCKETS for h in out]

    found = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for row in docs.where("doc_id < 60").collect():
        words = (row["text"] or "").split()
        features = [b for w in words for b in grams(w)] + [quality._SAME] * sum(a == b for a, b in zip(words, words[1:]))
        z = (sum(float(model.weights[b]) for b in features) / len(features) if features else 0.0) + model.offset
        want = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        assert found[row["doc_id"]]["score"] == pytest.approx(want, abs=1e-6)
        assert found[row["doc_id"]]["predicted"] == int(found[row["doc_id"]]["score"] >= 0.5)


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from veritab.llm import common

    conf = SimpleNamespace(get=lambda name, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)
