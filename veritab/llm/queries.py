"""The registered queries of this subpackage, with production parameters, on whole tables."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, extract, jaccard, langid, manifest, media, naming, pack, quality, runs, search, urls
from .common import bounded_batches, materialize

#: Where the tokenizer is; the same path on every executor.
TOKENIZER_VARIABLE, TOKENIZER = "VERITAB_TOKENIZER", "word_bpe_49k.json"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    if found := os.environ.get(TOKENIZER_VARIABLE):
        return found
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(n))


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document kept as media, read back and described; null text is empty, each row counts."""
    return media.texts_as_media(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score, margin and rejection of every document; `und` without letters, and everywhere if nothing can be learned."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(docs["doc_id"], 5) != 0)
    found = langid.identify(docs, model)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and back, as digests; null and empty texts have none."""
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in packed sequences of at most 4096 tokens; a null or empty text is one end token."""
    return pack.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page; null urls and those without `://` have no host and pass."""
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under 85 % shared shingles of four words; texts without words stand alone."""
    return jaccard.link(_table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector; unusable vectors take no part, an empty table gives no rows."""
    vectors = _table(spark, sf_dir, "embeddings")
    return search.nearest(vectors, vectors["vec_id"] % 20 == 0)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty pages have empty text."""
    return extract.main_text(_table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired and rendered; turns without id are one conversation, null texts empty."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and class of every document; empty texts too, by the offset alone; 0.5 if there are no labels."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, fold(labels["doc_id"], 3) != 1)
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays; null counts as empty, each row as a document."""
    return naming.same_texts(_table(spark, sf_dir, "documents")).drop("blocks")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and whether what may be tampered with still proves; rows without id are not tampered with."""
    docs = _table(spark, sf_dir, "documents")
    fields = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = manifest.leaf(*fields[:-1], F.replace(fields[-1], F.lit("\n"), F.lit("")))
    leaves = docs.select("doc_id", "source", manifest.leaf(*fields).alias("leaf"), F.when(fold(docs["doc_id"], 2) == 0, tampered).alias("tampered"))
    proofs = manifest.prove(materialize(leaves, "digests"), "source", ["doc_id"], "leaf", ["doc_id", "tampered"])
    folded = proofs.withColumn("folded_root", manifest.fold(F.coalesce("tampered", "leaf"), F.col("lefts"), F.col("rights")))
    proof = F.sha2(manifest.proof_text(F.col("lefts"), F.col("rights")), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, by their id, from some word on repeat what follows it; others stay."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of every document, and digests of all runs and of the words left; no words, no runs."""
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    # The greatest length, then the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered texts and media references of every page; pages without any give no rows."""
    pages = _table(spark, sf_dir, "pages")
    return media.interleave(pages, pages["html"], "page_id").select("page_id", F.inline("items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_language_id,
        op3_bpe,
        op4_best_fit_packing,
        op5_url_filters,
        op6_ngram_jaccard,
        op7_nearest_neighbours,
        op8_html_extraction,
        op9_chat_formatting,
        op10_quality_classifier,
        op11_exact_dedup,
        op12_merkle_manifest,
        op13_periodic_runs,
        interleaved_pages,
    )
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

#: crc32 of a decimal doc_id: a byte is mixed in, then eight bits are shifted out.
_CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""

ORACLE_SQL = {
    "op5_url_filters": f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {_RULES_SQL}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
fit AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON f.page_id = p.page_id AND f.place = 1
""",
    "op6_ngram_jaccard": """
WITH RECURSIVE cut AS (
  SELECT doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
sets AS (
  SELECT doc_id,
         CASE WHEN len(words) = 0 THEN []::VARCHAR[]
              WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
              ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]))
         END AS shingles
  FROM cut
),
sizes AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n FROM sets),
flat AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * shared >= 85 * (s.n + t.n - shared)
),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other
)
SELECT s.doc_id, s.n AS n_shingles, r.component_id
FROM sizes s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r ON r.doc_id = s.doc_id
""",
    "op11_exact_dedup": """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
         row_number() OVER () AS row FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, row DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS head,
         regexp_replace(text, '\n', '', 'g') AS cut
  FROM documents
),
digests AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS cut_leaf
  FROM fields
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM digests
),
nodes(source, level, idx, n, digest) AS (
  SELECT source, 0, idx, n, leaf FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3, n
),
subroots AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops(level, idx, n, digest) AS (
  SELECT 0, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
),
low_steps AS (
  SELECT a.source, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
),
top_steps AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
  FROM tops a JOIN tops b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
),
low(doc_id, leaf, source, level, idx, proof, folded) AS (
  SELECT doc_id, leaf, source, 0, idx, '', CASE WHEN {_CRC32_SQL} % 2 = 0 THEN cut_leaf ELSE leaf END FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.source, w.level + 1, w.idx // 3, w.proof || s.l || s.r, sha256(s.l || w.folded || s.r)
  FROM low w JOIN low_steps s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level AND s.idx = w.idx
),
high(doc_id, leaf, subroot, level, idx, proof, folded) AS (
  SELECT w.doc_id, w.leaf, u.digest, 0, u.place, w.proof, w.folded
  FROM low w JOIN nodes t ON t.source IS NOT DISTINCT FROM w.source AND t.n = 1 AND t.level = w.level JOIN subroots u ON u.source IS NOT DISTINCT FROM w.source
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.idx // 3, w.proof || s.l || s.r, sha256(s.l || w.folded || s.r)
  FROM high w JOIN top_steps s ON s.level = w.level AND s.idx = w.idx
)
SELECT w.doc_id, w.leaf, w.subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM high w JOIN tops t ON t.n = 1 AND t.level = w.level
""",
}
